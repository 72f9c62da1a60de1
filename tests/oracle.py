"""Runs registered queries next to their SQL in DuckDB and compares the rows.

`python tests/oracle.py [sf] [name prefix ...]` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, bool):
        return v
    if hasattr(v, "tzinfo"):
        return str(v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def compare(spark, con, fn, sql, sf_dir):
    """Empty string when equal, otherwise what differs first."""
    got = fn(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    expected = _rows(names, cur.fetchall())
    actual = _rows(got.columns, [tuple(r) for r in got.collect()])
    if len(expected) != len(actual):
        return f"rows {len(actual)} != {len(expected)}"
    for a, e in zip(actual, expected):
        for x, y in zip(a, e):
            if x != y or type(x) is not type(y):
                return f"{sorted(names)}: {a} != {e}"
    return ""


def main():
    from veil.plans import ORACLES, QUERIES
    from veil.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session("8"), connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, fn, ORACLES[name], sf_dir)
            else:
                n = fn(spark, sf_dir).count()
                problem = "" if n else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind:4} {time.time() - t:6.2f}s {name} {problem}", flush=True)
    print("failures", bad)


if __name__ == "__main__":
    main()
