"""Mondrian against an independent plain-Python partitioner, and its invariants."""

import os
import random
import subprocess
import sys
from statistics import median

import pyspark
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from veil.operators import mondrian as M


def brute(rows, kinds, rule, sens=None, max_depth=None, min_size=None):
    """rows: tuples of features (+ sensitive last). Returns the set of partitions as frozensets of row numbers."""
    width = len(kinds)
    n_all = len(rows)
    freq = {}
    if sens is not None:
        for r in rows:
            freq[r[sens]] = freq.get(r[sens], 0) + 1 / n_all

    def span(idx, j):
        vals = [rows[i][j] for i in idx if rows[i][j] is not None]
        if not vals:
            return None
        return len(set(vals)) if kinds[j] == "c" else max(vals) - min(vals)

    full = [span(range(n_all), j) for j in range(width)]

    def halves(idx, j):
        vals = [rows[i][j] for i in idx if rows[i][j] is not None]
        if not vals:
            return None
        if kinds[j] == "c":
            levels = sorted(set(vals))
            left = set(levels[: len(levels) // 2])
            if not left:
                return None
            test = lambda v: v in left
        else:
            m = median(vals)
            test = (lambda v: v <= m) if m == min(vals) else (lambda v: v < m)
        lo = [i for i in idx if rows[i][j] is None or test(rows[i][j])]
        return lo, [i for i in idx if i not in set(lo)]

    def valid(idx):
        if len(idx) < rule.k:
            return False
        if rule.l is not None and len({rows[i][sens] for i in idx}) < rule.l:
            return False
        if rule.t is not None:
            worst = max(abs(sum(rows[i][sens] == v for i in idx) / len(idx) - p) for v, p in freq.items())
            if round(worst, 12) > rule.t:
                return False
        return True

    out, queue = set(), [(list(range(n_all)), 0)]
    while queue:
        idx, depth = queue.pop()
        best = None
        if (max_depth is None or depth < max_depth) and (min_size is None or len(idx) >= min_size):
            order = []
            for j in range(width):
                s = span(idx, j)
                if s is not None:
                    order.append((-round(s / full[j] if full[j] else s, 12), j))
            for _, j in sorted(order):
                sides = halves(idx, j)
                if sides and valid(sides[0]) and valid(sides[1]):
                    best = sides
                    break
        if best is None:
            out.add(frozenset(idx))
        else:
            queue += [(best[0], depth + 1), (best[1], depth + 1)]
    return out


def spark_partitions(spark, rows, schema, features, rule, sens=None, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + schema)
    p = M.partition(df, features, rule, sens, **kw)
    got = p.assign(df).groupBy("part_id").agg(F.collect_list("id").alias("ids")).collect()
    return {frozenset(r["ids"]) for r in got}, p, df


def sample(n, seed, nulls=False):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a = rng.choice([30] * 4 + list(range(18, 70)))  # a hot value
        h = rng.randint(1, 6) * 10
        c = rng.choice(["x", "y", "z", "w", "v"])
        if nulls and rng.random() < 0.08:
            a = None
        rows.append((a, h, c, rng.choice(["lo", "lo", "lo", "hi"])))
    return rows


SCHEMA = "a int, h int, c string, s string"


@pytest.mark.parametrize(
    "seed,rule,kw",
    [
        (1, M.Validity(3), {}),
        (2, M.Validity(5), {"max_depth": 3}),
        (3, M.Validity(4, l=2), {}),
        (4, M.Validity(4, t=0.3), {}),
        (5, M.Validity(4, l=2, t=0.35), {"min_size": 20}),
    ],
)
def test_matches_plain_python(spark, seed, rule, kw):
    rows = sample(70, seed)
    got, _, _ = spark_partitions(spark, rows, SCHEMA, ["a", "h", "c"], rule, "s", **kw)
    assert got == brute(rows, ["n", "n", "c"], rule, 3, **kw)


def test_missing_values_go_left_and_no_row_is_lost(spark):
    rows = sample(60, 9, nulls=True)
    got, _, _ = spark_partitions(spark, rows, SCHEMA, ["a", "c"], M.Validity(4))
    reduced = [(r[0], r[2]) for r in rows]
    assert got == brute(reduced, ["n", "c"], M.Validity(4))
    assert sorted(i for part in got for i in part) == list(range(60))


def test_ranges_do_not_change_the_result(spark, monkeypatch):
    rows = sample(80, 11)
    plain, _, _ = spark_partitions(spark, rows, SCHEMA, ["a", "h", "c"], M.Validity(4), max_depth=3)
    monkeypatch.setattr(M, "ranges_for", lambda n: 3)
    cut, _, _ = spark_partitions(spark, rows, SCHEMA, ["a", "h", "c"], M.Validity(4), max_depth=3)
    assert plain == cut


def test_constant_and_unsplittable_columns(spark):
    rows = [(5, 1, "only", "lo")] * 7 + [(5, 2, "only", "hi")] * 5
    got, p, _ = spark_partitions(spark, rows, SCHEMA, ["a", "c", "h"], M.Validity(3))
    assert sorted(map(len, got)) == [5, 7]
    assert {r["part_id"] for r in p.cells.collect()} == {"10", "11"}


def test_release_micro_aggregation_and_bounds(spark):
    rows = sample(64, 13)
    got, p, df = spark_partitions(spark, rows, SCHEMA, ["a", "c"], M.Validity(6))
    micro = {r["id"]: r for r in M.micro_aggregate(df, p).collect()}
    for part in got:
        ages, cats = [rows[i][0] for i in part], [rows[i][2] for i in part]
        best = min(set(cats), key=lambda v: (-cats.count(v), v))
        for i in part:
            assert micro[i]["a"] == pytest.approx(sum(ages) / len(ages))
            assert micro[i]["c"] == best and micro[i]["h"] == rows[i][1]
    table = M.release_table(df, p, "s").collect()
    assert sum(r["count"] for r in table) == 64
    assert M.release_table(df, p, "s", max_partitions=2).select("part_id").distinct().count() == 2
    every = sorted({r[0] for r in rows})
    for r in M.partition_bounds(p).where("feature = 'a'").collect():
        ids = [x["id"] for x in p.assign(df).where(F.col("part_id") == r["part_id"]).collect()]
        top = max(rows[i][0] for i in ids)
        assert r["left"] == min(rows[i][0] for i in ids)
        assert r["right"] == next((v for v in every if v > top), top)


def test_result_does_not_depend_on_partitioning(spark):
    rows = sample(90, 17)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + SCHEMA)
    ids = []
    for n in (1, 7, 40):
        p = M.partition(df.repartition(n), ["a", "c"], M.Validity(5), max_depth=2)
        ids.append({r["id"]: r["part_id"] for r in p.assign(df).collect()})
    assert ids[0] == ids[1] == ids[2]


@pytest.mark.parametrize("most", [0, 40])
@pytest.mark.parametrize(("rule", "limits"), [
    (M.Validity(k=4), {}), (M.Validity(k=3, l=2), {}), (M.Validity(k=3, t=0.3), {"max_depth": 3}), (M.Validity(k=2, l=2, t=0.35), {"min_size": 20}),
])
def test_levels_and_tasks_give_the_same_boxes(spark, monkeypatch, rule, limits, most):
    """All by level, and large partitions by level with the others finished in tasks; the other tests finish in one task."""
    rows, sens = sample(300, 11, nulls=True), 3 if rule.l or rule.t else None
    calls = []
    monkeypatch.setattr(M, "LOCAL_CELLS", most)
    monkeypatch.setattr(M, "_split_level", lambda *a, f=M._split_level: calls.append(1) or f(*a))
    got, _, _ = spark_partitions(spark, rows, SCHEMA, ["a", "h", "c"], rule, "s" if sens else None, **limits)
    assert got == brute(rows, "nnc", rule, sens, **limits)
    assert len(calls) >= 2


def test_a_hot_combination_is_split_by_level_only_while_large(spark, monkeypatch):
    """Jobs by level end as soon as partitions fit a task; what is left is one grouped pass."""
    calls = []
    monkeypatch.setattr(M, "LOCAL_CELLS", 2000)
    monkeypatch.setattr(M, "_split_level", lambda *a, f=M._split_level: calls.append(1) or f(*a))
    df = spark.range(12_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 997).alias("a"), (F.col("id") % 89).alias("h"))
    p = M.partition(df, ["a", "h"], M.Validity(k=3))
    sizes = p.cells.groupBy("part_id").agg(F.sum("n").alias("n"), F.max(F.length("part_id")).alias("depth")).agg(F.sum("n"), F.min("n"), F.max("depth")).first()
    assert sizes[0] == 12_000 and sizes[1] >= 3
    assert 1 <= len(calls) < sizes[2] - 1  # fewer levels than the boxes are deep


@pytest.mark.parametrize("most", [1 << 16, 60])
@pytest.mark.parametrize("rule", [M.Validity(k=3), M.Validity(k=3, l=2)], ids=["k", "kl"])
def test_rows_go_down_the_tree_to_their_cell_without_a_shuffle(spark, monkeypatch, rule, most):
    monkeypatch.setattr(M, "LOCAL_CELLS", most)
    rows = sample(400, 5, nulls=True)
    _, p, df = spark_partitions(spark, rows, SCHEMA, ["a", "h", "c"], rule, "s" if rule.l else None)
    assert p.depth >= 4 and p.n_cells > 100
    routed = p.assign(df, most_cells=0)
    joined = p.assign(df)
    assert routed.columns == joined.columns
    assert {r["id"]: r["part_id"] for r in routed.collect()} == {r["id"]: r["part_id"] for r in joined.collect()}
    plan = routed._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("Initial Plan")[0].splitlines() if "Exchange" in line]
    assert exchanges and all("Broadcast" in line for line in exchanges)


def test_a_tree_without_splits(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, a double")
    p = M.partition(df, ["a"], M.Validity(k=3))
    assert p.depth == 0 and {r["part_id"] for r in p.assign(df, most_cells=0).collect()} == {"1"}


def test_rows_meet_any_number_of_cells_unless_one_is_hot(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "CAST(id * 7 % 400 AS double) AS a", "CAST(id % 3 AS string) AS b")
    p = M.partition(df, ["a", "b"], M.Validity(5))
    want = {r["id"]: r["part_id"] for r in p.assign(df, most_cells=0).collect()}
    routed, route = [], M.Partitioning.route
    monkeypatch.setattr(M.Partitioning, "route", lambda self, rows: routed.append(1) or route(self, rows))
    monkeypatch.setattr(M, "JOINED_CELLS", 100)
    assert (p.n_cells, p.hottest) == (400, 1) and len(set(want.values())) > 40
    assert {r["id"]: r["part_id"] for r in p.assign(df).collect()} == want and not routed
    monkeypatch.setattr(M, "HOT_ROWS", 0)
    assert {r["id"]: r["part_id"] for r in p.assign(df).collect()} == want and routed


def test_finishing_a_partition_needs_nothing_of_this_package(tmp_path):
    """Tasks that cannot import it load the function all the same."""
    (tmp_path / "finish").write_bytes(cloudpickle.dumps(M.finish_locally(1, set(), {0: 1.0}, M.Validity(2, 2, 0.1), None, None, None, None)))
    load = "import pickle, sys; pickle.load(open('finish', 'rb')); assert not [m for m in sys.modules if m.startswith('veil')]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.path.dirname(os.path.dirname(pyspark.__file__))}
    assert subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env=env).returncode == 0
