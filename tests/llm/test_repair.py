import hashlib
import random
import re
import zlib
from functools import cache
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from veil.llm import repair

ROWS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, audit) and the repaired lines, by plain recursion over turns, and ends of words of the grammar."""

    @cache
    def best(i, word, depth=0):
        """`word`: the end of the initials so far. More than three insertions in a row come back to an earlier end."""
        options = [(0, "", ())] if i == len(rows) and word in ("", "ua") else []
        if depth < 3:
            options += [add("I", 3, (r, ""), best(i, step(word, r[0]), depth + 1)) for r in ("user", "assistant") if step(word, r[0])]
        if i < len(rows):
            role, text = rows[i][2:]
            options.append(add("D", 4, None, best(i + 1, word)))
            if marks[i] not in ("blank", "duplicate"):
                extra = 3 * (marks[i] == "truncated")
                for edit, cost, r in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    w = step(word, r[:1] or " ")
                    if w:
                        options.append(add(edit, cost + extra, (r, text), best(i + 1, w)))
        return min(options, key=lambda o: o[:2], default=(1 << 40, "", ()))

    def add(edit, cost, line, rest):
        return cost + rest[0], edit + rest[1], (*([line] if line else []), *rest[2])

    def step(word, letter):
        if word in ("", "ua", "s") and letter == "u":
            return "u"
        if word == "u" and letter == "a":
            return "ua"
        return "s" if word == "" and letter == "s" else None

    cost, audit, lines = best(0, "")
    assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in lines))
    return cost, audit, lines


def expected(rows):
    out, hurt = {}, list(damage(rows))
    for conv in {r[0] for r in rows}:
        mine = [r for r in hurt if r[0] == conv]
        digest = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))
        out[conv] = report(mine)
    return out


def report(mine):
    marks = faults(mine)
    turns = {r[1] for r in mine if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[2][:1] or " " for r in mine]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = cheapest(mine, marks)
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_query_over_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = result(repair.op12_structure_repair(spark, sf_dir))
    assert got == expected(rows)
    assert sum(r[5] > 0 for r in got.values()) > len(got) // 4


def test_query_equals_its_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), repair.op12_structure_repair, repair.ORACLE, sf_dir) == ""


def random_rows(rng, n, convs):
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["", " \n", "a.", "b!", "c", "d", "e? ", "f.\n", None, "é", "g.x"]
    return [(rng.randrange(convs), None if rng.random() < 0.1 else t, rng.choice(roles), rng.choice(texts)) for t in range(n)]


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_random_conversations_and_cuts(spark, tmp_path, segment):
    rng = random.Random(segment)
    rows = random_rows(rng, 400, 60) + [(None, 1, "user", "no id."), (99, None, None, None), (98, 7, "tool", "x")]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(150)]  # a long one over many segments
    rows += [(1001, t, "user", f"same role {t}") for t in range(40)]  # one run of one symbol
    df = spark.createDataFrame(rows, ROWS)
    assert result(repair.repair_report(repair.damaged(df), df, segment)) == expected(rows)


def test_unrolled_choices_equal_plain_recursion():
    rng, alphabet = random.Random(5), ["-", "s", "u", "a", "x", "st", "ut", "at", "xt"]
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
    for _ in range(1500):
        symbols = [s for _ in range(rng.randrange(7)) for s in [rng.choice(alphabet)] * rng.choice([1, 1, 2, 3])][:9]
        rows = [(0, i, role[s[0]], f"{i}") for i, s in enumerate(symbols)]
        marks = ["blank" if s == "-" else "truncated" if s[1:] else "" for s in symbols]
        cost, audit, _ = cheapest(rows, marks)
        edits, state = repair.unroll(symbols, 0, repair.at_end())
        assert "".join(e for some in edits for e, _ in some) + "".join(e for e, _ in repair.closing(state)) == audit, symbols
        matrix = repair.transition(symbols)
        assert (repair.applied(matrix, repair.at_end()) if matrix else repair.at_end())[0] == cost


def test_powers_equal_repeated_steps():
    for symbol in ("-", "u", "xt"):
        costs = repair.at_end()
        for n in range(1, 40):
            costs = repair.applied(repair.power(symbol, 0), costs)
            assert repair.applied(repair.run_matrix(symbol, n), repair.at_end()) == costs


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "a."), (1, 2, "user", ""), (2, 0, "assistant", "hm"), (3, 5, "user", "x."), (3, 6, "user", "y."), (3, 7, "assistant", "z.")]
    joined, _ = repair.planned(spark.createDataFrame(rows, ROWS).withColumn("place", F.lit("extra")), 2)
    got = sorted(map(tuple, repair.repaired_turns(joined).collect()))
    assert got[:4] == [(1, 0, "K", "system", "s."), (1, 1, "K", "user", "a."), (1, 2, "D", None, ""), (1, 3, "I", "assistant", "")]
    for _, lines in groupby(got, lambda r: r[0]):
        assert GRAMMAR.fullmatch("".join(r[3][0] for r in lines if r[3]))


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert repair.repair_report(repair.damaged(df), df).count() == 0


def test_repeated_rows_and_dropped_conversations(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "a.")] + [(5000, 1, "user", "same.")] * 7
    df = spark.createDataFrame(rows, ROWS)
    got = result(repair.repair_report(repair.damaged(df), df))
    assert got == expected(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
