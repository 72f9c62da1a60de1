import re

import pytest
from pyspark.sql import functions as F

from veil.llm import mixing


def filled(sizes, weights, total, most):
    """Targets by resharing what is above the limits until nothing is."""
    goal, open_, rest = {}, set(sizes), total * sum(sizes.values())
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / w > most * sizes[s]}
        if not over:
            goal |= {s: rest * weights[s] / w for s in open_}
            break
        goal |= {s: most * sizes[s] for s in over}
        rest -= sum(goal[s] for s in over)
        open_ -= over
    return goal


def summed(rows):
    out = {}
    for r in rows:
        s = out.setdefault(r.source, {"size": 0, "taken": 0, "n": 0, "largest": 0, "target": r.target, "source_size": r.source_size})
        s["size"] += r.size
        s["taken"] += r.taken
        s["largest"] = max(s["largest"], r.size)
    return out


def test_targets_and_words_of_the_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = mixing.op4_mixing(spark, sf_dir).join(docs, "doc_id").collect()
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and r.taken in (0, r.size, 2 * r.size)
    got = summed(rows)
    names = sorted(got)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal = filled({s: got[s]["size"] for s in names}, weights, 1.5, 2.0)
    for s in names:
        assert got[s]["source_size"] == got[s]["size"]
        assert got[s]["target"] == pytest.approx(goal[s], rel=1e-9)
        assert abs(got[s]["taken"] - goal[s]) <= got[s]["largest"]
    again = {r.doc_id: r.taken for r in mixing.op4_mixing(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_rates_solve_the_dual(spark, documents):
    docs = documents([(i, "w " * (1 + i % 50 + 40 * (i % 7 == 0)), "en", f"s{i % 4}") for i in range(600)])
    rows = mixing.measured(docs)
    sizes = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    state = mixing.multipliers(sizes, mixing.targets(sizes))
    met = mixing.same_source(sizes, state).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("n") * mixing.rate()).alias("got")).collect()
    assert met and all(r.got == pytest.approx(r.target, rel=1e-6) for r in met)


def test_mixed_rows_repeat_as_planned(spark, documents):
    docs = documents([(i, "w " * (1 + i % 9), "en", ("a", "b", None)[i % 3]) for i in range(300)])
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    seen = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    rows = mixing.measured(docs)
    plan = mixing.same_source(rows, mixing.plan(rows)).select("doc_id", mixing.copies().alias("n")).collect()
    assert seen == {r.doc_id: r.n for r in plan if r.n} and max(seen.values()) <= 2


def test_awkward_rows(awkward):
    mix = mixing.mixed(awkward)
    assert mix.columns == awkward.columns and mix.where("doc_id IN (1, 2, 3)").isEmpty()
    assert mix.where("doc_id = 4").count() % 2 == 0  # repeated rows go together
    assert mixing.mixed(awkward.limit(0)).count() == 0
    assert mixing.mixed(awkward.where("text IS NULL")).count() == 0


def test_one_source_holds_a_third_of_all(documents):
    docs = documents([(i, "w " * (1 + i % 13), "en", "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(900)])
    rows = mixing.measured(docs)
    out = mixing.same_source(rows, mixing.plan(rows)).select("source", "size", "source_size", "target", (mixing.copies() * F.col("size")).alias("taken")).collect()
    for s in summed(out).values():
        assert abs(s["taken"] - s["target"]) <= s["largest"]


def test_no_python_in_the_plan(documents):
    text = mixing.mixed(documents([(1, "a b", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)
