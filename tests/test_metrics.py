import random

import pytest
from pyspark.sql import functions as F

from veil.operators import metrics as M
from veil.operators import split as S


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    out = []
    for _ in range(300):
        y = int(rng.random() < 0.3)
        out.append((y, round(min(max(rng.gauss(0.4 + 0.2 * y, 0.2), 0.0), 1.0), 2)))
    return out


@pytest.fixture(scope="module")
def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


@pytest.mark.parametrize("ranges", [1, 5, None])
def test_auc_and_average_precision(scored, pairs, ranges):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s in pairs}, reverse=True):
        hits, flagged = sum(s >= t for s in pos), sum(s >= t for _, s in pairs)
        ap += (hits / len(pos) - last) * hits / flagged
        last = hits / len(pos)
    row = M.ranking_metrics(scored, ranges=ranges).first()
    assert (row["roc_auc"], row["pr_auc"]) == pytest.approx((auc, ap))


def test_threshold_choice(scored, pairs):
    best = None
    for t in M.percent_thresholds(1, 99):
        acc = sum((s >= t) == bool(y) for y, s in pairs) / len(pairs)
        rec = sum(s >= t for y, s in pairs if y) / sum(y for y, _ in pairs)
        if rec >= 0.8 and (best is None or acc > best[1]):
            best = (t, acc)
    row = M.choose_threshold(scored).first()
    assert (row["threshold"], row["accuracy"]) == pytest.approx(best)
    assert M.choose_threshold(scored, min_recall=1.1).first()["feasible"] is False


def test_degenerate_tables_give_zero(spark):
    only = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, score double")
    row = M.classification_metrics(only, 0.5).first()
    assert row["recall"] == row["precision"] == row["f1"] == 0.0 and row["specificity"] == 1.0
    assert M.roc_auc(only).first()[0] is None


def test_evaluate_is_consistent(scored):
    values = {r["metric"]: r["value"] for r in M.evaluate(scored, 0.45).collect()}
    assert values["balanced_accuracy"] == pytest.approx((values["recall"] + values["specificity"]) / 2)
    assert 0 < values["brier_score"] < 0.5 and values["threshold"] == 0.45


def test_groups_never_straddle_the_split(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 100)
    sides = S.group_split(df, "g", 0.3, "s")
    assert sides.groupBy("g").agg(F.count_distinct("side").alias("n")).where("n > 1").count() == 0
    share = sides.agg(F.avg((F.col("side") == "test").cast("int"))).first()[0]
    assert 0.1 < share < 0.5


def test_exact_splits_and_folds(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    counts = S.stratified_split(df, "y", "id", 0.25, "s", exact=True).groupBy("y", "side").count().collect()
    assert {(r["y"], r["side"]): r["count"] for r in counts} == {(0, "test"): 200, (0, "train"): 600, (1, "test"): 50, (1, "train"): 150}
    folds = S.assign_folds(df, "y", "id", 5, "s", exact=True).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r["y"] == 0} == {160} and {r["count"] for r in folds if r["y"] == 1} == {40}
