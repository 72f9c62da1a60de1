"""Evaluation of scored tables (label, score) as DataFrame aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.exprs import ratio
from veil.functions.lineage import materialize
from veil.functions.ordered import running_sums


def zero_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Measures of a confusion matrix; undefined ones are 0."""
    recall, precision, specificity = zero_ratio(tp, tp + fn), zero_ratio(tp, tp + fp), zero_ratio(tn, tn + fp)
    return {
        "accuracy": zero_ratio(tp + tn, tp + fp + tn + fn),
        "recall": recall,
        "precision": precision,
        "specificity": specificity,
        "balanced_accuracy": (recall + specificity) / 2,
        "f1": zero_ratio(2 * tp, 2 * tp + fp + fn),
        "f2": zero_ratio(5 * tp, 5 * tp + 4 * fn + fp),
    }


def _position(score: Column, thresholds: Sequence[float], lo: int = 0, hi: int | None = None) -> Column:
    """Number of thresholds <= score, as a balanced tree of comparisons."""
    hi = len(thresholds) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(score >= F.lit(float(thresholds[mid])), _position(score, thresholds, mid + 1, hi)).otherwise(
        _position(score, thresholds, lo, mid)
    )


def threshold_table(scored: DataFrame, thresholds: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tp, fp, tn, fn) for every threshold from one histogram.

    Rows are counted into at most len(thresholds) + 1 buckets; the suffix sums run over those.
    """
    bucket = _position(F.col(score), thresholds).alias("bucket")
    hist = scored.groupBy(bucket).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    frame = scored.sparkSession.createDataFrame(
        [(i, float(t)) for i, t in enumerate([float("-inf"), *thresholds])], "bucket int, threshold double"
    )
    full = frame.join(hist, "bucket", "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    tp, fp = F.sum("pos").over(above), F.sum("neg").over(above)
    return full.select(
        "bucket", "threshold", tp.alias("tp"), fp.alias("fp"), (F.sum("neg").over(everything) - fp).alias("tn"),
        (F.sum("pos").over(everything) - tp).alias("fn"),
    ).where(F.col("bucket") > 0).drop("bucket")


def percent_thresholds(lo: int, hi: int) -> list[float]:
    """lo/100 .. hi/100."""
    return [i / 100 for i in range(lo, hi + 1)]


def choose_threshold(scored: DataFrame, min_recall: float = 0.8, thresholds: Sequence[float] | None = None, **cols) -> DataFrame:
    """Highest accuracy among thresholds with enough recall, else highest balanced accuracy; lowest first."""
    table = threshold_table(scored, thresholds or percent_thresholds(1, 99), **cols)
    m = rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    ok = m["recall"] >= min_recall
    best = table.withColumns({c: m[c] for c in ("accuracy", "recall", "balanced_accuracy")}).withColumn("feasible", ok)
    goal = F.when(F.col("feasible"), F.col("accuracy")).otherwise(F.col("balanced_accuracy"))
    return best.orderBy(F.desc("feasible"), goal.desc(), "threshold").limit(1).select(
        "threshold", "accuracy", "recall", "balanced_accuracy", "feasible"
    )


def best_threshold(scored: DataFrame, metric: str, thresholds: Sequence[float], **cols) -> DataFrame:
    """Threshold with the highest f1, f2 or recall, the lowest of equals."""
    table = threshold_table(scored, thresholds, **cols)
    m = rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return table.withColumn("value", m[metric]).orderBy(F.desc("value"), "threshold").limit(1).select("threshold", "value")


def confusion(scored: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row (tp, fp, tn, fn)."""
    y, hit = F.col(label) == 1, F.col(score) >= F.lit(float(threshold))
    return scored.agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(~y & ~hit).alias("tn"), F.count_if(y & ~hit).alias("fn")
    )


def confusion_by_score(scored: DataFrame, scores: dict[str, Column], threshold: float, label: str = "label") -> DataFrame:
    """(variant, tp, fp, tn, fn) of several scores of the same rows, from one pass over them."""
    y, cells = F.col(label) == 1, []
    for name, value in scores.items():
        hit = value >= F.lit(float(threshold))
        cells.append(
            F.struct(F.lit(name).alias("variant"), F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
                     F.count_if(~y & ~hit).alias("tn"), F.count_if(y & ~hit).alias("fn")).alias(name)
        )
    return scored.agg(*cells).select(F.inline(F.array(*[F.col(f"`{name}`") for name in scores])))


def confusion_cells(scored: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """The same as cells (label, predicted, n), empty cells included."""
    wide = confusion(scored, threshold, label, score)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("predicted"), F.col(c).alias("n")) for a, b, c in cells]))
    )


def classification_metrics(scored: DataFrame, threshold: float, **cols) -> DataFrame:
    """One row of measures at a threshold, unrounded."""
    m = rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return confusion(scored, threshold, **cols).select(*[c.alias(name) for name, c in m.items()])


def _score_counts(scored: DataFrame, label: str, score: str, ranges: int | None) -> DataFrame:
    """Per distinct score: positives, negatives and their running and grand totals, ascending."""
    counts = scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    return running_sums(counts, "score", ["pos", "neg"], ranges=ranges)


def _auc() -> Column:
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    return ratio(F.sum(F.col("pos") * below), F.max("total_pos").cast("double") * F.max("total_neg"))


def _average_precision() -> Column:
    hits = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    flagged = hits + F.col("total_neg") - F.col("cum_neg") + F.col("neg")
    return ratio(F.sum(F.col("pos") * ratio(hits, flagged)), F.max("total_pos"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", ranges: int | None = None) -> DataFrame:
    """Area under the ROC curve as the Mann-Whitney statistic with averaged ties."""
    grouped = _score_counts(scored, label, score, ranges)
    return grouped.agg(_auc().alias("roc_auc"))


def average_precision(scored: DataFrame, label: str = "label", score: str = "score", ranges: int | None = None) -> DataFrame:
    """Sum of precision times recall step over descending distinct scores (no interpolation)."""
    return _score_counts(scored, label, score, ranges).agg(_average_precision().alias("pr_auc"))


def ranking_metrics(scored: DataFrame, label: str = "label", score: str = "score", ranges: int | None = None) -> DataFrame:
    """(roc_auc, pr_auc) from one sorted pass."""
    grouped = _score_counts(scored, label, score, ranges)
    return grouped.agg(_auc().alias("roc_auc"), _average_precision().alias("pr_auc"))


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score", ranges: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the origin with a null threshold."""
    grouped = _score_counts(scored, label, score, ranges)
    hits = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    alarms = F.col("total_neg") - F.col("cum_neg") + F.col("neg")
    points = grouped.select(
        F.col("score").alias("threshold"), ratio(alarms, F.col("total_neg")).alias("fpr"), ratio(hits, F.col("total_pos")).alias("tpr")
    )
    origin = scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(origin)


def brier_score(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    gap = F.col(score) - F.col(label)
    return scored.agg(F.avg(gap * gap).alias("brier_score"))


def calibration_curve(scored: DataFrame, bins: int = 10, label: str = "label", score: str = "score") -> DataFrame:
    """Mean score and observed rate per uniform bin with right-closed inner edges; empty bins are absent."""
    inner = [i / bins for i in range(1, bins)]
    # number of inner edges < score
    index = F.lit(0)
    for edge in inner:
        index = index + (F.col(score) > F.lit(edge)).cast("int")
    return scored.groupBy(index.alias("bin")).agg(
        F.avg(score).alias("mean_score"), F.avg(label).alias("observed_rate"), F.count(F.lit(1)).alias("n")
    )


def class_report(scored: DataFrame, threshold: float, **cols) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and support-weighted averages."""
    wide = confusion(scored, threshold, **cols)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    one = (zero_ratio(tp, tp + fp), zero_ratio(tp, tp + fn), zero_ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    zero = (zero_ratio(tn, tn + fn), zero_ratio(tn, tn + fp), zero_ratio(2 * tn, 2 * tn + fp + fn), tn + fp)
    total = tp + fp + tn + fn
    names = ("precision", "recall", "f1", "support")

    def row(name: str, values) -> Column:
        return F.struct(F.lit(name).alias("row_name"), *[v.alias(n) for n, v in zip(names, values)])

    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])] + [total]
    weighted = [zero_ratio(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])] + [total]
    return wide.select(F.inline(F.array(row("showed", zero), row("no_show", one), row("macro avg", macro), row("weighted avg", weighted))))


def workload(scored: DataFrame, threshold: float, **cols) -> DataFrame:
    """Flagged rows, their percentage and the percentage of all rows flagged for nothing."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    flagged_pct = 100 * zero_ratio(tp + fp, total)
    return confusion(scored, threshold, **cols).select(
        (tp + fp).alias("flagged_count"), flagged_pct.alias("flagged_pct"),
        (flagged_pct * (1 - zero_ratio(tp, tp + fp))).alias("wasted_pct"),
    )


def evaluate(scored: DataFrame, threshold: float, **cols) -> DataFrame:
    """All measures of a scored table in long form (metric, value).

    Scores come out of model transforms, so they are written once before the several aggregates.
    """
    scored = materialize(scored, "scores")
    one_row = classification_metrics(scored, threshold, **cols).select(F.struct("*").alias("c"))
    ranks = ranking_metrics(scored, **cols).select(F.struct("*").alias("r"))
    flagged = workload(scored, threshold, **cols).select(F.struct("*").alias("w"))
    wide = brier_score(scored, **cols).select(
        "brier_score", one_row.scalar().alias("c"), ranks.scalar().alias("r"), flagged.scalar().alias("w")
    ).select("c.*", "r.*", "brier_score", F.col("w.flagged_pct"), F.col("w.wasted_pct"), F.lit(float(threshold)).alias("threshold"))
    return wide.unpivot([], wide.columns, "metric", "value")


def comparison_table(metrics: DataFrame, names: Sequence[str], digits: int = 3) -> DataFrame:
    """(dataset, model) rows with one rounded column per metric, from (dataset, model, metric, value)."""
    return metrics.groupBy("dataset", "model").agg(
        *[F.round(F.max(F.when(F.col("metric") == n, F.col("value"))), digits).alias(n) for n in names]
    )


def utility_loss(metrics: DataFrame, protected: str, baseline: str) -> DataFrame:
    """Loss per model and metric in points and in percent of the baseline."""
    sides = metrics.where(F.col("dataset").isin(protected, baseline)).groupBy("model", "metric").agg(
        F.max(F.when(F.col("dataset") == protected, F.col("value"))).alias("p"),
        F.max(F.when(F.col("dataset") == baseline, F.col("value"))).alias("b"),
    )
    gap = F.col("b") - F.col("p")
    return sides.select(
        "model", "metric", F.round(100 * gap, 6).alias("loss_points"), F.round(100 * ratio(gap, F.col("b")), 6).alias("loss_pct")
    )


def mean_loss(losses: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean relative loss per model over some metrics."""
    chosen = losses.where(F.col("metric").isin(*metrics))
    return chosen.groupBy("model").agg(F.round(F.avg("loss_pct"), 6).alias("mean_loss_pct"))


def best_model(metrics: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Model with the highest metric per dataset, ties by name."""
    chosen = metrics.where(F.col("metric") == metric)
    return chosen.groupBy("dataset").agg(
        F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("model"), F.round(F.max("value"), 6).alias("value")
    )
