"""Correlation and cross-tabulation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.exprs import ratio
from veil.functions.lineage import materialize
from veil.functions.ordered import quantiles_from_counts


def correlation_matrix(df: DataFrame, columns: Sequence[str], triangle: bool = False) -> DataFrame:
    """Pearson correlations in long form (feature_a, feature_b, corr) from one aggregate.

    `triangle` keeps the pairs below the diagonal only.
    """
    pairs = list(combinations(range(len(columns)), 2))
    wide = df.agg(*[F.corr(columns[i], columns[j]).alias(f"{i}_{j}") for i, j in pairs])
    entries = []
    for i, j in pairs:
        value = F.round(F.col(f"{i}_{j}"), 6)
        entries.append(F.struct(F.lit(columns[j]).alias("feature_a"), F.lit(columns[i]).alias("feature_b"), value.alias("corr")))
        if not triangle:
            entries.append(F.struct(F.lit(columns[i]).alias("feature_a"), F.lit(columns[j]).alias("feature_b"), value.alias("corr")))
    if not triangle:
        entries += [F.struct(F.lit(c).alias("feature_a"), F.lit(c).alias("feature_b"), F.lit(1.0).alias("corr")) for c in columns]
    return wide.select(F.inline(F.array(*entries)))


def target_correlation(df: DataFrame, features: Sequence[str], target: str, top: int | None = None) -> DataFrame:
    """Correlation of every feature with the target, strongest first, with its direction."""
    wide = df.agg(*[F.corr(c, target).alias(c) for c in features])
    long = wide.unpivot([], list(features), "feature", "corr")
    direction = F.when(F.col("corr") > 0, "UP").otherwise("DOWN")
    ranked = long.select("feature", F.round("corr", 6).alias("corr"), direction.alias("direction"))
    ranked = ranked.orderBy(F.abs("corr").desc_nulls_last(), "feature")
    return ranked.limit(top) if top else ranked


def mean_pivot(df: DataFrame, rows: str, columns: str, values: Sequence, measure: str, prefix: str, factor: float = 1.0) -> DataFrame:
    """Mean of a measure per row group, one column per listed value of `columns`."""
    cells = [
        F.round(factor * F.avg(F.when(F.col(columns) == F.lit(v), F.col(measure))), 6).alias(f"{prefix}{v}") for v in values
    ]
    return df.where(F.col(rows).isNotNull()).groupBy(rows).agg(*cells)


def condition_rates(df: DataFrame, conditions: Sequence[str], target: str, at_least_one: bool = False) -> DataFrame:
    """Target rate in percent without and with each condition (`== 1`, or `>= 1`); one aggregate."""
    cells = []
    for c in conditions:
        has = F.col(c) >= 1 if at_least_one else F.col(c) == 1
        cells += [F.avg(F.when(F.col(c) == 0, F.col(target))).alias(f"{c}__0"), F.avg(F.when(has, F.col(target))).alias(f"{c}__1")]
    wide = df.agg(*cells)
    entries = [
        F.struct(
            F.lit(c).alias("condition"),
            F.round(100 * F.col(f"{c}__0"), 6).alias("rate_without"),
            F.round(100 * F.col(f"{c}__1"), 6).alias("rate_with"),
        )
        for c in conditions
    ]
    return wide.select(F.inline(F.array(*entries)))


def rate_by(df: DataFrame, group: Column | str, target: str, name: str | None = None) -> DataFrame:
    """Target rate in percent and row count per group; rows without a group are left out."""
    column = F.col(group) if isinstance(group, str) else group
    alias = name or group
    return (
        df.select(column.alias(alias), target)
        .where(F.col(alias).isNotNull())
        .groupBy(alias)
        .agg(F.round(100 * F.avg(target), 6).alias("rate_pct"), F.count(F.lit(1)).alias("n"))
    )


def rate_in_top(df: DataFrame, column: str, target: str, k: int = 10) -> DataFrame:
    """Rates of the k most frequent values next to the overall rate."""
    groups = (
        df.where(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("__hits"))
    )
    rate = F.round(100 * ratio(F.sum("__hits"), F.sum("n")), 6)
    return groups.orderBy(F.desc("n"), column).limit(k).select(
        column, F.round(100 * ratio(F.col("__hits"), F.col("n")), 6).alias("rate_pct"), "n",
        groups.agg(rate.alias("r")).scalar().alias("overall_rate_pct"),
    )


def group_profile(df: DataFrame, group: str, target: str, age: str, conditions: Sequence[str]) -> DataFrame:
    """Rate, count, mean age and condition rates per group, unrounded."""
    return df.groupBy(group).agg(
        F.avg(target).alias("noshow_rate"),
        F.count(F.lit(1)).alias("n"),
        F.avg(age).alias("avg_age"),
        *[F.avg(c).alias(f"{c}_rate") for c in conditions],
    )


def group_extremes(profile: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """Groups with the highest and lowest value of each measure, and the range; ties by group."""
    cells = []
    for m in measures:
        cells += [
            F.min_by(group, F.struct(-F.col(m), F.col(group))).alias(f"{m}__hg"),
            F.min_by(group, F.struct(F.col(m), F.col(group))).alias(f"{m}__lg"),
            F.max(m).alias(f"{m}__h"), F.min(m).alias(f"{m}__l"),
        ]
    entries = [
        F.struct(
            F.lit(m).alias("measure"), F.col(f"{m}__hg").alias("highest_group"), F.col(f"{m}__lg").alias("lowest_group"),
            F.round(f"{m}__h", 6).alias("highest"), F.round(f"{m}__l", 6).alias("lowest"),
            F.round(F.col(f"{m}__h") - F.col(f"{m}__l"), 6).alias("value_range"),
        )
        for m in measures
    ]
    return profile.agg(*cells).select(F.inline(F.array(*entries)))


def group_correlation(profile: DataFrame, a: str, b: str) -> DataFrame:
    return profile.agg(F.round(F.corr(a, b), 6).alias("group_corr"))


def median_halves(df: DataFrame, profile: DataFrame, group: str, measure: str, bin_col: str) -> DataFrame:
    """Share of every bin inside the groups at or above and below the median of a group measure."""
    profile = materialize(profile, "profile")
    counts = profile.groupBy(measure).agg(F.count(F.lit(1)).alias("n"))
    median = quantiles_from_counts(counts, measure, "n", {"m": 0.5})
    halves = profile.withColumn("__m", median.scalar()).select(
        F.col(group).alias("__g"), F.when(F.col(measure) >= F.col("__m"), "high").otherwise("low").alias("half")
    )
    rows = df.where(F.col(bin_col).isNotNull()).groupBy(group, bin_col).agg(F.count(F.lit(1)).alias("n"))
    cells = rows.join(halves, F.col(group) == F.col("__g")).groupBy("half", bin_col).agg(F.sum("n").alias("n"))
    totals = cells.groupBy("half").agg(F.sum("n").alias("__t"))
    return cells.join(totals, "half").select("half", bin_col, "n", F.round(ratio(F.col("n"), F.col("__t")), 6).alias("share"))


def children_of(df: DataFrame, parent: str, child: str, target: str, k: int = 5) -> DataFrame:
    """Per parent: distinct children, rows, the k most frequent children and the target rate.

    Rows are first counted per (parent, child), so a parent that holds a third of all rows is a few
    rows when its children are ranked; only the k best survive the ranking.
    """
    pairs = df.groupBy(parent, child).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("hits"))
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(F.desc("n"), child))
    top = (
        pairs.withColumn("__rank", rank).where(F.col("__rank") <= k)
        .groupBy(parent)
        .agg(F.array_sort(F.collect_list(F.struct("__rank", child))).alias("__c"))
        .select(F.col(parent).alias("__p"), F.array_join(F.transform("__c", lambda s: s[child]), ",").alias("top_children"))
    )
    totals = pairs.groupBy(parent).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n").alias("n"), F.round(ratio(F.sum("hits"), F.sum("n")), 6).alias("rate")
    )
    return totals.join(top, F.col(parent) == F.col("__p")).drop("__p")


def largest_groups(profile: DataFrame, group: str, measure: str, size: str, colour: str, k: int) -> DataFrame:
    """The k groups with the largest measure, a size scaled to the largest group and a min-max colour."""
    profile = materialize(profile, "profile")
    ends = profile.agg(F.struct(F.max(size).alias("size")).alias("s"))
    top = profile.orderBy(F.desc(measure), group).limit(k)
    span = top.agg(F.struct(F.min(colour).alias("lo"), F.max(colour).alias("hi")).alias("c"))
    shade = ratio(F.col(colour) - F.col("c.lo"), F.col("c.hi") - F.col("c.lo"))
    return top.withColumn("s", ends.scalar()).withColumn("c", span.scalar()).select(
        group, F.round(measure, 6).alias(measure),
        F.round(ratio(F.col(size), F.col("s.size")) * 1000, 6).alias("bubble_size"),
        F.round(shade, 6).alias("colour_scale"),
    )
