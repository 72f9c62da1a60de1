"""l-diversity and t-closeness measures. One aggregate over the classes feeds all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.exprs import join_groups, ratio
from veil.functions.lineage import materialize
from veil.functions.ordered import ranges_for, running_sums


def _distinct_per_class(df: DataFrame, quasi: Sequence[str], attr: str) -> DataFrame:
    """Distinct values by counting pairs first: no class or value is collected anywhere."""
    pairs = df.where(F.col(attr).isNotNull()).groupBy(*quasi, attr).agg(F.lit(1).alias("one"))
    return pairs.groupBy(*quasi).agg(F.count(F.lit(1)).alias(f"l_{attr}"))


def class_diversity(
    df: DataFrame, quasi: Sequence[str], sensitive: Sequence[str], target: str | None = None,
    binary: Sequence[str] | None = None,
) -> DataFrame:
    """Per class: size, distinct values `l_<attr>` of every sensitive attribute, their minimum and the
    target rate.

    Attributes in `binary` (default: all) take two values, so `min <> max` counts them inside the
    single aggregate. Other attributes are counted over (class, value) pairs and joined on the class.
    """
    binary = list(sensitive) if binary is None else list(binary)

    def flag_diversity(c: str) -> Column:
        none = F.count(c) == 0
        return F.when(none, 0).when(F.min(c) == F.max(c), 1).otherwise(2).cast("bigint").alias(f"l_{c}")

    rate = [F.avg(target).alias("target_rate")] if target else []
    classes = df.groupBy(*quasi).agg(
        F.count(F.lit(1)).alias("k"), *[flag_diversity(c) for c in sensitive if c in binary], *rate
    )
    for attr in sensitive:
        if attr not in binary:
            classes = join_groups(classes, _distinct_per_class(df, quasi, attr), quasi, "left").withColumn(
                f"l_{attr}", F.coalesce(f"l_{attr}", F.lit(0))
            )
    ls = [F.col(f"l_{c}") for c in sensitive]
    return classes.withColumn("min_l", F.least(*ls) if len(ls) > 1 else ls[0])


def _percent(condition: Column) -> Column:
    return F.round(100 * ratio(F.sum(F.when(condition, F.col("k")).otherwise(0)), F.sum("k")), 6)


def compliance(classes: DataFrame, l: int = 2) -> DataFrame:
    ok = F.col("min_l") >= l
    return classes.agg(
        F.count(F.lit(1)).alias("n_classes"), F.count_if(~ok).alias("n_failing"), F.count_if(ok).alias("n_passing"),
        _percent(~ok).alias("pct_records_failing"), _percent(ok).alias("pct_records_passing"),
    )


def compliance_by_attribute(classes: DataFrame, sensitive: Sequence[str], l: int = 2) -> DataFrame:
    """Per attribute: failing and passing classes and the percentage of records that pass."""
    cells = []
    for c in sensitive:
        ok = F.col(f"l_{c}") >= l
        cells.append(
            F.struct(
                F.lit(c).alias("attribute"), F.count_if(~ok).alias("n_failing"), F.count_if(ok).alias("n_passing"),
                _percent(ok).alias("pct_records_passing"),
            ).alias(c)
        )
    return classes.agg(*cells).select(F.inline(F.array(*sensitive)))


def largest_failing(classes: DataFrame, quasi: Sequence[str], l: int = 2, n: int = 10) -> DataFrame:
    return classes.where(F.col("min_l") < l).orderBy(F.desc("k"), *quasi).limit(n)


def diversity_levels(classes: DataFrame) -> DataFrame:
    """Classes and records per minimum diversity, with the share of classes."""
    levels = classes.groupBy("min_l").agg(F.count(F.lit(1)).alias("n_classes"), F.sum("k").alias("n_records"))
    total = levels.agg(F.sum("n_classes").alias("t"))
    return levels.withColumn("pct_classes", F.round(100 * ratio(F.col("n_classes"), total.scalar()), 6))


def rate_distance(classes: DataFrame, t: float = 0.2, overall: float | None = None) -> DataFrame:
    """Distance of the class target rate from the global rate, and whether it is within t.

    The global rate is that of the given classes, or `overall`, say of a population they are a part of.
    """
    classes = materialize(classes, "classes")
    if overall is None:
        rate = classes.agg(ratio(F.sum(F.col("target_rate") * F.col("k")), F.sum("k")).alias("g")).scalar()
    else:
        rate = F.lit(float(overall))
    distance = F.round(F.abs(F.col("target_rate") - F.col("__g")), 9)
    return classes.withColumn("__g", rate).withColumn("distance", distance).withColumn("t_close", F.col("distance") <= t).drop("__g")


def frequency_distance(df: DataFrame, quasi: Sequence[str], attr: str, ranges: int | None = None) -> DataFrame:
    """Largest pointwise difference between class and global frequencies of a categorical attribute.

    A level that a class lacks counts with frequency 0; rows without a value count in the totals.
    """
    cells = materialize(df.groupBy(*quasi, attr).agg(F.count(F.lit(1)).alias("n")), "cells")
    levels = materialize(rank_levels(cells, attr, "n", ranges), "levels")
    # a class has at most one cell per level
    ranges = ranges or (1 if ranges_for(levels.count()) == 1 else None)
    return frequency_distance_from_counts(cells, levels, quasi, attr, "n", ranges)


def rank_levels(cells: DataFrame, attr: str, n: str, ranges: int | None = None) -> DataFrame:
    """(level, rank by descending share, global share) of the non-null levels; ties by value."""
    total = cells.agg(F.sum(n).cast("double").alias("t"))
    shares = cells.where(F.col(attr).isNotNull()).groupBy(attr).agg(F.sum(n).alias("__g"))
    reverse = F.lpad((F.lit(10**18) - F.col("__g")).cast("string"), 19, "0")
    ordered = shares.withColumn("__order", F.concat_ws("|", reverse, F.col(attr).cast("string"))).withColumn("__one", F.lit(1))
    return running_sums(ordered, "__order", ["__one"], ranges=ranges).select(
        F.col(attr).alias("level"), F.col("cum___one").alias("level_rank"),
        ratio(F.col("__g"), total.scalar()).alias("global_share"),
    )


def frequency_distance_from_counts(
    cells: DataFrame, levels: DataFrame, by: Sequence[str], attr: str, n: str, ranges: int | None = None
) -> DataFrame:
    """`frequency_distance` from a (by, attr, count) table and the ranked global levels.

    No class x level grid is built. The largest share among the levels that a class lacks is the
    share of the first gap in its ranks: with its levels in rank order, the gap is the first position
    that is not the rank of the level at it.
    """
    totals = cells.groupBy(*by).agg(F.sum(n).alias("__n"))
    present = join_groups(cells.where(F.col(attr).isNotNull()), totals, by).join(levels, F.col(attr) == F.col("level"))
    own = F.abs(ratio(F.col(n), F.col("__n")) - F.col("global_share"))
    spots = present.select(*by, "level_rank", own.alias("__d"), F.lit(1).alias("__one"))
    placed = running_sums(spots, "level_rank", ["__one"], by, ranges=ranges)
    place = F.col("cum___one")
    per_class = placed.groupBy(*by).agg(
        F.max("__d").alias("__present"),
        F.coalesce(F.min(F.when(F.col("level_rank") > place, place)), F.max(place) + 1).alias("__gap"),
    )
    gaps = levels.select(F.col("level_rank").alias("__gap_rank"), F.col("global_share").alias("__missing"))
    joined = per_class.join(gaps, F.col("__gap") == F.col("__gap_rank"), "left")
    worst = F.greatest(F.col("__present"), F.coalesce("__missing", F.lit(0.0)))
    return joined.select(*by, worst.alias("distance"))


def closeness_summary(classes: DataFrame, t: float = 0.2) -> DataFrame:
    """Classes within t, their percentage and the percentage of records in them."""
    close = F.col("distance") <= t
    return classes.agg(
        F.count(F.lit(1)).alias("n_classes"), F.count_if(close).alias("n_close"),
        F.round(100 * ratio(F.count_if(close), F.count(F.lit(1))), 6).alias("pct_classes_close"),
        _percent(close).alias("pct_records_close"),
    )


def closeness_violations(classes: DataFrame, quasi: Sequence[str], t: float = 0.2, n: int = 10) -> DataFrame:
    return classes.where(F.col("distance") > t).orderBy(F.desc("k"), *quasi).limit(n)


def distribution_shift(df: DataFrame, before: str, after: str) -> DataFrame:
    """Total variation distance between two versions of a column: half the L1 norm of the shares."""
    return total_variation(df.select(F.col(before).alias("v")), df.select(F.col(after).alias("v")), "v")


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n").alias("t"))
        return counts.select(F.col("v"), ratio(F.col("n"), total.scalar()).alias(name))

    both = shares(a, "p").join(shares(b, "q"), "v", "full_outer")
    gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return both.agg(F.round(F.coalesce(F.sum(gap), F.lit(0.0)) / 2, 6).alias("tvd"))


def scorecard(before: DataFrame, after: DataFrame, diversity: DataFrame, k: int = 5, l: int = 2) -> DataFrame:
    """(metric, before, after) over k, l and t. `diversity` carries `distance` and `t_close` per class.

    l and t are not defined before generalization and are null there.
    """
    from veil.operators.risk import compare_stages

    stages = compare_stages({"before": before, "after": after}, k)
    long = stages.select(
        "stage",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v"))
                    for m, c in (("min_k", "min_k"), ("median_k", "median"), ("classes_below_k", "n_below_k"),
                                 ("pct_records_at_risk", "pct_records_at_risk"))
                ]
            )
        ),
    )
    sizes = long.groupBy("metric").agg(
        F.max(F.when(F.col("stage") == "before", F.col("v"))).alias("before"),
        F.max(F.when(F.col("stage") == "after", F.col("v"))).alias("after"),
    )
    ok = F.col("min_l") >= l
    guarantees = diversity.agg(
        F.count_if(~ok).alias("classes_failing_l"), F.count_if(ok).alias("classes_passing_l"),
        F.count_if("t_close").alias("classes_t_close"),
    ).unpivot([], ["classes_failing_l", "classes_passing_l", "classes_t_close"], "metric", "v")
    return sizes.unionByName(
        guarantees.select("metric", F.lit(None).cast("double").alias("before"), F.col("v").cast("double").alias("after"))
    )


def compliance_scores(diversity: DataFrame, epsilon: float, l: int = 2) -> DataFrame:
    """Scores in [0, 1]: k/100, share of classes that are l-diverse, share t-close, 1/epsilon."""
    n = F.count(F.lit(1))
    wide = diversity.agg(
        F.least(ratio(F.min("k"), F.lit(100)), F.lit(1.0)).alias("k_anonymity"),
        ratio(F.count_if(F.col("min_l") >= l), n).alias("l_diversity"),
        ratio(F.count_if("t_close"), n).alias("t_closeness"),
        F.least(F.lit(1.0 / epsilon), F.lit(1.0)).alias("differential_privacy"),
    )
    names = ["k_anonymity", "l_diversity", "t_closeness", "differential_privacy"]
    return wide.unpivot([], names, "technique", "score").select("technique", F.round("score", 6).alias("score"))
