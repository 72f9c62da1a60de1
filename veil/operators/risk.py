"""k-anonymity: equivalence classes over quasi-identifiers and re-identification risk."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.exprs import join_groups, ratio
from veil.functions.lineage import materialize
from veil.functions.ordered import quantiles_from_counts
from veil.operators.profile import histogram


def class_sizes(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """Rows per equivalence class; rows with a null quasi-identifier form classes of their own."""
    return df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("k"))


def risk_profile(classes: DataFrame, k: int = 5) -> DataFrame:
    """Classes, singletons, classes below k and the percentage of records in them."""
    small = F.col("k") < k
    return classes.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.count_if(F.col("k") == 1).alias("n_singletons"),
        F.count_if(small).alias("n_below_k"),
        F.round(100 * ratio(F.sum(F.when(small, F.col("k")).otherwise(0)), F.sum("k")), 6).alias("pct_records_at_risk"),
    )


def riskiest(classes: DataFrame, quasi: Sequence[str], n: int = 10) -> DataFrame:
    return classes.orderBy("k", *quasi).limit(n)


def _size_summary(classes: DataFrame, k: int) -> DataFrame:
    """All size measures from one aggregate over (size, number of classes of that size).

    Distinct sizes of n rows add up to at most n, so there are fewer than sqrt(2n) of them (under a
    million for 10^11 rows) and one window can rank them.
    """
    counts = classes.groupBy(F.col("k").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("records", F.col("value") * F.col("n"))
    size, n = F.col("value"), F.col("n")
    mean = F.col("total_records") / F.col("total_n")
    squares = F.sum(n * F.pow(size - mean, F.lit(2.0)))
    small = F.sum(F.when(size < k, F.col("records")).otherwise(0.0))
    extra = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_classes"), F.round(F.max(mean), 6).alias("mean"),
        F.round(F.sqrt(ratio(squares, F.sum(n) - 1)), 6).alias("std"),
        F.min("value").cast("bigint").alias("min_k"), F.max("value").cast("bigint").alias("max_k"),
        F.coalesce(F.sum(F.when(size == 1, n).otherwise(0)), F.lit(0)).alias("n_singletons"),
        F.coalesce(F.sum(F.when(size < k, n).otherwise(0)), F.lit(0)).alias("n_below_k"),
        F.round(100 * ratio(small, F.sum("records")), 6).alias("pct_records_at_risk"),
    ]
    quartiles = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    out = quantiles_from_counts(counts, "value", "n", quartiles, ranges=1, sums=["records"], extra=extra)
    return out.withColumns({q: F.round(q, 6) for q in quartiles})


def size_distribution(classes: DataFrame) -> DataFrame:
    """Summary of class sizes."""
    return _size_summary(classes, 5).select("n_classes", "mean", "std", "min_k", "q25", "median", "q75", "max_k")


def size_histogram(classes: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(classes, "k", bins)


def compare_stages(stages: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """Risk profile and size distribution per stage, e.g. before and after generalization."""
    measures = ["n_classes", "min_k", "median", "max_k", "n_singletons", "n_below_k", "pct_records_at_risk"]
    rows = [_size_summary(classes, k).select(F.lit(name).alias("stage"), *measures) for name, classes in stages.items()]
    return reduce(DataFrame.unionByName, rows)


def record_risk(df: DataFrame, quasi: Sequence[str], k: int = 5) -> DataFrame:
    """Every record with the size of its class, its risk 1/size and whether the class is below k.

    Class sizes are written first, so the join back knows their size and moves no row when there are
    few classes. A window over a class would put the largest class into one task.
    """
    joined = join_groups(df, materialize(class_sizes(df, quasi), "sizes"), quasi)
    return joined.withColumn("risk", F.round(ratio(F.lit(1), F.col("k")), 6)).withColumn("at_risk", F.col("k") < k)
