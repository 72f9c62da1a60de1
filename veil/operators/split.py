"""Leak-free splits, folds and class weights from keyed draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.exprs import ratio
from veil.functions.ordered import ranked_by_uniform
from veil.functions.rand import salt, uniform


def _side(test: Column) -> Column:
    return F.when(test, "test").otherwise("train")


def group_split(df: DataFrame, group: str, test_size: float, seed: str, out: str = "side") -> DataFrame:
    """Adds train/test by a draw per group, so no group is on both sides. A narrow projection."""
    return df.withColumn(out, _side(uniform(salt(seed, "group"), group) < F.lit(test_size)))


def stratified_split(
    df: DataFrame, label: str, key: str, test_size: float, seed: str, exact: bool = False, out: str = "side"
) -> DataFrame:
    """Adds train/test drawn per label.

    The draw is compared with the test share, which keeps the stage narrow. `exact` ranks the draws
    inside each label instead, so every label has the rounded share in the test side.
    """
    u = uniform(salt(seed, "split"), F.col(label), F.col(key))
    if not exact:
        return df.withColumn(out, _side(u < F.lit(test_size)))
    ranked = ranked_by_uniform(df.withColumn("__u", u), "__u", key, [label])
    return ranked.withColumn(out, _side(F.col("rank") <= F.round(F.col("group_size") * F.lit(test_size)))).drop(
        "__u", "rank", "group_size"
    )


def assign_folds(df: DataFrame, label: str, key: str, k: int, seed: str, exact: bool = False, out: str = "fold") -> DataFrame:
    """Adds a fold in 0..k-1, balanced per label: by draw, or exactly by rank of the draw."""
    u = uniform(salt(seed, "fold"), F.col(label), F.col(key))
    if not exact:
        return df.withColumn(out, F.floor(u * k).cast("int"))
    ranked = ranked_by_uniform(df.withColumn("__u", u), "__u", key, [label])
    return ranked.withColumn(out, F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("__u", "rank", "group_size")


def split_report(df: DataFrame, side: str, group: str, label: str) -> DataFrame:
    """Rows, distinct groups and target rate per side.

    Groups are deduplicated by an aggregate on (side, group) first, so a group with very many rows
    is one row when groups are counted.
    """
    groups = df.groupBy(side, group).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("hits"))
    return groups.groupBy(side).agg(
        F.sum("n").alias("n_rows"), F.count(group).alias("n_groups"), F.round(ratio(F.sum("hits"), F.sum("n")), 6).alias("target_rate")
    )


def class_weights(df: DataFrame, label: str, positive_weight: float | None = None, out: str = "weight") -> DataFrame:
    """Adds balanced weights n / (2 n_class), or a fixed weight of the positive class."""
    if positive_weight is not None:
        return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(1.0))
    n, ones = F.count(label), F.count_if(F.col(label) == 1)
    pair = df.agg(F.struct(ratio(n, 2 * ones).alias("one"), ratio(n, 2 * (n - ones)).alias("zero")).alias("w"))
    return df.withColumn("__w", pair.scalar()).withColumn(
        out, F.when(F.col(label) == 1, F.col("__w.one")).otherwise(F.col("__w.zero"))
    ).drop("__w")
