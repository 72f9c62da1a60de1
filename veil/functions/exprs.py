"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def r6(column: Column, alias: str) -> Column:
    return F.round(column, 6).alias(alias)


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition on keys in which a null matches a null."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on grouping keys, null-safe, keeping one copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def bin_column(
    value: Column, edges: Sequence[float], labels: Sequence | None = None, closed: str = "left"
) -> Column:
    """Fixed-edge binning; values outside the edges and nulls give null.

    `closed='left'` makes bins [a, b), `closed='right'` makes them (a, b], so with right-closed bins
    the lowest finite edge itself falls out. Labels default to the bin ordinal.
    """
    if closed not in ("left", "right"):
        raise ValueError("closed is 'left' or 'right'")
    names = list(labels) if labels is not None else list(range(len(edges) - 1))
    if len(names) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    out = None
    for lo, hi, name in zip(edges[:-1], edges[1:], names):
        inside = F.lit(True)
        if lo != -inf:
            inside = inside & (value >= lo if closed == "left" else value > lo)
        if hi != inf:
            inside = inside & (value < hi if closed == "left" else value <= hi)
        out = F.when(value.isNotNull() & inside, F.lit(name)) if out is None else out.when(
            value.isNotNull() & inside, F.lit(name)
        )
    return out


def map_values(value: Column, mapping: dict) -> Column:
    """Explicit value map as a `when` chain; unmapped values give null."""
    out = None
    for key, mapped in mapping.items():
        test = value == F.lit(key)
        out = F.when(test, F.lit(mapped)) if out is None else out.when(test, F.lit(mapped))
    return out


def param_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small literal table of parameters."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def explode_values(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Every row once per value of a short literal list (parameter product)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """n evenly spaced literals, rounded to 10 digits so that all engines see the same numbers."""
    return [round(lo + (hi - lo) * i / (n - 1), 10) for i in range(n)]
