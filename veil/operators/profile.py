"""Profiling: missing values, summaries, frequencies, histograms, densities, column roles."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veil.functions.exprs import join_groups, ratio
from veil.functions.lineage import materialize
from veil.functions.ordered import (
    column_sketches, exact_quantiles, quantiles_from_counts, ranges_for, running_sums, value_counts_long,
)

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def missing_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage per column and whether any column has nulls; one aggregate."""
    columns = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    long = wide.withColumn("any_missing", total > 0).unpivot(
        ["__rows", "any_missing"], columns, "column_name", "missing_count"
    )
    percent = F.round(100 * ratio(F.col("missing_count"), F.col("__rows")), 6)
    return long.select("column_name", "missing_count", percent.alias("missing_pct"), "any_missing")


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of every set of equal rows."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """count, mean, std (n-1), min, quartiles (linear interpolation) and max per column."""
    sketches = column_sketches(df, columns, QUARTILES)
    moments = [(c, *[sketches[c][m] for m in ("n", "mean", "std", "min", "max")]) for c in columns]
    table = df.sparkSession.createDataFrame(moments, "column_name string, count bigint, mean double, std double, min double, max double")
    out = table.join(exact_quantiles(df, columns, QUARTILES, sketches, ranges), "column_name", "left")
    return out.select(
        "column_name", "count",
        *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")],
    )


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share of every value of every column, with the column's distinct count.

    Nulls are not counted, as in a value count.
    """
    counts = materialize(value_counts_long(df, columns, "string"), "frequencies")
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("__t"), F.count(F.lit(1)).alias("n_distinct"))
    return counts.join(totals, "column_name").select(
        "column_name", "value", "n", F.round(ratio(F.col("n"), F.col("__t")), 6).alias("share"), "n_distinct"
    )


def mixed_summary(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Numeric summary plus count / unique / top / freq of categorical columns in one table."""
    counts = value_counts_long(df, categorical, "string")
    text = counts.groupBy("column_name").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )
    return numeric_summary(df, numeric).unionByName(text, allowMissingColumns=True)


def data_card(df: DataFrame, time_col: str, positive, cardinality: str, n_columns: int | None = None) -> DataFrame:
    """Rows, columns, time span in days, positive rate in percent and the cardinality of one column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_columns or len(df.columns)).alias("n_columns"),
        F.datediff(F.max(time_col), F.min(time_col)).alias("time_span_days"),
        F.round(100 * F.avg(positive.cast("int")), 2).alias("target_rate_pct"),
        F.count_distinct(cardinality).alias("n_categories"),
    )


def class_imbalance(df: DataFrame, target: str, majority, minority) -> DataFrame:
    """Ratio of majority to minority rows and the two percentages."""
    n = F.count(F.lit(1))
    major, minor = F.count_if(F.col(target) == majority), F.count_if(F.col(target) == minority)
    return df.agg(
        F.round(ratio(major, minor), 6).alias("imbalance_ratio"),
        F.round(100 * ratio(major, n), 6).alias("majority_pct"),
        F.round(100 * ratio(minor, n), 6).alias("minority_pct"),
    )


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def range_check(df: DataFrame, column: str, suspicious) -> DataFrame:
    return df.agg(
        F.min(column).alias("min_value"), F.max(column).alias("max_value"),
        F.count_if(suspicious).alias("n_suspicious"),
    )


def histogram(df: DataFrame, column: str, bins: int, closed: str = "left") -> DataFrame:
    """Equal-width histogram with counts, shares and edges; empty bins are kept.

    `closed='left'` puts the maximum in the last bin; `closed='right'` puts the minimum in the
    first. A constant column gets a unit-wide range around its value.
    """
    x = F.col(column).cast("double")
    values = df.where(x.isNotNull()).select(x.alias("__x"))
    lo, hi = F.min("__x"), F.max("__x")
    spread = values.agg(
        F.struct(
            F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
            F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"),
            F.count(F.lit(1)).alias("n"),
        ).alias("s")
    )
    position = (F.col("__x") - F.col("s.lo")) / (F.col("s.hi") - F.col("s.lo")) * bins
    if closed == "left":
        index = F.least(F.floor(position), F.lit(bins - 1))
    else:
        index = F.greatest(F.ceil(position) - 1, F.lit(0))
    counted = (
        values.withColumn("s", spread.scalar())
        .groupBy(index.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("s", spread.scalar())
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    n = F.coalesce(F.col("n"), F.lit(0))
    return frame.join(counted, "bin", "left").select(
        "bin",
        F.round(F.col("s.lo") + F.col("bin") * width, 6).alias("lower_edge"),
        F.round(F.col("s.lo") + (F.col("bin") + 1) * width, 6).alias("upper_edge"),
        n.alias("n"),
        F.round(ratio(n, F.col("s.n")), 6).alias("share"),
    )


def cumulative_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Running share over the bins of an equal-width histogram."""
    bars = histogram(df, column, bins).select("bin", "n")
    cum = running_sums(bars, "bin", ["n"], ranges=1)
    return cum.select(
        "bin", "n", F.col("cum_n").alias("cum_n"),
        F.round(ratio(F.col("cum_n"), F.col("total_n")), 6).alias("cum_share"),
    )


def box_stats(df: DataFrame, column: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Quartiles, 0.99 quantile, 1.5 IQR whiskers and outlier count, optionally per group."""
    by, qs = list(by), {**QUARTILES, "q99": 0.99}
    x = F.col(column).cast("double")
    if by:
        counts = df.where(x.isNotNull()).groupBy(*by, x.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        counts = materialize(counts, "box")
        ranges = ranges_for(counts.count()) if ranges is None else ranges
        quantiles = quantiles_from_counts(counts, "value", "n", qs, by, ranges)
        rows = join_groups(counts, quantiles, by)
    else:
        packed = exact_quantiles(df, [column], qs, ranges=ranges).select(F.struct(*qs).alias("f"))
        rows = df.where(x.isNotNull()).select(x.alias("value"), F.lit(1).alias("n"), packed.scalar().alias("f")).select("value", "n", "f.*")
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col("value") >= F.col("q25") - reach) & (F.col("value") <= F.col("q75") + reach)
    out = rows.groupBy(*by, *qs).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
    )
    rounded = [F.round(c, 6).alias(c) for c in (*qs, "whisker_low", "whisker_high")]
    return out.select(*by, *rounded, "n_outliers")


def density(df: DataFrame, column: str, by: str, grid: Sequence[float]) -> DataFrame:
    """Gaussian kernel density per class on a fixed grid, bandwidth `std * n^(-1/5)` per class.

    Each class integrates to one on its own. The sums run over value counts, with one aggregate per
    grid point, so no row is multiplied by the grid.
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(by, x.alias("__x"))
    stats = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("__n"), (F.stddev_samp("__x") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("__h")
    )
    counts = rows.groupBy(by, "__x").agg(F.count(F.lit(1)).alias("__w"))
    joined = join_groups(counts, stats, [by])
    names = [f"g{i}" for i in range(len(grid))]
    kernels = [
        F.sum(F.col("__w") * F.exp(-0.5 * F.pow((F.lit(float(g)) - F.col("__x")) / F.col("__h"), F.lit(2.0)))).alias(name)
        for g, name in zip(grid, names)
    ]
    wide = joined.groupBy(by, "__n", "__h").agg(*kernels)
    long = wide.unpivot([by, "__n", "__h"], names, "__g", "__k")
    point = F.element_at(F.array(*[F.lit(float(g)) for g in grid]), F.substring("__g", 2, 9).cast("int") + 1)
    norm = F.lit(1.0 / sqrt(2 * pi)) / (F.col("__n") * F.col("__h"))
    return long.select(by, point.alias("grid"), F.round(F.col("__k") * norm, 8).alias("density"))


def classify_columns(df: DataFrame, target: str, forced_categorical: Sequence[str] = ()) -> DataFrame:
    """Role of every column but the target: binary, categorical or numeric.

    A column has at most two distinct non-null values when none differs from both its minimum and
    its maximum, so two scans with tiny aggregates replace a distinct count of every column.
    """
    columns = [c for c in df.columns if c != target]
    ends = df.agg(F.struct(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).alias("s"))
    between = df.withColumn("s", ends.scalar()).agg(
        *[F.count_if((F.col(c) != F.col(f"s.lo_{c}")) & (F.col(c) != F.col(f"s.hi_{c}"))).alias(c) for c in columns]
    )
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    kind = {c: "numeric" if c in numeric and c not in forced_categorical else "categorical" for c in columns}
    long = between.unpivot([], columns, "column_name", "n_between")
    other = F.lit("categorical")
    numeric_cols = [c for c in columns if kind[c] == "numeric"]
    role = F.when(F.col("n_between") == 0, "binary").when(F.col("column_name").isin(numeric_cols), "numeric")
    return long.select("column_name", role.otherwise(other).alias("role"))


def schema_listing(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")


def preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)
