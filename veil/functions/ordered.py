"""Running sums and ranks over sorted data without a single-task window.

A window without partition keys, or with one hot key, sorts everything in one task. Here the rows are
partitioned by ranges of the order and written with the number of their range. Sums inside a range
and the totals of the ranges before it add up to the exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.exprs import join_groups
from veil.functions.lineage import materialize

ROWS_PER_RANGE = 1_000_000


def default_ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranges_for(n_rows: int) -> int:
    """Ranges for a table of a known size: as many as keep a range at what one task can surely sort."""
    return max(1, -(-n_rows // ROWS_PER_RANGE))


def running_sums(table: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds `cum_<c>` (inclusive running sum in `order`) and `total_<c>` for every `c` in `sums`.

    `table` holds one row per (`by`, `order`) value, that is, it is pre-aggregated: a value that a
    third of all input rows share is still one row here.

    The table is written to the shared folder first. That keeps its several uses from scanning the
    source again, and its exact size decides how many ranges are needed, unless `ranges` says so.
    `ranges=1` is for tables whose size per `by` has a known bound; nothing is written then.
    """
    by = list(by)
    if ranges != 1:
        table = materialize(table, "ordered")
        ranges = ranges or ranges_for(table.count())
    if ranges == 1:
        group = f"PARTITION BY {', '.join(f'`{c}`' for c in by)}" if by else ""
        inside = f"OVER ({group} ORDER BY `{order}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return table.selectExpr(
            "*", *[f"sum(`{c}`) {inside} AS `cum_{c}`" for c in sums], *[f"sum(`{c}`) OVER ({group}) AS `total_{c}`" for c in sums]
        )
    cut = materialize(table.repartitionByRange(ranges, *by, order).withColumn("__range", F.spark_partition_id()), "ranges")
    keys = [*by, "__range"]
    # one row per group and range: a group spans neighbouring ranges only
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    offsets = (
        cut.groupBy(*keys)
        .agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
        .select(
            *keys,
            *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums],
            *[F.sum(f"__s_{c}").over(everything).alias(f"total_{c}") for c in sums],
        )
    )
    local = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.select(*table.columns, "__range", *[F.sum(c).over(local).alias(f"__l_{c}") for c in sums])
    return _with_offsets(cut, offsets, by).select(
        *table.columns,
        *[(F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
    )


def _with_offsets(rows: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the offsets of their group and range; without groups a plain join keeps the partitioning by range."""
    return join_groups(rows, offsets, [*by, "__range"]) if by else rows.join(offsets, "__range")


def quantiles_from_counts(
    counts: DataFrame, value: str, n: str, qs: dict[str, float], by: Sequence[str] = (), ranges: int | None = None,
    sums: Sequence[str] = (), extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation from a (by, value, count) table.

    `qs` maps output names to probabilities. `extra` are further aggregates over the same rows; they
    may use the totals of the columns in `sums`.
    """
    ranked = running_sums(counts, value, [n, *sums], by, ranges)
    first, last = F.col(f"cum_{n}") - F.col(n), F.col(f"cum_{n}") - 1
    total = F.col(f"total_{n}")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank <= last), F.col(value)))

    aggregates, outputs = [], []
    for name, q in qs.items():
        position = (total - 1) * F.lit(float(q))
        aggregates += [
            at(F.floor(position)).alias(f"__lo_{name}"),
            at(F.ceil(position)).alias(f"__hi_{name}"),
            F.max(position - F.floor(position)).alias(f"__f_{name}"),
        ]
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        outputs.append((low + (high - low) * F.col(f"__f_{name}")).alias(name))
    kept = ranked.groupBy(*by).agg(*aggregates, *extra)
    dropped = [c for c in kept.columns if c.startswith(("__lo_", "__hi_", "__f_"))]
    return kept.select("*", *outputs).drop(*dropped)


def value_counts_long(df: DataFrame, columns: Sequence[str], cast: str = "double") -> DataFrame:
    """(column_name, value, n) over the non-null values of several columns, in one pass."""
    typed = df.select(*[F.col(c).cast(cast).alias(c) for c in columns])
    long = typed.unpivot([], list(columns), "column_name", "value").where(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def ranked_by_uniform(df: DataFrame, u: str, tiebreak: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds `rank` (1-based) in the order of a uniform draw, exact for groups of any size.

    Equal-width ranges of (0, 1) hold equal shares of the draws. Without `ranges` the rows are written
    once, and their number decides.
    """
    by = list(by)
    if ranges is None:
        df = materialize(df, "drawn")
        ranges = ranges_for(df.count())
    cut = df.withColumn("__range", F.floor(F.col(u) * ranges).cast("int"))
    keys = [*by, "__range"]
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                F.sum("__n").over(Window.partitionBy(*by)).alias("group_size"))
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(u, tiebreak))
    return (
        _with_offsets(cut.withColumn("__local", local), offsets, by)
        .withColumn("rank", F.col("__local") + F.col("__before"))
        .drop("__local", "__before", "__range")
    )


SKETCH_ACCURACY = 10_000


def column_sketches(df: DataFrame, columns: Sequence[str], qs: dict[str, float]) -> dict[str, dict]:
    """Per column: n, mean, std, min, max and a value bracket around every quantile; one scan.

    What reaches the driver is a fixed number of values per column. A bracket spans three times the
    rank error of the sketch on both sides, None meaning open.
    """
    margin, cells = 3.0 / SKETCH_ACCURACY, []
    probes = [p for q in qs.values() for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    for c in columns:
        x = F.col(c).cast("double")
        cells.append(
            F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                     F.percentile_approx(x, probes, SKETCH_ACCURACY).alias("cuts")).alias(c)
        )
    row, out = df.agg(*cells).first(), {}
    for c in columns:
        s = row[c].asDict()
        cuts = s.pop("cuts") or [None] * len(probes)
        s["brackets"] = {
            name: (None if probes[2 * i] == 0.0 else cuts[2 * i], None if probes[2 * i + 1] == 1.0 else cuts[2 * i + 1])
            for i, name in enumerate(qs)
        }
        out[c] = s
    return out


def bracketed_quantiles(
    df: DataFrame, columns: Sequence[str], qs: dict[str, float], sketches: dict[str, dict], ranges: int | None = None
) -> DataFrame:
    """(column_name, one column per quantile): exact quantiles of whole columns without sorting them.

    One scan counts the values inside the brackets, about a thousandth of the rows per quantile, and
    lumps everything below a bracket together. Only what was counted is sorted. A quantile whose ranks
    the bracket turns out to miss is null here; `exact_quantiles` then sorts the column.
    """
    entries, plan = [], []
    for c in columns:
        x, n = F.col(c).cast("double"), sketches[c]["n"]
        for name, q in qs.items():
            lo, hi = sketches[c]["brackets"][name]
            value = x if lo is None else F.when(x < F.lit(lo), F.lit(float("-inf"))).otherwise(x)
            inside = x.isNotNull() if hi is None else x <= F.lit(hi)
            entries.append(F.when(inside, F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("quantile"), value.alias("value"))))
            position = max(n - 1, 0) * q
            plan.append((c, name, int(position), int(-(-position // 1)), position - int(position)))
    counts = df.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("column_name", "quantile", "value").agg(F.count(F.lit(1)).alias("n"))
    if ranges is None:
        # distinct values in a bracket: its width in ranks, plus its two ends
        widest = max(s["n"] for s in sketches.values())
        ranges = ranges_for(8 * widest // SKETCH_ACCURACY + 2)
    by = ["column_name", "quantile"]
    ranked = running_sums(counts, "value", ["n"], by, ranges)
    targets = df.sparkSession.createDataFrame(plan, "c string, q string, lo bigint, hi bigint, frac double")
    joined = ranked.join(targets, (F.col("column_name") == F.col("c")) & (F.col("quantile") == F.col("q")))

    def at(rank: str) -> Column:
        covers = (F.col(rank) >= F.col("cum_n") - F.col("n")) & (F.col(rank) < F.col("cum_n")) & (F.col("value") != float("-inf"))
        return F.max(F.when(covers, F.col("value")))

    low, high = at("lo"), at("hi")
    found = joined.groupBy(*by).agg((low + (high - low) * F.max("frac")).alias("v"))
    return found.groupBy("column_name").agg(*[F.max(F.when(F.col("quantile") == name, F.col("v"))).alias(name) for name in qs])


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], qs: dict[str, float], sketches: dict[str, dict] | None = None, ranges: int | None = None
) -> DataFrame:
    """(column_name, one column per quantile) with linear interpolation; columns without values are absent."""
    sketches = sketches or column_sketches(df, columns, qs)
    filled = [c for c in columns if sketches[c]["n"]]
    schema = ", ".join(["column_name string", *[f"`{name}` double" for name in qs]])
    if not filled:
        return df.sparkSession.createDataFrame([], schema)
    rows = bracketed_quantiles(df, filled, qs, sketches, ranges).collect()  # one row per column
    done = [tuple(r[k] for k in ("column_name", *qs)) for r in rows if all(r[k] is not None for k in qs)]
    out = df.sparkSession.createDataFrame(done, schema)
    missed = [c for c in filled if c not in {r[0] for r in done}]
    if missed:
        out = out.unionByName(quantiles_from_counts(value_counts_long(df, missed), "value", "n", qs, ["column_name"], ranges))
    return out
