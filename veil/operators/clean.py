"""Cleaning, generalization and feature projections. Everything row-wise here is a narrow stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veil.functions.exprs import ratio
from veil.functions.observed import written_with_counts
from veil.functions.ordered import running_sums
from veil.roles import Roles


def drop_identifiers(df: DataFrame, roles: Roles, keep_group: bool = True) -> DataFrame:
    """Without the direct identifiers; the split group stays until release when asked for."""
    kept = {roles.group} if keep_group else set()
    return df.drop(*[c for c in roles.identifiers if c not in kept])


def drop_failing(df: DataFrame, failures: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that fail no predicate, and how many each predicate removed, applied in order.

    A null predicate does not remove the row.
    """
    kept, counts, passed = df, [], F.lit(True)
    for name, bad in failures.items():
        fails = F.coalesce(bad, F.lit(False))
        counts.append(F.count_if(passed & fails).alias(name))
        passed = passed & ~fails
        kept = kept.where(~fails)
    report = df.agg(F.count(F.lit(1)).alias("rows_in"), *counts, F.count_if(passed).alias("rows_out"))
    return kept, report


def drop_failing_written(df: DataFrame, failures: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """`drop_failing` for rows that are written anyway: the report is counted by the scan that writes them."""
    counts, passed = {"rows_in": F.count(F.lit(1))}, F.lit(True)
    for name, bad in failures.items():
        fails = F.coalesce(bad, F.lit(False))
        counts[name] = F.count_if(passed & fails)
        passed = passed & ~fails
    return written_with_counts(df, counts, lambda rows: rows.where(passed), {"rows_out": F.count(F.lit(1))}, "kept")


def cap_high_written(df: DataFrame, column: str, high) -> tuple[DataFrame, DataFrame]:
    """Rows with capped values, written, and how many were capped, from one scan."""
    capped = lambda rows: rows.withColumn(column, cap_high(F.col(column), high))
    return written_with_counts(df, {"n_capped": F.count_if(F.col(column) > high)}, capped, {"max_after": F.max(column)}, "capped")


def clamp_low(column: Column, low) -> Column:
    """Values below `low` become `low`; nulls stay null."""
    return F.when(column < low, F.lit(low)).otherwise(column)


def cap_high(column: Column, high) -> Column:
    """Values above `high` become `high`; nulls stay null."""
    return F.when(column > high, F.lit(high)).otherwise(column)


def binarize(condition: Column) -> Column:
    return condition.cast("int")


def parse_timestamp(column: Column, fmt: str | None = None) -> Column:
    """Timestamp from text; text that does not parse gives null."""
    return F.try_to_timestamp(column, F.lit(fmt)) if fmt else F.try_to_timestamp(column)


def generalize(df: DataFrame, column: str, lookup: DataFrame, key: str, value: str, default: str, out: str) -> DataFrame:
    """Adds `out`, the parent of `column` in a lookup table, `default` where there is none."""
    pairs = lookup.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    joined = df.join(pairs, F.col(column) == F.col("__key"), "left")
    return joined.withColumn(out, F.coalesce("__value", F.lit(default))).drop("__key", "__value")


def unmapped_values(df: DataFrame, column: str, lookup: DataFrame, key: str) -> DataFrame:
    """Distinct values that the lookup lacks."""
    levels = df.where(F.col(column).isNotNull()).select(column).distinct()
    return levels.join(lookup.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def generalization_ratio(df: DataFrame, before: str, after: str) -> DataFrame:
    """Distinct values before and after, counted over the distinct pairs."""
    pairs = df.groupBy(before, after).agg(F.lit(1).alias("one"))
    counts = pairs.agg(F.count_distinct(before).alias("n_before"), F.count_distinct(after).alias("n_after"))
    return counts.withColumn("ratio", F.round(ratio(F.col("n_before"), F.col("n_after")), 6))


def select_rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns of the release schema, in order, from `{new name: old name}`."""
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()])


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Booleans and integers to bigint, everything else to double; plus null counts afterwards."""
    types = {f.name: f.dataType for f in df.schema}

    def cast(c: str) -> Column:
        whole = isinstance(types[c], (T.BooleanType, T.IntegralType))
        return F.col(c).cast("bigint") if whole else F.col(c).try_cast("double")

    coerced = df.select(*[cast(c).alias(c) if c in columns else F.col(c) for c in df.columns])
    wide = coerced.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return coerced, wide.unpivot([], list(columns), "column_name", "null_count")


def coerce_numeric_written(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """`coerce_numeric` for rows that are written anyway: nulls are counted by the scan that writes them."""
    nulls = {c: F.count_if(F.col(c).isNull()) for c in columns}
    table, wide = written_with_counts(df, {"rows": F.count(F.lit(1))}, lambda rows: coerce_numeric(rows, columns)[0], nulls, "numeric")
    return table, wide.drop("rows").unpivot([], list(columns), "column_name", "null_count")


def lead_days_by_date(start: Column, end: Column) -> Column:
    """Whole days at date granularity: the same day gives 0 at any hour."""
    return F.datediff(F.to_date(end), F.to_date(start))


def lead_days_by_time(start: Column, end: Column) -> Column:
    """Floor of the elapsed days: midnight after an 18:00 booking on the same day gives -1."""
    return F.floor(F.timestamp_diff("SECOND", start, end) / F.lit(86400.0)).cast("int")


def calendar_features(column: Column, prefix: str) -> list[Column]:
    """Day of week (Monday = 0), month, hour and day name."""
    return [
        F.weekday(column).alias(f"{prefix}_dow"),
        F.month(column).alias(f"{prefix}_month"),
        F.hour(column).alias(f"{prefix}_hour"),
        F.date_format(column, "EEEE").alias(f"{prefix}_day_name"),
    ]


def same_day(lead: Column) -> Column:
    return (lead <= 0).cast("int")


def weekend(dow: Column) -> Column:
    return (dow >= 5).cast("int")


def flag_score(columns: Sequence[str]) -> Column:
    """Sum of flags."""
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0]))


def score_violations(df: DataFrame, score: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose score is not the sum of its parts; must be 0."""
    consistent = F.col(score).eqNullSafe(flag_score(columns))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~consistent).alias("n_violations"))


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Index of the value among the sorted distinct values; nulls stay null.

    Distinct values are ranked range by range, so a column with very many levels is not sorted in
    one task.
    """
    levels = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__level")).agg(F.lit(1).alias("__one"))
    index = running_sums(levels, "__level", ["__one"]).select(
        "__level", (F.col("cum___one") - 1).cast("int").alias(out)
    )
    return df.join(index, F.col(column) == F.col("__level"), "left").drop("__level")


def one_hot(df: DataFrame, column: str, prefix: str, levels: Sequence, drop_first: bool = False) -> DataFrame:
    """The column replaced by one 0/1 column `<prefix>_<level>` per level, optionally without the first.

    The levels are part of the table's declared schema, so they are given and not searched in the
    rows; other values and nulls have 0 everywhere. Open-ended columns belong in the vector encoders
    of `operators.models`.
    """
    used = list(levels)[1:] if drop_first else list(levels)
    flags = [F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in used]
    return df.select(*[c for c in df.columns if c != column], *flags)


def scale_uncentred(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Columns divided by their population standard deviation, not centred; constants stay as they are.

    `fit_on` names the rows that the deviation is taken from, e.g. the training side.
    """
    rows = df if fit_on is None else df.where(fit_on)
    spread = rows.agg(F.struct(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns]).alias("s"))
    scale = {c: F.when(F.col(f"__s.{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s.{c}")) for c in columns}
    return df.withColumn("__s", spread.scalar()).select(
        *[(F.col(c) / scale[c]).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


# fixed values: the feature sets that protected and unprotected models are trained on
_CALENDAR = ["lead_days", "appt_dow", "appt_month", "sched_dow", "sched_hour", "lead_category", "is_same_day",
             "is_weekend", "sms_received"]
FEATURE_SETS = {
    "anonymized": ["age_group_code", "gender_code", "region_code", *_CALENDAR, "scholarship", "hypertension_dp",
                   "diabetes_dp", "alcoholism_dp", "handcap_binary_dp", "health_burden_dp"],
    "partial": ["age", "gender_code", "region_code", *_CALENDAR, "scholarship", "hypertension", "diabetes",
                "alcoholism", "handcap_binary"],
    "full": ["age", "gender_code", "neighbourhood_code", *_CALENDAR, "scholarship", "hypertension", "diabetes",
             "alcoholism", "handcap_binary"],
    "non_anonymized": ["age", "gender_code", "neighbourhood_code", "lead_days", "appt_dow", "appt_month", "sched_dow",
                       "sms_received", "scholarship", "hypertension", "diabetes", "alcoholism", "handcap",
                       "log_lead_days", "health_burden"],
}


def select_features(df: DataFrame, feature_set: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *FEATURE_SETS[feature_set])
