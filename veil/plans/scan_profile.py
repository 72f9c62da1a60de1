"""Queries of the scan and profiling groups (S, F)."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from veil.operators import profile as P
from veil.plans.registry import APPT, CLEAN, query
from veil.sources import views as V

APPT_COLS = (
    "patient_id, appointment_id, gender, scheduled_ts, appointment_ts, age, neighbourhood, region, scholarship,"
    " hypertension, diabetes, alcoholism, handcap, sms_received, no_show"
)
CATEGORICAL = ["gender", "scholarship", "hypertension", "diabetes", "alcoholism", "handcap", "sms_received", "no_show"]
NUMERIC = ["age", "handcap", "lead_days"]


def with_gaps(spark, sf):
    """Appointments in which one neighbourhood and low ages are unknown."""
    return V.appointments(spark, sf).withColumn(
        "neighbourhood", F.nullif(F.col("neighbourhood"), F.lit("NATION_9"))
    ).withColumn("age", F.when(F.col("age") >= 0, F.col("age")))


GAPS = APPT + """, gaps AS (SELECT * REPLACE (nullif(neighbourhood, 'NATION_9') AS neighbourhood,
 CASE WHEN age >= 0 THEN age END AS age) FROM appt)"""


def raw_with_lead(spark, sf):
    return V.appointments(spark, sf).withColumn("lead_days", V.lead_days())


RAW_LEAD = APPT + """, rawl AS (SELECT *, date_diff('day', CAST(scheduled_ts AS DATE), CAST(appointment_ts AS DATE)) AS lead_days FROM appt)"""


@query("s4_appointments_view", f"WITH {APPT} SELECT {APPT_COLS} FROM appt")
def s4(spark, sf):
    return V.appointments(spark, sf)


def _missing_sql() -> str:
    cols = [c.strip() for c in APPT_COLS.split(",")]
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, count(*) AS n FROM gaps" for c in cols
    )
    return (
        f"WITH {GAPS}, m AS ({parts}) SELECT column_name, missing_count, round(100.0::DOUBLE * missing_count / n, 6) AS missing_pct,"
        " (SELECT max(missing_count) > 0 FROM m) AS any_missing FROM m"
    )


@query("f1_missing_table", _missing_sql())
def f1(spark, sf):
    return P.missing_table(with_gaps(spark, sf))


@query(
    "f2_duplicate_rows",
    f"""WITH {CLEAN}, g AS (SELECT *, count(*) AS n FROM clean GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM g""",
)
def f2(spark, sf):
    return P.duplicate_count(V.clean_appointments(spark, sf))


def numeric_summary_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
        round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS max FROM {source}"""
        for c in cols
    )


@query("f3_numeric_summary", f"WITH {RAW_LEAD} {numeric_summary_sql('rawl', NUMERIC)}")
def f3(spark, sf):
    return P.numeric_summary(raw_with_lead(spark, sf), NUMERIC)


def _mixed_sql() -> str:
    empty = "NULL::BIGINT AS unique_count, NULL::VARCHAR AS top, NULL::BIGINT AS freq"
    numeric = f"SELECT *, {empty} FROM ({numeric_summary_sql('rawl', NUMERIC)})"
    text = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min,
        NULL::DOUBLE AS q25, NULL::DOUBLE AS median, NULL::DOUBLE AS q75, NULL::DOUBLE AS max, count(*) AS unique_count,
        arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM rawl GROUP BY 1)"""
        for c in ("gender", "neighbourhood", "no_show")
    )
    return f"WITH {RAW_LEAD} {numeric} UNION ALL {text}"


@query("f4_mixed_summary", _mixed_sql())
def f4(spark, sf):
    return P.mixed_summary(raw_with_lead(spark, sf), NUMERIC, ["gender", "neighbourhood", "no_show"])


@query(
    "f5_data_card",
    f"""WITH {APPT} SELECT count(*) AS n_rows, CAST(15 AS INT) AS n_columns,
    CAST(date_diff('day', CAST(min(appointment_ts) AS DATE), CAST(max(appointment_ts) AS DATE)) AS INT) AS time_span_days,
    round(100 * avg(CAST(no_show = 'Yes' AS INT)), 2) AS target_rate_pct, count(DISTINCT neighbourhood) AS n_categories FROM appt""",
)
def f5(spark, sf):
    return P.data_card(V.appointments(spark, sf), "appointment_ts", F.col("no_show") == "Yes", "neighbourhood")


def _freq_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n,
        round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share, count(*) OVER () AS n_distinct FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in cols
    )


@query("f6_value_frequencies", f"WITH {APPT} {_freq_sql('appt', CATEGORICAL)}")
def f6(spark, sf):
    return P.value_frequencies(V.appointments(spark, sf), CATEGORICAL)


@query(
    "f7_class_imbalance",
    f"""WITH {APPT}, c AS (SELECT count(*) FILTER (WHERE no_show = 'No') AS a, count(*) FILTER (WHERE no_show = 'Yes') AS b, count(*) AS n FROM appt)
    SELECT round(a::DOUBLE / b, 6) AS imbalance_ratio, round(100 * (a::DOUBLE / n), 6) AS majority_pct, round(100 * (b::DOUBLE / n), 6) AS minority_pct FROM c""",
)
def f7(spark, sf):
    return P.class_imbalance(V.appointments(spark, sf), "no_show", "No", "Yes")


@query(
    "f8_top_neighbourhoods",
    f"WITH {APPT} SELECT neighbourhood, count(*) AS n FROM appt GROUP BY 1 ORDER BY n DESC, neighbourhood LIMIT 20",
)
def f8(spark, sf):
    return P.top_k(V.appointments(spark, sf), "neighbourhood", 20)


@query(
    "f9_age_range",
    f"WITH {APPT} SELECT min(age) AS min_value, max(age) AS max_value, count(*) FILTER (WHERE age < 0) AS n_suspicious FROM appt",
)
def f9(spark, sf):
    return P.range_check(V.appointments(spark, sf), "age", F.col("age") < 0)


def histogram_sql(source: str, col: str, bins: int, closed: str = "left") -> str:
    pos = f"({col}::DOUBLE - lo) / (hi - lo) * {bins}"
    index = f"least(floor({pos}), {bins - 1})" if closed == "left" else f"greatest(ceil({pos}) - 1, 0)"
    return f"""s AS (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi, count({col}) AS total FROM {source}),
    b AS (SELECT CAST({index} AS INT) AS bin, count(*) AS n FROM {source}, s WHERE {col} IS NOT NULL GROUP BY 1),
    h AS (SELECT CAST(r.range AS INT) AS bin, round(lo + r.range * ((hi - lo) / {bins}), 6) AS lower_edge,
     round(lo + (r.range + 1) * ((hi - lo) / {bins}), 6) AS upper_edge, coalesce(b.n, 0) AS n,
     round(coalesce(b.n, 0)::DOUBLE / total, 6) AS share FROM range({bins}) r CROSS JOIN s LEFT JOIN b ON b.bin = r.range)"""


@query("f10_age_histogram", f"WITH {APPT}, {histogram_sql('appt', 'age', 50)} SELECT * FROM h")
def f10(spark, sf):
    return P.histogram(V.appointments(spark, sf), "age", 50)


@query(
    "f10_income_histogram_right_closed",
    f"""WITH inc AS (SELECT o_totalprice AS income FROM orders), {histogram_sql('inc', 'income', 20, 'right')} SELECT * FROM h""",
)
def f10b(spark, sf):
    return P.histogram(V.adult(spark, sf).select(F.col("income_numerical").alias("income")), "income", 20, "right")


@query(
    "f11_cumulative_histogram",
    f"""WITH {APPT}, {histogram_sql('appt', 'age', 20)}
    SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cum_n, round(sum(n) OVER (ORDER BY bin)::DOUBLE / sum(n) OVER (), 6) AS cum_share FROM h""",
)
def f11(spark, sf):
    return P.cumulative_histogram(V.appointments(spark, sf), "age", 20)


@query(
    "f12_lead_time_box",
    f"""WITH {RAW_LEAD}, q AS (SELECT no_show, quantile_cont(lead_days::DOUBLE, 0.25) AS q25, quantile_cont(lead_days::DOUBLE, 0.5) AS median,
    quantile_cont(lead_days::DOUBLE, 0.75) AS q75, quantile_cont(lead_days::DOUBLE, 0.99) AS q99 FROM rawl GROUP BY 1)
    SELECT q.no_show, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(q99, 6) AS q99,
    round(min(lead_days) FILTER (WHERE lead_days BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))::DOUBLE, 6) AS whisker_low,
    round(max(lead_days) FILTER (WHERE lead_days BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))::DOUBLE, 6) AS whisker_high,
    count(*) FILTER (WHERE NOT (lead_days BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))) AS n_outliers
    FROM rawl JOIN q USING (no_show) GROUP BY q.no_show, q25, median, q75, q99""",
)
def f12(spark, sf):
    return P.box_stats(raw_with_lead(spark, sf), "lead_days", ["no_show"])


@query(
    "f12_income_box",
    """WITH v AS (SELECT o_totalprice AS x FROM orders), q AS (SELECT quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median,
    quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.99) AS q99 FROM v)
    SELECT round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(q99, 6) AS q99,
    round(min(x) FILTER (WHERE x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 6) AS whisker_low,
    round(max(x) FILTER (WHERE x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 6) AS whisker_high,
    count(*) FILTER (WHERE NOT (x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))) AS n_outliers
    FROM v, q GROUP BY q25, median, q75, q99""",
)
def f12b(spark, sf):
    return P.box_stats(V.adult(spark, sf), "income_numerical")


LEAD_GRID = [float(g) for g in range(-5, 66, 2)]
AGE_GRID = [float(g) for g in range(0, 105, 5)]


def _density_sql(source: str, col: str, by: str, grid: list[float]) -> str:
    return f"""s AS (SELECT {by}, count(*) AS n, stddev_samp({col}) * pow(count(*), -0.2) AS h FROM {source} GROUP BY 1),
    v AS (SELECT {by}, {col}::DOUBLE AS x, count(*) AS w FROM {source} GROUP BY 1, 2), g AS (SELECT unnest({grid})::DOUBLE AS grid)
    SELECT s.{by}, grid, round(sum(w * exp(-0.5 * pow((grid - x) / h, 2))) * ({1.0 / (2 * pi) ** 0.5!r} / (n * h)), 8) AS density
    FROM v JOIN s USING ({by}) CROSS JOIN g GROUP BY s.{by}, grid, n, h"""


@query("f13_lead_time_density", f"WITH {RAW_LEAD}, {_density_sql('rawl', 'lead_days', 'no_show', LEAD_GRID)}")
def f13(spark, sf):
    return P.density(raw_with_lead(spark, sf), "lead_days", "no_show", LEAD_GRID)


@query("f13_age_density", f"WITH {CLEAN}, {_density_sql('clean', 'age', 'noshow', AGE_GRID)}")
def f13b(spark, sf):
    return P.density(V.clean_appointments(spark, sf), "age", "noshow", AGE_GRID)


def _roles_sql() -> str:
    kinds = {"age": "numeric", "gender": "categorical", "neighbourhood": "categorical", "region": "categorical",
             "scholarship": "numeric", "handcap": "numeric", "sms_received": "numeric", "lead_days": "numeric",
             "appt_dow": "categorical", "appt_month": "categorical"}
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) <= 2 THEN 'binary' ELSE '{k}' END AS role FROM clean"
        for c, k in kinds.items()
    )
    return f"WITH {CLEAN} {parts}"


@query("f14_column_roles", _roles_sql())
def f14(spark, sf):
    df = V.clean_appointments(spark, sf).select(
        "age", "gender", "neighbourhood", "region", "scholarship", "handcap", "sms_received", "lead_days", "appt_dow",
        "appt_month", "noshow",
    )
    return P.classify_columns(df, "noshow", ["appt_dow", "appt_month"])


@query("f15_preview", f"WITH {APPT} SELECT {APPT_COLS} FROM appt ORDER BY appointment_id LIMIT 10")
def f15(spark, sf):
    return P.preview(V.appointments(spark, sf), "appointment_id", 10)


@query("f15_schema_listing")
def f15b(spark, sf):
    return P.schema_listing(V.appointments(spark, sf))
