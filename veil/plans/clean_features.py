"""Queries of the cleaning, generalization and feature group (E)."""

from __future__ import annotations

from math import inf

from pyspark.sql import functions as F

from veil.functions.exprs import bin_column, map_values
from veil.functions.rand import salt
from veil.operators import clean as C
from veil.operators.dp import respond_all
from veil.plans.registry import ORACLES, AGE_CASE, APPT, CLEAN, query, uniform_sql
from veil.roles import APPOINTMENT_ROLES
from veil.sources import views as V
from veil.sources.tables import table

LEAD = "date_diff('day', CAST(scheduled_ts AS DATE), CAST(appointment_ts AS DATE))"


@query("e1_drop_identifiers", f"WITH {CLEAN} SELECT * EXCLUDE (appointment_id) FROM clean")
def e1(spark, sf):
    return C.drop_identifiers(V.clean_appointments(spark, sf), APPOINTMENT_ROLES)


def _failures():
    return {"negative_age": F.col("age") < 0, "negative_lead": V.lead_days() < 0}


@query(
    "e2_drop_report",
    f"""WITH {APPT} SELECT count(*) AS rows_in, count(*) FILTER (WHERE age < 0) AS negative_age,
    count(*) FILTER (WHERE age >= 0 AND {LEAD} < 0) AS negative_lead,
    count(*) FILTER (WHERE age >= 0 AND {LEAD} >= 0) AS rows_out FROM appt""",
)
def e2(spark, sf):
    return C.drop_failing(V.appointments(spark, sf), _failures())[1]


@query("e2_kept_rows", f"WITH {APPT} SELECT appointment_id, age FROM appt WHERE age >= 0 AND {LEAD} >= 0")
def e2b(spark, sf):
    return C.drop_failing(V.appointments(spark, sf), _failures())[0].select("appointment_id", "age")


@query("e3_clamp_low_age", f"WITH {APPT} SELECT appointment_id, CASE WHEN age < 0 THEN 0 ELSE age END AS age FROM appt")
def e3(spark, sf):
    return V.appointments(spark, sf).select("appointment_id", C.clamp_low(F.col("age"), 0).alias("age"))


@query("e4_cap_high_age", f"WITH {APPT} SELECT appointment_id, CASE WHEN age > 100 THEN 100 ELSE age END AS age FROM appt")
def e4(spark, sf):
    return V.appointments(spark, sf).select("appointment_id", C.cap_high(F.col("age"), 100).alias("age"))


@query(
    "e4_cap_report",
    f"WITH {APPT} SELECT count(*) FILTER (WHERE age > 100) AS n_capped, max(CASE WHEN age > 100 THEN 100 ELSE age END) AS max_after FROM appt",
)
def e4b(spark, sf):
    age = F.col("age")
    return V.appointments(spark, sf).agg(
        F.count_if(age > 100).alias("n_capped"), F.max(C.cap_high(age, 100)).alias("max_after")
    )


@query(
    "e5_binarize",
    f"""WITH {APPT} SELECT appointment_id, CAST(no_show = 'Yes' AS INT) AS noshow, CAST(gender = 'M' AS INT) AS male,
    CAST(handcap > 0 AS INT) AS handcap_binary FROM appt""",
)
def e5(spark, sf):
    return V.appointments(spark, sf).select(
        "appointment_id",
        C.binarize(F.col("no_show") == "Yes").alias("noshow"),
        C.binarize(F.col("gender") == "M").alias("male"),
        C.binarize(F.col("handcap") > 0).alias("handcap_binary"),
    )


@query(
    "e6_parse_timestamp",
    """WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'not a time'
    ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T18:38:08Z' END AS s FROM orders)
    SELECT k, epoch(try_strptime(s, '%Y-%m-%dT%H:%M:%SZ'))::BIGINT AS parsed FROM t""",
)
def e6(spark, sf):
    text = F.when(F.col("o_orderkey") % 17 == 0, "not a time").otherwise(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T18:38:08Z"))
    )
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.alias("s"))
    return rows.select("k", F.unix_seconds(C.parse_timestamp(F.col("s"))).alias("parsed"))


FIVE_YEARS = list(range(0, 105, 5))


def _bins_sql(col: str, edges: list, labels: list, left: bool) -> str:
    out = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        a = "" if lo == -inf else f"{col} {'>=' if left else '>'} {lo}"
        b = "" if hi == inf else f"{col} {'<' if left else '<='} {hi}"
        out.append(f"WHEN {' AND '.join(x for x in (a, b) if x)} THEN {lab!r}")
    return "CASE " + " ".join(out) + " END"


OLD_EDGES = [0, 12, 18, 35, 50, 65, 120]
OLD_LABELS = ["0-11", "12-17", "18-34", "35-49", "50-64", "65+"]
FIVE_LABELS = [f"{a}-{a + 4}" for a in FIVE_YEARS[:-1]]


@query(
    "e7_left_closed_bins",
    f"""WITH {APPT} SELECT appointment_id, {AGE_CASE} AS age_group, {_bins_sql('age', OLD_EDGES, OLD_LABELS, True)} AS age_six,
    {_bins_sql('age', FIVE_YEARS, FIVE_LABELS, True)} AS age_five FROM appt""",
)
def e7(spark, sf):
    age = F.col("age")
    return V.appointments(spark, sf).select(
        "appointment_id",
        bin_column(age, V.AGE_EDGES, V.AGE_LABELS).alias("age_group"),
        bin_column(age, OLD_EDGES, OLD_LABELS).alias("age_six"),
        bin_column(age, FIVE_YEARS, FIVE_LABELS).alias("age_five"),
    )


EDA_EDGES, EDA_LABELS = [0, 18, 35, 50, 65, 120], ["0-18", "19-35", "36-50", "51-65", "65+"]
LEAD_EDGES = [-inf, 0, 1, 7, 14, 30, inf]
LEAD_LABELS = ["Same day", "1 day", "2-7 days", "8-14 days", "15-30 days", ">30 days"]
LEAD_CODE_EDGES = [-inf, 0, 1, 3, 7, 14, 30, inf]


@query(
    "e8_right_closed_bins",
    f"""WITH {APPT}, l AS (SELECT *, {LEAD} AS lead_days FROM appt)
    SELECT appointment_id, {_bins_sql('age', EDA_EDGES, EDA_LABELS, False)} AS age_band,
    {_bins_sql('lead_days', LEAD_EDGES, LEAD_LABELS, False)} AS lead_band,
    CAST({_bins_sql('lead_days', LEAD_CODE_EDGES, list(range(7)), False)} AS INT) AS lead_code FROM l""",
)
def e8(spark, sf):
    raw = V.appointments(spark, sf).withColumn("lead_days", V.lead_days())
    return raw.select(
        "appointment_id",
        bin_column(F.col("age"), EDA_EDGES, EDA_LABELS, "right").alias("age_band"),
        bin_column(F.col("lead_days"), LEAD_EDGES, LEAD_LABELS, "right").alias("lead_band"),
        bin_column(F.col("lead_days"), LEAD_CODE_EDGES, None, "right").alias("lead_code"),
    )


def nation_regions(spark, sf):
    """Generalization lookup nation -> region, with two nations left out."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.where(~F.col("n_name").isin("NATION_9", "NATION_14")).select("n_name", "r_name")


LOOKUP = """lk AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT IN ('NATION_9', 'NATION_14'))"""


@query(
    "e9_generalize_region",
    f"""WITH {APPT}, {LOOKUP} SELECT appointment_id, neighbourhood, coalesce(lk.r_name, 'Other') AS region_general
    FROM appt LEFT JOIN lk ON neighbourhood = n_name""",
)
def e9(spark, sf):
    rows = V.appointments(spark, sf).select("appointment_id", "neighbourhood")
    return C.generalize(rows, "neighbourhood", nation_regions(spark, sf), "n_name", "r_name", "Other", "region_general")


@query(
    "e10_unmapped_values",
    f"WITH {APPT}, {LOOKUP} SELECT DISTINCT neighbourhood FROM appt WHERE neighbourhood NOT IN (SELECT n_name FROM lk)",
)
def e10(spark, sf):
    return C.unmapped_values(V.appointments(spark, sf), "neighbourhood", nation_regions(spark, sf), "n_name")


@query(
    "e11_generalization_ratio",
    f"""WITH {CLEAN} SELECT count(DISTINCT neighbourhood) AS n_before, count(DISTINCT region) AS n_after,
    round(count(DISTINCT neighbourhood)::DOUBLE / count(DISTINCT region), 6) AS ratio FROM clean""",
)
def e11(spark, sf):
    return C.generalization_ratio(V.clean_appointments(spark, sf), "neighbourhood", "region")


RELEASE_MAP = {"Age_Group": "age_group", "Gender": "gender", "Region": "region", "DaysBetween": "lead_days",
               "SMS_received": "sms_received", "NoShow": "noshow"}


@query(
    "e12_release_schema",
    f"WITH {CLEAN} SELECT " + ", ".join(f'{o} AS "{n}"' for n, o in RELEASE_MAP.items()) + " FROM clean",
)
def e12(spark, sf):
    return C.select_rename(V.clean_appointments(spark, sf), RELEASE_MAP)


E13_COLS = ["age", "scholarship", "handcap", "lead_days"]


@query(
    "e13_numeric_coercion",
    f"WITH {CLEAN} SELECT appointment_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in E13_COLS) + " FROM clean",
)
def e13(spark, sf):
    return C.coerce_numeric(V.clean_appointments(spark, sf).select("appointment_id", *E13_COLS), E13_COLS)[0]


@query(
    "e13_null_check",
    f"WITH {CLEAN} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM clean" for c in E13_COLS),
)
def e13b(spark, sf):
    return C.coerce_numeric(V.clean_appointments(spark, sf), E13_COLS)[1]


@query("e2_written_report", ORACLES["e2_drop_report"])
def e2c(spark, sf):
    """The report of E2 from the scan that writes the kept rows; so with E4 and E13 below."""
    return C.drop_failing_written(V.appointments(spark, sf), _failures())[1]


@query("e4_written_report", ORACLES["e4_cap_report"])
def e4c(spark, sf):
    return C.cap_high_written(V.appointments(spark, sf), "age", 100)[1]


@query("e13_written_null_check", ORACLES["e13_null_check"])
def e13c(spark, sf):
    return C.coerce_numeric_written(V.clean_appointments(spark, sf), E13_COLS)[1]


@query("e14a_lead_days_by_date", f"WITH {APPT} SELECT appointment_id, CAST({LEAD} AS INT) AS lead_days FROM appt")
def e14a(spark, sf):
    lead = C.lead_days_by_date(F.col("scheduled_ts"), F.col("appointment_ts"))
    return V.appointments(spark, sf).select("appointment_id", lead.alias("lead_days"))


@query(
    "e14b_lead_days_by_time",
    f"WITH {APPT} SELECT appointment_id, CAST(floor(date_diff('second', scheduled_ts, appointment_ts) / 86400.0::DOUBLE) AS INT) AS lead_days FROM appt",
)
def e14b(spark, sf):
    lead = C.lead_days_by_time(F.col("scheduled_ts"), F.col("appointment_ts"))
    return V.appointments(spark, sf).select("appointment_id", lead.alias("lead_days"))


@query(
    "e15_calendar_features",
    f"""WITH {APPT} SELECT appointment_id, CAST(isodow(scheduled_ts) - 1 AS INT) AS sched_dow, CAST(month(scheduled_ts) AS INT) AS sched_month,
    CAST(hour(scheduled_ts) AS INT) AS sched_hour, dayname(scheduled_ts) AS sched_day_name FROM appt""",
)
def e15(spark, sf):
    return V.appointments(spark, sf).select("appointment_id", *C.calendar_features(F.col("scheduled_ts"), "sched"))


@query("e16_drop_timestamps", f"WITH {APPT} SELECT * EXCLUDE (scheduled_ts, appointment_ts), CAST({LEAD} AS INT) AS lead_days FROM appt")
def e16(spark, sf):
    return V.appointments(spark, sf).withColumn("lead_days", V.lead_days()).drop("scheduled_ts", "appointment_ts")


@query(
    "e17_derived_flags",
    f"WITH {CLEAN} SELECT appointment_id, CAST(lead_days <= 0 AS INT) AS is_same_day, CAST(appt_dow >= 5 AS INT) AS is_weekend FROM clean",
)
def e17(spark, sf):
    return V.clean_appointments(spark, sf).select(
        "appointment_id", C.same_day(F.col("lead_days")).alias("is_same_day"), C.weekend(F.col("appt_dow")).alias("is_weekend")
    )


@query("e18_log_lead", f"WITH {CLEAN} SELECT appointment_id, round(ln(1 + lead_days), 6) AS log_lead_days FROM clean")
def e18(spark, sf):
    return V.clean_appointments(spark, sf).select("appointment_id", F.round(F.log1p("lead_days"), 6).alias("log_lead_days"))


BURDEN = ["hypertension", "diabetes", "alcoholism", "handcap_binary"]


@query(
    "e19_health_burden",
    f"WITH {CLEAN} SELECT hypertension + diabetes + alcoholism + handcap_binary AS health_burden, count(*) AS n FROM clean GROUP BY 1",
)
def e19(spark, sf):
    scored = V.clean_appointments(spark, sf).withColumn("health_burden", C.flag_score(BURDEN))
    return scored.groupBy("health_burden").agg(F.count(F.lit(1)).alias("n"))


@query("e19_burden_violations", f"WITH {CLEAN} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_violations FROM clean")
def e19b(spark, sf):
    scored = V.clean_appointments(spark, sf).withColumn("health_burden", C.flag_score(BURDEN))
    return C.score_violations(scored, "health_burden", BURDEN)


AGE_CODES = {label: i for i, label in enumerate(V.AGE_LABELS)}
GENDER_CODES = {"F": 0, "M": 1}


@query(
    "e20_ordinal_codes",
    f"""WITH {CLEAN} SELECT appointment_id, CAST(CASE age_group WHEN '0-14' THEN 0 WHEN '15-24' THEN 1 WHEN '25-44' THEN 2
    WHEN '45-64' THEN 3 WHEN '65+' THEN 4 END AS INT) AS age_group_code, CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 END AS gender_code FROM clean""",
)
def e20(spark, sf):
    return V.clean_appointments(spark, sf).select(
        "appointment_id",
        map_values(F.col("age_group"), AGE_CODES).alias("age_group_code"),
        map_values(F.col("gender"), GENDER_CODES).alias("gender_code"),
    )


@query(
    "e21_label_encode",
    f"""WITH {CLEAN} SELECT appointment_id, neighbourhood, CAST(dense_rank() OVER (ORDER BY neighbourhood) - 1 AS INT) AS neighbourhood_code FROM clean""",
)
def e21(spark, sf):
    rows = V.clean_appointments(spark, sf).select("appointment_id", "neighbourhood")
    return C.label_encode(rows, "neighbourhood", "neighbourhood_code")


# fixed values: days of the week and the declared regions
DOW = list(range(7))
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "e22_one_hot",
    f"WITH {CLEAN} SELECT appointment_id, "
    + ", ".join(f"CAST(region = '{v}' AS INT) AS \"Region_{v}\"" for v in REGIONS)
    + ", " + ", ".join(f'CAST(appt_dow = {v} AS INT) AS "ApptDOW_{v}"' for v in DOW[1:]) + " FROM clean",
)
def e22(spark, sf):
    rows = V.clean_appointments(spark, sf).select("appointment_id", "region", "appt_dow")
    return C.one_hot(C.one_hot(rows, "region", "Region", REGIONS), "appt_dow", "ApptDOW", DOW, drop_first=True)


@query(
    "e23_scale_uncentred",
    f"""WITH {CLEAN}, s AS (SELECT stddev_pop(age) AS a, stddev_pop(lead_days) AS l FROM clean)
    SELECT appointment_id, round(age / a, 6) AS age, round(lead_days / l, 6) AS lead_days FROM clean, s""",
)
def e23(spark, sf):
    rows = V.clean_appointments(spark, sf).select("appointment_id", "age", "lead_days")
    scaled = C.scale_uncentred(rows, ["age", "lead_days"])
    return scaled.select("appointment_id", *[F.round(c, 6).alias(c) for c in ("age", "lead_days")])


def feature_base(df):
    """Encoded and derived columns that the feature sets pick from."""
    lead = F.col("lead_days")
    df = df.select(
        "*",
        map_values(F.col("age_group"), AGE_CODES).alias("age_group_code"),
        map_values(F.col("gender"), GENDER_CODES).alias("gender_code"),
        bin_column(lead, LEAD_CODE_EDGES, None, "right").alias("lead_category"),
        C.same_day(lead).alias("is_same_day"),
        C.weekend(F.col("appt_dow")).alias("is_weekend"),
        F.log1p(lead).alias("log_lead_days"),
        C.flag_score(["hypertension", "diabetes", "alcoholism", "handcap"]).alias("health_burden"),
    )
    return C.label_encode(C.label_encode(df, "region", "region_code"), "neighbourhood", "neighbourhood_code")


DP_FLAGS = ["hypertension", "diabetes", "alcoholism", "handcap_binary"]
_CAL_SQL = (
    "CAST(lead_days AS INT) AS lead_days, appt_dow, appt_month, sched_dow, sched_hour,"
    f" CAST({_bins_sql('lead_days', LEAD_CODE_EDGES, list(range(7)), False)} AS INT) AS lead_category, CAST(lead_days <= 0 AS INT) AS is_same_day,"
    " CAST(appt_dow >= 5 AS INT) AS is_weekend, sms_received"
)
_GENDER = "CAST(gender = 'M' AS INT) AS gender_code"
_REGION = "CAST(dense_rank() OVER (ORDER BY region) - 1 AS INT) AS region_code"
_NEIGHBOURHOOD = "CAST(dense_rank() OVER (ORDER BY neighbourhood) - 1 AS INT) AS neighbourhood_code"
_AGE_CODE = "CAST(CASE age_group WHEN '0-14' THEN 0 WHEN '15-24' THEN 1 WHEN '25-44' THEN 2 WHEN '45-64' THEN 3 WHEN '65+' THEN 4 END AS INT) AS age_group_code"


def _response_sql(column: str) -> str:
    first, second = (uniform_sql(salt("veil", column, d), "appointment_id") for d in (0, 1))
    return f"CASE WHEN {first} < 0.3 THEN CASE WHEN {second} < 0.5 THEN 0 ELSE 1 END ELSE {column} END"


FEATURE_SQL = {
    "anonymized": f"{_AGE_CODE}, {_GENDER}, {_REGION}, {_CAL_SQL}, scholarship, "
    + ", ".join(f"{_response_sql(c)} AS {c}_dp" for c in DP_FLAGS)
    + ", " + " + ".join(f"({_response_sql(c)})" for c in DP_FLAGS) + " AS health_burden_dp",
    "partial": f"age, {_GENDER}, {_REGION}, {_CAL_SQL}, scholarship, hypertension, diabetes, alcoholism, handcap_binary",
    "full": f"age, {_GENDER}, {_NEIGHBOURHOOD}, {_CAL_SQL}, scholarship, hypertension, diabetes, alcoholism, handcap_binary",
    "non_anonymized": f"age, {_GENDER}, {_NEIGHBOURHOOD}, CAST(lead_days AS INT) AS lead_days, appt_dow, appt_month, sched_dow, sms_received, scholarship,"
    " hypertension, diabetes, alcoholism, handcap, round(ln(1 + lead_days), 6) AS log_lead_days, hypertension + diabetes + alcoholism + handcap AS health_burden",
}

for _set, _sql in FEATURE_SQL.items():

    @query(f"e24_{_set}_feature_set", f"WITH {CLEAN} SELECT appointment_id, {_sql} FROM clean")
    def _e24(spark, sf, name=_set):
        rows = respond_all(V.clean_appointments(spark, sf), DP_FLAGS, "appointment_id", 0.3, 0.5, "veil")
        base = feature_base(rows.withColumn("health_burden_dp", C.flag_score([f"{c}_dp" for c in DP_FLAGS])))
        return C.select_features(base.withColumn("log_lead_days", F.round("log_lead_days", 6)), name, ["appointment_id"])
