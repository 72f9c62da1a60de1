"""Queries of the cross-tabulation, join and set groups (C, J, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions.exprs import bin_column, explode_values, join_groups
from veil.functions.rand import salt, uniform
from veil.operators import crosstab as X
from veil.operators import risk as R
from veil.operators.diversity import class_diversity
from veil.operators.profile import top_k
from veil.plans.clean_features import EDA_EDGES, EDA_LABELS, LEAD_EDGES, LEAD_LABELS, _bins_sql
from veil.plans.registry import CLEAN, query, uniform_sql
from veil.sources import views as V
from veil.sources.tables import table

CORR = ["age", "scholarship", "hypertension", "diabetes", "alcoholism", "handcap", "sms_received", "lead_days", "noshow"]
CONDITIONS = ["hypertension", "diabetes", "alcoholism", "handcap"]
QUASI = ["age_group", "gender", "region"]


def _corr_sql() -> str:
    parts = [f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({'1.0::DOUBLE' if a == b else f'corr({a}, {b})'}, 6) AS corr FROM clean" for a in CORR for b in CORR]
    return f"WITH {CLEAN} SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})"


@query("c1_correlation_matrix", _corr_sql())
def c1(spark, sf):
    return X.correlation_matrix(V.clean_appointments(spark, sf), CORR)


def _target_corr_sql(limit: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{a}' AS feature, corr({a}, noshow) AS c FROM clean" for a in CORR[:-1])
    return (
        f"WITH {CLEAN}, t AS ({parts}) SELECT feature, round(c, 6) AS corr, CASE WHEN c > 0 THEN 'UP' ELSE 'DOWN' END AS direction"
        f" FROM t ORDER BY abs(c) DESC, feature {limit}"
    )


@query("c2_target_correlation_top5", _target_corr_sql("LIMIT 5"))
def c2(spark, sf):
    return X.target_correlation(V.clean_appointments(spark, sf), CORR[:-1], "noshow", 5)


def _eda(spark, sf):
    return V.clean_appointments(spark, sf).withColumn("age_band", bin_column(F.col("age"), EDA_EDGES, EDA_LABELS, "right"))


@query(
    "c3_age_gender_pivot",
    f"""WITH {CLEAN}, e AS (SELECT *, {_bins_sql('age', EDA_EDGES, EDA_LABELS, False)} AS age_band FROM clean)
    SELECT age_band, round(100 * avg(noshow) FILTER (WHERE gender = 'F'), 6) AS rate_F, round(100 * avg(noshow) FILTER (WHERE gender = 'M'), 6) AS rate_M
    FROM e WHERE age_band IS NOT NULL GROUP BY 1""",
)
def c3(spark, sf):
    return X.mean_pivot(_eda(spark, sf), "age_band", "gender", ["F", "M"], "noshow", "rate_", 100)


@query(
    "c3_scholarship_sms_pivot",
    f"""WITH {CLEAN} SELECT scholarship, round(100 * avg(noshow) FILTER (WHERE sms_received = 0), 6) AS rate_sms_0,
    round(100 * avg(noshow) FILTER (WHERE sms_received = 1), 6) AS rate_sms_1 FROM clean GROUP BY 1""",
)
def c3b(spark, sf):
    return X.mean_pivot(V.clean_appointments(spark, sf), "scholarship", "sms_received", [0, 1], "noshow", "rate_sms_", 100)


@query(
    "c3_region_age_pivot",
    f"WITH {CLEAN} SELECT region, "
    + ", ".join(f"round(avg(scholarship) FILTER (WHERE age_group = '{a}'), 6) AS \"age_{a}\"" for a in V.AGE_LABELS)
    + " FROM clean GROUP BY 1",
)
def c3c(spark, sf):
    return X.mean_pivot(V.clean_appointments(spark, sf), "region", "age_group", V.AGE_LABELS, "scholarship", "age_")


def _conditions_sql(test: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS condition, round(100 * avg(noshow) FILTER (WHERE {c} = 0), 6) AS rate_without,"
        f" round(100 * avg(noshow) FILTER (WHERE {c} {test} 1), 6) AS rate_with FROM clean"
        for c in CONDITIONS
    )
    return f"WITH {CLEAN} {parts}"


@query("c4_condition_rates", _conditions_sql("="))
def c4(spark, sf):
    return X.condition_rates(V.clean_appointments(spark, sf), CONDITIONS, "noshow")


@query("c4_condition_rates_at_least_one", _conditions_sql(">="))
def c4b(spark, sf):
    return X.condition_rates(V.clean_appointments(spark, sf), CONDITIONS, "noshow", at_least_one=True)


def _rate_sql(expr: str, name: str) -> str:
    return (
        f"WITH {CLEAN} SELECT {expr} AS {name}, round(100 * avg(noshow), 6) AS rate_pct, count(*) AS n FROM clean"
        f" WHERE {expr} IS NOT NULL GROUP BY 1"
    )


@query("c5_rate_by_lead_band", _rate_sql(_bins_sql("lead_days", LEAD_EDGES, LEAD_LABELS, False), "lead_band"))
def c5(spark, sf):
    band = bin_column(F.col("lead_days"), LEAD_EDGES, LEAD_LABELS, "right")
    return X.rate_by(V.clean_appointments(spark, sf), band, "noshow", "lead_band")


for _name, _col in (("hour", "sched_hour"), ("weekday", "appt_dow"), ("sms", "sms_received"), ("gender", "gender")):

    @query(f"c5_rate_by_{_name}", _rate_sql(_col, _col))
    def _c5(spark, sf, col=_col):
        return X.rate_by(V.clean_appointments(spark, sf), col, "noshow")


@query(
    "c6_rate_in_top10",
    f"""WITH {CLEAN}, t AS (SELECT neighbourhood FROM clean GROUP BY 1 ORDER BY count(*) DESC, neighbourhood LIMIT 10)
    SELECT neighbourhood, round(100 * avg(noshow), 6) AS rate_pct, count(*) AS n, (SELECT round(100 * avg(noshow), 6) FROM clean) AS overall_rate_pct
    FROM clean WHERE neighbourhood IN (SELECT neighbourhood FROM t) GROUP BY 1""",
)
def c6(spark, sf):
    return X.rate_in_top(V.clean_appointments(spark, sf), "neighbourhood", "noshow", 10)


PROFILE_CONDITIONS = ["scholarship", "hypertension", "diabetes", "alcoholism"]


def profile(spark, sf, group="region"):
    return X.group_profile(V.clean_appointments(spark, sf), group, "noshow", "age", PROFILE_CONDITIONS)


def _profile_sql(group: str = "region") -> str:
    return (
        f"{CLEAN}, prof AS (SELECT {group}, avg(noshow) AS noshow_rate, count(*) AS n, avg(age) AS avg_age, "
        + ", ".join(f"avg({c}) AS {c}_rate" for c in PROFILE_CONDITIONS) + f" FROM clean GROUP BY 1)"
    )


@query(
    "c7_region_profile",
    f"WITH {_profile_sql()} SELECT region, n, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("noshow_rate", "avg_age", *[f"{c}_rate" for c in PROFILE_CONDITIONS])) + " FROM prof",
)
def c7(spark, sf):
    rates = ["noshow_rate", "avg_age", *[f"{c}_rate" for c in PROFILE_CONDITIONS]]
    return profile(spark, sf).select("region", "n", *[F.round(c, 6).alias(c) for c in rates]).orderBy(F.desc("n"), "region")


MEASURES = ["noshow_rate", "avg_age", "scholarship_rate"]


@query(
    "c8_group_extremes",
    f"WITH {_profile_sql('neighbourhood')} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS measure, arg_min(neighbourhood, (-{m}, neighbourhood)) AS highest_group, arg_min(neighbourhood, ({m}, neighbourhood)) AS lowest_group,"
        f" round(max({m}), 6) AS highest, round(min({m}), 6) AS lowest, round(max({m}) - min({m}), 6) AS value_range FROM prof"
        for m in MEASURES
    ),
)
def c8(spark, sf):
    return X.group_extremes(profile(spark, sf, "neighbourhood"), "neighbourhood", MEASURES)


@query("c9_group_correlation", f"WITH {_profile_sql('neighbourhood')} SELECT round(corr(scholarship_rate, avg_age), 6) AS group_corr FROM prof")
def c9(spark, sf):
    return X.group_correlation(profile(spark, sf, "neighbourhood"), "scholarship_rate", "avg_age")


@query(
    "c10_median_halves",
    f"""WITH {_profile_sql('neighbourhood')}, h AS (SELECT neighbourhood AS g, CASE WHEN scholarship_rate >= (SELECT median(scholarship_rate) FROM prof) THEN 'high' ELSE 'low' END AS half FROM prof),
    c AS (SELECT half, age_group, count(*) AS n FROM clean JOIN h ON neighbourhood = g WHERE age_group IS NOT NULL GROUP BY 1, 2)
    SELECT half, age_group, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY half), 6) AS share FROM c""",
)
def c10(spark, sf):
    return X.median_halves(V.clean_appointments(spark, sf), profile(spark, sf, "neighbourhood"), "neighbourhood", "scholarship_rate", "age_group")


@query(
    "c11_children_of_region",
    f"""WITH {CLEAN}, p AS (SELECT region, neighbourhood, count(*) AS n, sum(noshow) AS hits, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, neighbourhood) AS rk FROM clean GROUP BY 1, 2)
    SELECT region, count(*) AS n_children, CAST(sum(n) AS BIGINT) AS n, round(sum(hits)::DOUBLE / sum(n), 6) AS rate,
    string_agg(neighbourhood, ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS top_children FROM p GROUP BY 1""",
)
def c11(spark, sf):
    return X.children_of(V.clean_appointments(spark, sf), "region", "neighbourhood", "noshow")


@query(
    "c12_scholarship_by_age_group",
    f"WITH {CLEAN} SELECT age_group, round(100 * avg(scholarship), 6) AS rate_pct, count(*) AS n FROM clean WHERE age_group IS NOT NULL GROUP BY 1",
)
def c12(spark, sf):
    return X.rate_by(V.clean_appointments(spark, sf), "age_group", "scholarship")


@query(
    "c13_largest_groups",
    f"""WITH {_profile_sql('neighbourhood')}, t AS (SELECT * FROM prof ORDER BY scholarship_rate DESC, neighbourhood LIMIT 9)
    SELECT neighbourhood, round(scholarship_rate, 6) AS scholarship_rate, round(n::DOUBLE / (SELECT max(n) FROM prof) * 1000, 6) AS bubble_size,
    round((avg_age - min(avg_age) OVER ()) / (max(avg_age) OVER () - min(avg_age) OVER ()), 6) AS colour_scale FROM t""",
)
def c13(spark, sf):
    return X.largest_groups(profile(spark, sf, "neighbourhood"), "neighbourhood", "scholarship_rate", "n", "avg_age", 9)


@query(
    "j1_group_statistics_join",
    f"""WITH {CLEAN}, a AS (SELECT age_group, gender, region, count(*) AS k FROM clean GROUP BY ALL),
    b AS (SELECT age_group, gender, region, round(avg(noshow), 6) AS target_rate, count(DISTINCT alcoholism) AS l_alcoholism FROM clean GROUP BY ALL)
    SELECT * FROM a JOIN b USING (age_group, gender, region)""",
)
def j1(spark, sf):
    rows = V.clean_appointments(spark, sf)
    rates = class_diversity(rows, QUASI, ["alcoholism"], "noshow").select(
        *QUASI, F.round("target_rate", 6).alias("target_rate"), "l_alcoholism"
    )
    return join_groups(R.class_sizes(rows, QUASI), rates, QUASI)


@query(
    "j2_lookup_join",
    f"WITH {CLEAN} SELECT appointment_id, neighbourhood, n_nationkey AS neighbourhood_key FROM clean LEFT JOIN nation ON neighbourhood = n_name",
)
def j2(spark, sf):
    lookup = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("neighbourhood_key"))
    rows = V.clean_appointments(spark, sf).select("appointment_id", "neighbourhood")
    return rows.join(lookup, F.col("neighbourhood") == F.col("n_name"), "left").drop("n_name")


@query(
    "j3_semi_join_top",
    f"""WITH {CLEAN}, t AS (SELECT neighbourhood FROM clean GROUP BY 1 ORDER BY count(*) DESC, neighbourhood LIMIT 10)
    SELECT appointment_id, neighbourhood FROM clean WHERE neighbourhood IN (SELECT neighbourhood FROM t)""",
)
def j3(spark, sf):
    rows = V.clean_appointments(spark, sf).select("appointment_id", "neighbourhood")
    return rows.join(top_k(rows, "neighbourhood", 10), "neighbourhood", "left_semi")


@query(
    "j4_anti_join",
    f"""WITH {CLEAN}, t AS (SELECT neighbourhood FROM clean GROUP BY 1 ORDER BY count(*) DESC, neighbourhood LIMIT 10)
    SELECT appointment_id, neighbourhood FROM clean WHERE neighbourhood NOT IN (SELECT neighbourhood FROM t)""",
)
def j4(spark, sf):
    rows = V.clean_appointments(spark, sf).select("appointment_id", "neighbourhood")
    return rows.join(top_k(rows, "neighbourhood", 10), "neighbourhood", "left_anti")


@query(
    "j5_distribution_join",
    f"""WITH {CLEAN}, g AS (SELECT handcap, count(*)::DOUBLE / (SELECT count(*) FROM clean) AS p FROM clean GROUP BY 1),
    c AS (SELECT region, handcap, count(*) AS n FROM clean GROUP BY 1, 2)
    SELECT region, c.handcap, round(n::DOUBLE / sum(n) OVER (PARTITION BY region), 6) AS share, round(p, 6) AS global_share,
    (SELECT round(avg(noshow), 6) FROM clean) AS global_rate FROM c JOIN g ON c.handcap = g.handcap""",
)
def j5(spark, sf):
    rows = V.clean_appointments(spark, sf)
    cells = rows.groupBy("region", "handcap").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("region").agg(F.sum("n").alias("t"))
    levels = cells.groupBy("handcap").agg(F.sum("n").alias("g"))
    total = cells.agg(F.sum("n").alias("t"))
    rate = rows.agg(F.round(F.avg("noshow"), 6).alias("r"))
    return cells.join(totals, "region").join(levels, "handcap").select(
        "region", "handcap", F.round(F.col("n") / F.col("t"), 6).alias("share"),
        F.round(F.col("g") / total.scalar(), 6).alias("global_share"), rate.scalar().alias("global_rate"),
    )


P_GRID, Q_GRID = [0.1, 0.3, 0.5, 0.7, 0.9], [0.1, 0.5, 0.9]


@query(
    "j6_parameter_product",
    f"""WITH {CLEAN}, g AS (SELECT unnest({P_GRID})::DOUBLE AS p), h AS (SELECT unnest({Q_GRID})::DOUBLE AS q),
    r AS (SELECT region, avg(diabetes) AS x FROM clean GROUP BY 1)
    SELECT region, p, q, round((1 - p) * x + p * (1 - q), 6) AS expected_rate FROM r CROSS JOIN g CROSS JOIN h""",
)
def j6(spark, sf):
    rates = V.clean_appointments(spark, sf).groupBy("region").agg(F.avg("diabetes").alias("x"))
    grid = explode_values(explode_values(rates, "p", P_GRID), "q", Q_GRID)
    expected = (1 - F.col("p")) * F.col("x") + F.col("p") * (1 - F.col("q"))
    return grid.select("region", "p", "q", F.round(expected, 6).alias("expected_rate"))


@query(
    "j8_column_bind",
    f"""WITH {CLEAN} SELECT appointment_id, lead_days, CAST(appt_dow = 0 AS INT) AS "ApptDOW_0", CAST(appt_dow = 6 AS INT) AS "ApptDOW_6",
    round(ln(1 + lead_days), 6) AS log_lead_days FROM clean""",
)
def j8(spark, sf):
    rows = V.clean_appointments(spark, sf)
    return rows.select(
        "appointment_id", F.col("lead_days").cast("bigint").alias("lead_days"),
        *[(F.col("appt_dow") == d).cast("int").alias(f"ApptDOW_{d}") for d in (0, 6)],
        F.round(F.log1p("lead_days"), 6).alias("log_lead_days"),
    )


@query(
    "o1_union_results",
    f"""WITH {CLEAN} SELECT 'raw' AS stage, count(*) AS n_classes, CAST(sum(k) AS BIGINT) AS n_rows FROM (SELECT count(*) AS k FROM clean GROUP BY age, gender, neighbourhood)
    UNION ALL SELECT 'generalized', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT count(*) AS k FROM clean GROUP BY age_group, gender, region)""",
)
def o1(spark, sf):
    rows = V.clean_appointments(spark, sf)

    def summary(name, quasi):
        return R.class_sizes(rows, quasi).agg(F.count(F.lit(1)).alias("n_classes"), F.sum("k").alias("n_rows")).select(
            F.lit(name).alias("stage"), "n_classes", "n_rows"
        )

    return summary("raw", ["age", "gender", "neighbourhood"]).unionByName(summary("generalized", QUASI))


@query("o2_distinct_values", f"WITH {CLEAN} SELECT DISTINCT neighbourhood, region, gender FROM clean")
def o2(spark, sf):
    return V.clean_appointments(spark, sf).select("neighbourhood", "region", "gender").distinct()


@query("o2_distinct_count", f"WITH {CLEAN} SELECT count(DISTINCT neighbourhood) AS n_neighbourhoods FROM clean")
def o2b(spark, sf):
    return V.clean_appointments(spark, sf).agg(F.count_distinct("neighbourhood").alias("n_neighbourhoods"))


@query("o3_multi_key_sort", f"WITH {CLEAN} SELECT age, lead_days, noshow, appointment_id FROM clean ORDER BY ALL")
def o3(spark, sf):
    return V.clean_appointments(spark, sf).select("age", F.col("lead_days").cast("bigint").alias("lead_days"), "noshow", "appointment_id").orderBy(
        "age", "lead_days", "noshow", "appointment_id"
    )


@query("o4_sort_by_magnitude", _target_corr_sql(""))
def o4(spark, sf):
    return X.target_correlation(V.clean_appointments(spark, sf), CORR[:-1], "noshow")


@query(
    "o5_smallest_and_largest",
    f"""WITH {CLEAN}, c AS (SELECT age, gender, neighbourhood, count(*) AS k FROM clean GROUP BY ALL)
    (SELECT 'smallest' AS side, * FROM c ORDER BY k, age, gender, neighbourhood LIMIT 10)
    UNION ALL (SELECT 'largest', * FROM c ORDER BY k DESC, age, gender, neighbourhood LIMIT 10)""",
)
def o5(spark, sf):
    keys = ["age", "gender", "neighbourhood"]
    classes = R.class_sizes(V.clean_appointments(spark, sf), keys)
    small = classes.orderBy("k", *keys).limit(10).select(F.lit("smallest").alias("side"), "*")
    large = classes.orderBy(F.desc("k"), *keys).limit(10).select(F.lit("largest").alias("side"), "*")
    return small.unionByName(large)


SAMPLE_SALT = salt("o6", "sample")


@query(
    "o6_sample_without_replacement",
    f"WITH {CLEAN} SELECT appointment_id, noshow FROM clean ORDER BY {uniform_sql(SAMPLE_SALT, 'appointment_id')}, appointment_id LIMIT 1000",
)
def o6(spark, sf):
    rows = V.clean_appointments(spark, sf).select("appointment_id", "noshow")
    return rows.orderBy(uniform(SAMPLE_SALT, "appointment_id"), "appointment_id").limit(1000)
