"""Queries of the k, l and t measures (K, L1-L6, T)."""

from __future__ import annotations

from math import log

from pyspark.sql import functions as F

from veil.operators import diversity as D
from veil.operators import risk as R
from veil.plans.registry import CLEAN, query
from veil.sources import views as V

QUASI = ["age_group", "gender", "region"]
RAW_QUASI = ["age", "gender", "neighbourhood"]
SENSITIVE = ["alcoholism", "hypertension", "diabetes", "handcap_binary", "scholarship"]

Q, RQ = ", ".join(QUASI), ", ".join(RAW_QUASI)
CLASSES = f"{CLEAN}, raw_k AS (SELECT {RQ}, count(*) AS k FROM clean GROUP BY ALL), gen_k AS (SELECT {Q}, count(*) AS k FROM clean GROUP BY ALL)"
_LS = ", ".join(f"count(DISTINCT {c}) AS l_{c}" for c in SENSITIVE)
_LEAST = "least(" + ", ".join(f"l_{c}" for c in SENSITIVE) + ")"
DIV = f"""{CLASSES}, div0 AS (SELECT {Q}, count(*) AS k, {_LS}, avg(noshow) AS target_rate FROM clean GROUP BY ALL),
 div AS (SELECT *, {_LEAST} AS min_l, round(abs(target_rate - (SELECT avg(noshow) FROM clean)), 9) AS distance FROM div0)"""


def classes(spark, sf, quasi=QUASI):
    return R.class_sizes(V.clean_appointments(spark, sf), quasi)


def diversity(spark, sf):
    return D.class_diversity(V.clean_appointments(spark, sf), QUASI, SENSITIVE, "noshow")


@query("k1_class_sizes", f"WITH {CLASSES} SELECT * FROM gen_k")
def k1(spark, sf):
    return classes(spark, sf)


@query("k1_class_sizes_raw", f"WITH {CLASSES} SELECT * FROM raw_k")
def k1b(spark, sf):
    return classes(spark, sf, RAW_QUASI)


def profile_sql(source: str, k: int = 5) -> str:
    return (
        f"SELECT count(*) AS n_classes, count(*) FILTER (WHERE k = 1) AS n_singletons, count(*) FILTER (WHERE k < {k}) AS n_below_k,"
        f" round(100 * (coalesce(sum(k) FILTER (WHERE k < {k}), 0)::DOUBLE / sum(k)), 6) AS pct_records_at_risk FROM {source}"
    )


@query("k2_risk_profile", f"WITH {CLASSES} {profile_sql('raw_k')}")
def k2(spark, sf):
    return R.risk_profile(classes(spark, sf, RAW_QUASI))


@query("k3_riskiest_classes", f"WITH {CLASSES} SELECT * FROM raw_k ORDER BY k, {RQ} LIMIT 10")
def k3(spark, sf):
    return R.riskiest(classes(spark, sf, RAW_QUASI), RAW_QUASI)


@query(
    "k4_size_distribution",
    f"""WITH {CLASSES} SELECT count(*) AS n_classes, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS std, min(k) AS min_k,
    round(quantile_cont(k::DOUBLE, 0.25), 6) AS q25, round(quantile_cont(k::DOUBLE, 0.5), 6) AS median, round(quantile_cont(k::DOUBLE, 0.75), 6) AS q75, max(k) AS max_k FROM gen_k""",
)
def k4(spark, sf):
    return R.size_distribution(classes(spark, sf))


def _k4_hist() -> str:
    from veil.plans.scan_profile import histogram_sql

    return f"WITH {CLASSES}, {histogram_sql('raw_k', 'k', 20)} SELECT * FROM h"


@query("k4_size_histogram", _k4_hist())
def k4b(spark, sf):
    return R.size_histogram(classes(spark, sf, RAW_QUASI))


def _stage(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS stage, n_classes, min_k, median, max_k, n_singletons, n_below_k, pct_records_at_risk FROM ({profile_sql(source)}),"
        f" (SELECT min(k) AS min_k, round(quantile_cont(k::DOUBLE, 0.5), 6) AS median, max(k) AS max_k FROM {source})"
    )


@query("k5_before_after", f"WITH {CLASSES} {_stage('before', 'raw_k')} UNION ALL {_stage('after', 'gen_k')}")
def k5(spark, sf):
    return R.compare_stages({"before": classes(spark, sf, RAW_QUASI), "after": classes(spark, sf)})


@query(
    "k6_record_risk",
    f"""WITH {CLEAN} SELECT appointment_id, {RQ}, count(*) OVER (PARTITION BY {RQ}) AS k,
    round(1::DOUBLE / count(*) OVER (PARTITION BY {RQ}), 6) AS risk, count(*) OVER (PARTITION BY {RQ}) < 5 AS at_risk FROM clean""",
)
def k6(spark, sf):
    return R.record_risk(V.clean_appointments(spark, sf).select("appointment_id", *RAW_QUASI), RAW_QUASI)


_LCOLS = ", ".join(f"l_{c}" for c in SENSITIVE)


@query("l1_class_diversity", f"WITH {DIV} SELECT {Q}, k, {_LCOLS}, min_l, round(target_rate, 6) AS target_rate FROM div")
def l1(spark, sf):
    return diversity(spark, sf).withColumn("target_rate", F.round("target_rate", 6))


@query(
    "l1_multi_valued_diversity",
    f"""WITH {CLEAN} SELECT {RQ}, count(*) AS k, count(DISTINCT handcap) AS l_handcap, count(DISTINCT appt_month) AS l_appt_month,
    least(count(DISTINCT handcap), count(DISTINCT appt_month)) AS min_l FROM clean GROUP BY ALL""",
)
def l1b(spark, sf):
    return D.class_diversity(V.clean_appointments(spark, sf), RAW_QUASI, ["handcap", "appt_month"], binary=[])


@query(
    "l2_compliance",
    f"""WITH {DIV} SELECT count(*) AS n_classes, count(*) FILTER (WHERE min_l < 2) AS n_failing, count(*) FILTER (WHERE min_l >= 2) AS n_passing,
    round(100 * (coalesce(sum(k) FILTER (WHERE min_l < 2), 0)::DOUBLE / sum(k)), 6) AS pct_records_failing,
    round(100 * (coalesce(sum(k) FILTER (WHERE min_l >= 2), 0)::DOUBLE / sum(k)), 6) AS pct_records_passing FROM div""",
)
def l2(spark, sf):
    return D.compliance(diversity(spark, sf))


@query(
    "l3_compliance_by_attribute",
    f"WITH {DIV} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS attribute, count(*) FILTER (WHERE l_{c} < 2) AS n_failing, count(*) FILTER (WHERE l_{c} >= 2) AS n_passing,"
        f" round(100 * (coalesce(sum(k) FILTER (WHERE l_{c} >= 2), 0)::DOUBLE / sum(k)), 6) AS pct_records_passing FROM div"
        for c in SENSITIVE
    ),
)
def l3(spark, sf):
    return D.compliance_by_attribute(diversity(spark, sf), SENSITIVE)


@query("l4_largest_failing", f"WITH {DIV} SELECT {Q}, k, {_LCOLS}, min_l FROM div WHERE min_l < 2 ORDER BY k DESC, {Q} LIMIT 10")
def l4(spark, sf):
    return D.largest_failing(diversity(spark, sf), QUASI).drop("target_rate")


@query(
    "l5_single_attribute",
    f"""WITH {CLEAN}, d AS (SELECT {RQ}, count(*) AS k, count(DISTINCT noshow) AS min_l FROM clean GROUP BY ALL)
    SELECT min_l, count(*) AS n_classes, CAST(sum(k) AS BIGINT) AS n_records, round(100 * (count(*)::DOUBLE / (SELECT count(*) FROM d)), 6) AS pct_classes FROM d GROUP BY 1""",
)
def l5(spark, sf):
    return D.diversity_levels(D.class_diversity(V.clean_appointments(spark, sf), RAW_QUASI, ["noshow"]))


@query(
    "l6_records_per_level",
    f"""WITH {DIV} SELECT min_l, count(*) AS n_classes, CAST(sum(k) AS BIGINT) AS n_records, round(100 * (count(*)::DOUBLE / (SELECT count(*) FROM div)), 6) AS pct_classes FROM div GROUP BY 1""",
)
def l6(spark, sf):
    return D.diversity_levels(diversity(spark, sf))


T = 0.05


@query("t1_rate_distance", f"WITH {DIV} SELECT {Q}, k, round(target_rate, 6) AS target_rate, round(distance, 6) AS distance, distance <= {T} AS t_close FROM div")
def t1(spark, sf):
    out = D.rate_distance(diversity(spark, sf), T)
    return out.select(*QUASI, "k", F.round("target_rate", 6).alias("target_rate"), F.round("distance", 6).alias("distance"), "t_close")


def _freq_distance_sql(quasi: list[str], attr: str) -> str:
    keys = ", ".join(quasi)
    same = " AND ".join(f"c.{k} IS NOT DISTINCT FROM x.{k}" for k in quasi)
    return f"""cls AS (SELECT {keys}, count(*) AS k FROM clean GROUP BY ALL), gl AS (SELECT {attr} AS lv, count(*)::DOUBLE / (SELECT count(*) FROM clean) AS g FROM clean GROUP BY 1),
    cnt AS (SELECT {keys}, {attr} AS lv, count(*) AS n FROM clean GROUP BY ALL),
    td AS (SELECT {', '.join('c.' + k for k in quasi)}, c.k, max(abs(coalesce(x.n, 0)::DOUBLE / c.k - g)) AS distance
     FROM cls c CROSS JOIN gl LEFT JOIN cnt x ON {same} AND x.lv = gl.lv GROUP BY ALL)"""


@query("t2_frequency_distance", f"WITH {CLEAN}, {_freq_distance_sql(RAW_QUASI, 'handcap')} SELECT {RQ}, round(distance, 6) AS distance FROM td")
def t2(spark, sf):
    out = D.frequency_distance(V.clean_appointments(spark, sf), RAW_QUASI, "handcap")
    return out.withColumn("distance", F.round("distance", 6))


@query(
    "t3_closeness_summary",
    f"""WITH {DIV} SELECT count(*) AS n_classes, count(*) FILTER (WHERE distance <= {T}) AS n_close,
    round(100 * (count(*) FILTER (WHERE distance <= {T})::DOUBLE / count(*)), 6) AS pct_classes_close,
    round(100 * (coalesce(sum(k) FILTER (WHERE distance <= {T}), 0)::DOUBLE / sum(k)), 6) AS pct_records_close FROM div""",
)
def t3(spark, sf):
    return D.closeness_summary(D.rate_distance(diversity(spark, sf), T), T)


@query("t3_violations", f"WITH {DIV} SELECT {Q}, k, round(distance, 6) AS distance FROM div WHERE distance > {T} ORDER BY k DESC, {Q} LIMIT 10")
def t3b(spark, sf):
    out = D.closeness_violations(D.rate_distance(diversity(spark, sf), T), QUASI, T)
    return out.select(*QUASI, "k", F.round("distance", 6).alias("distance"))


@query(
    "t4_distribution_shift",
    f"""WITH {CLEAN}, p AS (SELECT handcap AS v, count(*)::DOUBLE / (SELECT count(*) FROM clean) AS p FROM clean GROUP BY 1),
    q AS (SELECT handcap_binary AS v, count(*)::DOUBLE / (SELECT count(*) FROM clean) AS q FROM clean GROUP BY 1)
    SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tvd FROM p FULL JOIN q ON p.v = q.v""",
)
def t4(spark, sf):
    return D.distribution_shift(V.clean_appointments(spark, sf), "handcap", "handcap_binary")


def scorecard_sql(div: str = "div") -> str:
    stages = [("min_k", "min(k)"), ("median_k", "median(k)"), ("classes_below_k", "count(*) FILTER (WHERE k < 5)"),
              ("pct_records_at_risk", "round(100 * (coalesce(sum(k) FILTER (WHERE k < 5), 0)::DOUBLE / sum(k)), 6)")]
    parts = [
        f"SELECT '{m}' AS metric, (SELECT {e} FROM raw_k)::DOUBLE AS before, (SELECT {e} FROM gen_k)::DOUBLE AS after" for m, e in stages
    ]
    for m, e in (("classes_failing_l", "min_l < 2"), ("classes_passing_l", "min_l >= 2"), ("classes_t_close", f"distance <= {T}")):
        parts.append(f"SELECT '{m}', NULL::DOUBLE, (SELECT count(*) FILTER (WHERE {e}) FROM {div})::DOUBLE")
    return " UNION ALL ".join(parts)


@query("t5_scorecard", f"WITH {DIV} {scorecard_sql()}")
def t5(spark, sf):
    return D.scorecard(classes(spark, sf, RAW_QUASI), classes(spark, sf), D.rate_distance(diversity(spark, sf), T))


EPSILON = log((0.7 + 0.15) / 0.15)


@query(
    "t6_compliance_scores",
    f"""WITH {DIV} SELECT 'k_anonymity' AS technique, round(least(min(k) / 100.0::DOUBLE, 1), 6) AS score FROM div
    UNION ALL SELECT 'l_diversity', round(count(*) FILTER (WHERE min_l >= 2)::DOUBLE / count(*), 6) FROM div
    UNION ALL SELECT 't_closeness', round(count(*) FILTER (WHERE distance <= {T})::DOUBLE / count(*), 6) FROM div
    UNION ALL SELECT 'differential_privacy', round(least(1 / ln(0.85::DOUBLE / 0.15), 1), 6)""",
)
def t6(spark, sf):
    return D.compliance_scores(D.rate_distance(diversity(spark, sf), T), EPSILON)
