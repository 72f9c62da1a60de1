"""Queries of the differential privacy and enforcement groups (P1-P17, L7-L9)."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from veil.functions.exprs import explode_values, linspace, param_table
from veil.functions.rand import salt
from veil.operators import dp as DP
from veil.operators import perturb as PT
from veil.operators.profile import histogram
from veil.plans.registry import ORACLES, ADULT, APPT, CLEAN, HEALTH, query, uniform_sql
from veil.plans.risk_queries import QUASI, SENSITIVE
from veil.plans.scan_profile import histogram_sql
from veil.sources import views as V

SEED = "veil"
KEY = "appointment_id"
P0, Q0 = 0.3, 0.5
RAW_QUASI = ["age", "gender", "neighbourhood"]


def _flip_cte(quasi: list[str], src: str = "clean") -> str:
    keys = ", ".join(quasi)
    parts = ["*", f"count(*) OVER (PARTITION BY {keys}) AS k_"]
    for a in SENSITIVE:
        parts.append(f"min({a}) OVER (PARTITION BY {keys}) AS mn_{a}, max({a}) OVER (PARTITION BY {keys}) AS mx_{a}")
        parts.append(f"row_number() OVER (PARTITION BY {keys} ORDER BY {uniform_sql(salt(SEED, a), KEY)}, {KEY}) AS r_{a}")
    flips = ", ".join(
        f"CASE WHEN mn_{a} = mx_{a} AND k_ >= 2 AND r_{a} <= greatest(1, least(k_ // 5, 3))"
        f" AND (SELECT count(DISTINCT {a}) FROM clean) = 2 THEN 1 - {a} ELSE {a} END AS {a}"
        for a in SENSITIVE
    )
    before = ", ".join(f"{a} AS {a}_before" for a in SENSITIVE)
    rest = ", ".join(["patient_id", "appointment_id", "gender", "age", "age_group", "neighbourhood", "region", "handcap", "sms_received",
                      "lead_days", "appt_dow", "appt_month", "sched_dow", "sched_hour", "noshow"])
    return f"w AS (SELECT {', '.join(parts)} FROM {src}), pert AS (SELECT {rest}, {flips}, {before} FROM w)"


PERT = f"{CLEAN}, {_flip_cte(QUASI)}"
PERT_RAW = f"{CLEAN}, {_flip_cte(RAW_QUASI)}"


def perturbed(spark, sf, quasi=QUASI):
    return PT.enforce_diversity(V.clean_appointments(spark, sf), KEY, quasi, SENSITIVE, SEED, keep_before=True)


def _l7_cols(quasi):
    return [KEY, *quasi, *SENSITIVE]


@query("l7_enforce_diversity", f"WITH {PERT} SELECT {', '.join(_l7_cols(QUASI))} FROM pert")
def l7(spark, sf):
    return perturbed(spark, sf).select(*_l7_cols(QUASI))


@query("l7_enforce_diversity_small_classes", f"WITH {PERT_RAW} SELECT {', '.join(_l7_cols(RAW_QUASI))} FROM pert")
def l7b(spark, sf):
    return perturbed(spark, sf, RAW_QUASI).select(*_l7_cols(RAW_QUASI))


def _report_sql() -> str:
    keys = ", ".join(QUASI)
    out = []
    for a in SENSITIVE:
        out.append(
            f"""SELECT '{a}' AS attribute,
            (SELECT count(*) FROM (SELECT 1 FROM pert GROUP BY {keys} HAVING min({a}_before) = max({a}_before))) AS n_failing_before,
            (SELECT count(*) FROM (SELECT 1 FROM pert GROUP BY {keys} HAVING min({a}) = max({a}))) AS n_failing_after,
            count(*) FILTER (WHERE {a} <> {a}_before) AS n_changed,
            round(100 * (count(*) FILTER (WHERE {a} <> {a}_before)::DOUBLE / count(*)), 6) AS pct_changed,
            round(abs(avg({a}) - avg({a}_before)), 6) AS tvd FROM pert"""
        )
    return f"WITH {PERT} " + " UNION ALL ".join(out)


@query("l8_perturbation_report", _report_sql())
def l8(spark, sf):
    return PT.perturbation_report(perturbed(spark, sf), QUASI, SENSITIVE)


def _details_sql() -> str:
    keys = ", ".join(QUASI)
    out = [
        f"""SELECT {keys}, '{a}' AS attribute, CAST(min({a}_before) FILTER (WHERE {a} <> {a}_before) AS VARCHAR) AS original_value,
        CAST(min({a}) FILTER (WHERE {a} <> {a}_before) AS VARCHAR) AS new_value, count(*) FILTER (WHERE {a} <> {a}_before) AS n_flipped,
        count(*) AS class_size FROM pert GROUP BY {keys} HAVING count(*) FILTER (WHERE {a} <> {a}_before) > 0"""
        for a in SENSITIVE
    ]
    return f"WITH {PERT} " + " UNION ALL ".join(out)


@query("l9_perturbation_details", _details_sql())
def l9(spark, sf):
    return PT.perturbation_details(perturbed(spark, sf), QUASI, SENSITIVE)


# parameter grids: each is evaluated against rates of the table
PQ = [(p, 0.5) for p in (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)] + [(0.3, 0.1), (0.5, 0.9)]
PQ_SQL = "pq AS (SELECT * FROM (VALUES " + ", ".join(f"({p}::DOUBLE, {q}::DOUBLE)" for p, q in PQ) + ") t(p, q))"


def rates(spark, sf):
    """(attribute, rate) of the sensitive flags."""
    wide = V.clean_appointments(spark, sf).agg(*[F.avg(a).alias(a) for a in SENSITIVE])
    return wide.unpivot([], SENSITIVE, "attribute", "rate")


RATES = CLEAN + ", rates AS (" + " UNION ALL ".join(f"SELECT '{a}' AS attribute, avg({a}) AS rate FROM clean" for a in SENSITIVE) + ")"


def rate_grid(spark, sf, pairs=PQ):
    packed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in pairs])
    return rates(spark, sf).select("attribute", "rate", F.inline(packed))


@query(
    "p1_epsilon_likelihood",
    f"""WITH {RATES}, {PQ_SQL} SELECT attribute, p, q, round(ln(greatest((1 - p + p * q) / (p * q), (1 - p + p * (1 - q)) / (p * (1 - q)))), 6) AS epsilon,
    round((1 - p) * rate + p * (1 - q), 6) AS expected_rate FROM rates CROSS JOIN pq""",
)
def p1(spark, sf):
    expected = (1 - F.col("p")) * F.col("rate") + F.col("p") * (1 - F.col("q"))
    return rate_grid(spark, sf).select(
        "attribute", "p", "q", F.round(DP.epsilon_likelihood("p", "q"), 6).alias("epsilon"), F.round(expected, 6).alias("expected_rate")
    )


@query(
    "p2_epsilon_product",
    f"""WITH {RATES}, {PQ_SQL} SELECT attribute, p, q, round(-ln(p * q), 6) AS epsilon, round(-ln(greatest(p, 0.000000001) * greatest(q, 0.000000001)), 6) AS epsilon_clipped,
    round(rate, 6) AS rate FROM rates CROSS JOIN pq""",
)
def p2(spark, sf):
    return rate_grid(spark, sf).select(
        "attribute", "p", "q", F.round(DP.epsilon_product("p", "q"), 6).alias("epsilon"),
        F.round(DP.epsilon_product("p", "q", 1e-9), 6).alias("epsilon_clipped"), F.round("rate", 6).alias("rate"),
    )


AXIS = [round(0.1 + 0.05 * i, 2) for i in range(18)]


@query(
    "p3_epsilon_grid",
    f"""WITH {CLEAN}, r AS (SELECT avg(diabetes) AS rate FROM clean), p AS (SELECT unnest({AXIS})::DOUBLE AS p), q AS (SELECT unnest({AXIS})::DOUBLE AS q)
    SELECT p, q, round(-ln(p * q), 6) AS epsilon, round((1 - p * q) * rate / ((1 - p) * rate + p * (1 - q)), 6) AS posterior FROM r CROSS JOIN p CROSS JOIN q""",
)
def p3(spark, sf):
    rate = V.clean_appointments(spark, sf).agg(F.avg("diabetes").alias("rate"))
    grid = explode_values(explode_values(rate, "p", AXIS), "q", AXIS)
    return grid.select(
        "p", "q", F.round(DP.epsilon_product("p", "q"), 6).alias("epsilon"), F.round(DP.posterior("p", "q", "rate"), 6).alias("posterior")
    )


@query(
    "p4_composition",
    f"""WITH {RATES} SELECT count(*) AS n_attributes, round(ln(0.85::DOUBLE / 0.15), 6) AS epsilon, round(ln(0.85::DOUBLE / 0.15) * 5, 6) AS epsilon_total,
    round(sum(rate), 6) AS expected_flags FROM rates""",
)
def p4(spark, sf):
    eps = DP.epsilon_likelihood(P0, Q0)
    return rates(spark, sf).agg(
        F.count(F.lit(1)).alias("n_attributes"), F.round(eps, 6).alias("epsilon"),
        F.round(DP.compose(eps, len(SENSITIVE)), 6).alias("epsilon_total"), F.round(F.sum("rate"), 6).alias("expected_flags"),
    )


def rr_sql(col: str, key: str = KEY, p: float = P0, q: float = Q0, seed: str = SEED, salt_col: str | None = None) -> str:
    name = salt_col or col
    u1, u2 = uniform_sql(salt(seed, name, 0), key), uniform_sql(salt(seed, name, 1), key)
    return f"CASE WHEN {u1} < {p} THEN CASE WHEN {u2} < {q} THEN 0 ELSE 1 END ELSE {col} END"


@query(
    "p5_randomized_response",
    f"WITH {ADULT}, b AS (SELECT person_id, CASE WHEN income = '<=50k' THEN 0 ELSE 1 END AS income_binary FROM adult)"
    f" SELECT person_id, income_binary, {rr_sql('income_binary', 'person_id', 0.5, 0.5)} AS income_dp FROM b",
)
def p5(spark, sf):
    rows = V.adult(spark, sf).select("person_id", F.when(F.col("income") == "<=50k", 0).otherwise(1).alias("income_binary"))
    return rows.select("*", DP.randomized_response("income_binary", "person_id", 0.5, 0.5, SEED).alias("income_dp"))


DP_CTE = f"dpd AS (SELECT *, {', '.join(f'{rr_sql(a)} AS {a}_dp' for a in SENSITIVE)} FROM clean)"


def responded(spark, sf):
    return DP.respond_all(V.clean_appointments(spark, sf), SENSITIVE, KEY, P0, Q0, SEED)


@query("p6_respond_all", f"WITH {CLEAN}, {DP_CTE} SELECT appointment_id, {', '.join(f'{a}, {a}_dp' for a in SENSITIVE)} FROM dpd")
def p6(spark, sf):
    return responded(spark, sf).select(KEY, *SENSITIVE, *[f"{a}_dp" for a in SENSITIVE])


@query(
    "p7_drift_report",
    f"WITH {CLEAN}, {DP_CTE} "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS column_name, round(avg({a}), 6) AS rate_before, round(avg({a}_dp), 6) AS rate_after, round(abs(avg({a}_dp) - avg({a})), 6) AS abs_diff,
        count(*) FILTER (WHERE {a} = 0) AS zeros_before, count(*) FILTER (WHERE {a} = 1) AS ones_before,
        count(*) FILTER (WHERE {a}_dp = 0) AS zeros_after, count(*) FILTER (WHERE {a}_dp = 1) AS ones_after FROM dpd"""
        for a in SENSITIVE
    ),
)
def p7(spark, sf):
    return DP.drift_report(responded(spark, sf), SENSITIVE)


@query("p7_written_report", ORACLES["p7_drift_report"])
def p7_written(spark, sf):
    """The report of P7 from the scan that writes the responses."""
    return DP.respond_all_written(V.clean_appointments(spark, sf), SENSITIVE, KEY, P0, Q0, SEED)[1]


POST_P = linspace(0.1, 1.0, 19)


@query(
    "p8_posterior",
    f"""WITH {RATES}, p AS (SELECT unnest({POST_P})::DOUBLE AS p), q AS (SELECT unnest([0.1, 0.2, 0.3, 0.4])::DOUBLE AS q)
    SELECT attribute, p, q, round((1 - p * q) * rate / ((1 - p) * rate + p * (1 - q)), 6) AS posterior, round(-ln(p * q), 6) AS epsilon FROM rates CROSS JOIN p CROSS JOIN q""",
)
def p8(spark, sf):
    grid = explode_values(explode_values(rates(spark, sf), "p", POST_P), "q", [0.1, 0.2, 0.3, 0.4])
    return grid.select(
        "attribute", "p", "q", F.round(DP.posterior("p", "q", "rate"), 6).alias("posterior"),
        F.round(DP.epsilon_product("p", "q"), 6).alias("epsilon"),
    )


def _estimate_sql(by: str) -> str:
    head, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""WITH {CLEAN}, {DP_CTE}, r AS (SELECT {head}count(*) AS n, avg(hypertension_dp) AS r FROM dpd{group})
    SELECT {head}n, round(r, 6) AS noisy_rate, round((r - {P0} * (1 - {Q0})) / (1 - {P0}), 6) AS estimate, round(r * (1 - r) / (pow(1 - {P0}, 2) * n), 10) AS variance FROM r"""


@query("p9_estimate_by_region", _estimate_sql("region"))
def p9(spark, sf):
    return DP.estimate_groups(responded(spark, sf), "hypertension_dp", ["region"], P0, Q0)


@query("p10_estimate_variance", _estimate_sql(""))
def p10(spark, sf):
    return DP.estimate_groups(responded(spark, sf), "hypertension_dp", [], P0, Q0)


REPS = 500


def _rep_u(begin: int) -> str:
    """A uniform from 13 of the hex digits of a replicate's digest."""
    return f"((('0x'||substr(md5('{SEED}|income_binary|pair|'||rep||'|'||person_id),{begin},13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


@query(
    "p11_simulated_estimates",
    f"""WITH {ADULT}, x AS (SELECT person_id, rep, CASE WHEN {_rep_u(1)} < 0.9 THEN CASE WHEN {_rep_u(14)} < 0.5 THEN 0 ELSE 1 END
     ELSE CASE WHEN income = '<=50k' THEN 0 ELSE 1 END END AS y FROM adult, (SELECT CAST(range AS INT) AS rep FROM range({REPS}))),
    r AS (SELECT rep, count(*) AS n, avg(y) AS r FROM x GROUP BY 1), e AS (SELECT rep, r, (r - 0.9::DOUBLE * 0.5) / (1 - 0.9::DOUBLE) AS e, r * (1 - r) / (pow(1 - 0.9::DOUBLE, 2) * n) AS v FROM r)
    SELECT rep, round(r, 6) AS noisy_rate, round(e, 6) AS estimate, round(v, 10) AS variance,
    round(1 / sqrt(2 * {pi!r} * v) * exp(-pow(e - (SELECT avg(e) FROM e), 2) / (2 * v)), 4) AS normal_density FROM e""",
)
def p11(spark, sf):
    rows = V.adult(spark, sf).select("person_id", F.when(F.col("income") == "<=50k", 0).otherwise(1).alias("income_binary"))
    return DP.simulate_estimates(rows, "income_binary", "person_id", 0.9, 0.5, SEED, REPS)


@query(
    "p12_suppression",
    f"WITH {ADULT} SELECT person_id, income, round(-ln(0.4::DOUBLE), 6) AS epsilon FROM adult WHERE {uniform_sql(salt(SEED, 'suppress'), 'person_id')} >= 0.4",
)
def p12(spark, sf):
    kept = DP.suppress(V.adult(spark, sf).select("person_id", "income"), "person_id", 0.4, SEED)
    return kept.withColumn("epsilon", F.round(DP.suppression_epsilon(0.4), 6))


def lap_sql(u: str, scale: str) -> str:
    return f"(-({scale}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


@query(
    "p13_laplace_sample",
    f"""WITH {ADULT}, s AS (SELECT person_id, {lap_sql(uniform_sql(salt(SEED, 'laplace'), 'person_id'), '1.0::DOUBLE')} AS x FROM adult)
    SELECT person_id, round(x, 6) AS noise, round(exp(-abs(x)) / 2, 6) AS density FROM s""",
)
def p13(spark, sf):
    rows = V.adult(spark, sf).select("person_id", DP.laplace_sample("person_id", 1.0, SEED).alias("x"))
    return rows.select("person_id", F.round("x", 6).alias("noise"), F.round(DP.laplace_density(F.col("x"), 1.0), 6).alias("density"))


NOISED = f"""noised AS (SELECT person_id, income_numerical, income_numerical + {lap_sql(uniform_sql(salt(SEED, 'income_numerical'), 'person_id'),
    '(SELECT max(income_numerical) - min(income_numerical) FROM adult) / 10.0::DOUBLE')} AS income_numerical_dp FROM adult)"""


def noised(spark, sf):
    rows = V.adult(spark, sf).select("person_id", "income_numerical")
    return DP.laplace_mechanism(rows, ["income_numerical"], "person_id", 10.0, SEED)


@query("p14_laplace_mechanism", f"WITH {ADULT}, {NOISED} SELECT person_id, round(income_numerical_dp, 4) AS income_dp FROM noised")
def p14(spark, sf):
    return noised(spark, sf).select("person_id", F.round("income_numerical_dp", 4).alias("income_dp"))


@query(
    "p14_laplace_bounded",
    f"""WITH {ADULT} SELECT person_id, round(greatest(0, least(200000, income_numerical)) + {lap_sql(uniform_sql(salt(SEED, 'income_numerical'), 'person_id'), '200000.0::DOUBLE / 2')}, 4) AS income_dp FROM adult""",
)
def p14b(spark, sf):
    rows = V.adult(spark, sf).select("person_id", "income_numerical")
    out = DP.laplace_mechanism(rows, ["income_numerical"], "person_id", 2.0, SEED, {"income_numerical": (0, 200000)})
    return out.select("person_id", F.round("income_numerical_dp", 4).alias("income_dp"))


LAP_COLS = ["age", "lab_value", "hours_hospitalized"]


@query(
    "p15_laplace_all_numeric",
    f"WITH {HEALTH}, s AS (SELECT " + ", ".join(f"(max({c}) - min({c}))::DOUBLE AS s_{c}" for c in LAP_COLS) + " FROM health) SELECT admission_id, "
    + ", ".join(f"round({c} + {lap_sql(uniform_sql(salt(SEED, c), 'admission_id'), f's_{c} / 1.0::DOUBLE')}, 6) AS {c}_dp" for c in LAP_COLS)
    + " FROM health, s",
)
def p15(spark, sf):
    rows = V.health(spark, sf).select("admission_id", *LAP_COLS)
    out = DP.laplace_mechanism(rows, LAP_COLS, "admission_id", 1.0, SEED)
    return out.select("admission_id", *[F.round(f"{c}_dp", 6).alias(f"{c}_dp") for c in LAP_COLS])


@query("p16_private_mean", f"WITH {ADULT}, {NOISED} SELECT round(avg(income_numerical), 4) AS true_mean, round(avg(income_numerical_dp), 4) AS private_mean FROM noised")
def p16(spark, sf):
    return DP.compare_means(noised(spark, sf), "income_numerical", "income_numerical_dp")


@query("p17_noised_histogram", f"WITH {ADULT}, {NOISED}, {histogram_sql('noised', 'income_numerical_dp', 50, 'right')} SELECT * FROM h")
def p17(spark, sf):
    return histogram(noised(spark, sf), "income_numerical_dp", 50, "right")


@query(
    "p17_private_histogram",
    f"""WITH {ADULT}, {histogram_sql('adult', 'income_numerical', 20)}
    SELECT bin, n, round(n + {lap_sql(uniform_sql(salt(SEED, 'income_numerical'), 'bin'), '1.0::DOUBLE / 0.5')}, 6) AS private_n FROM h""",
)
def p17b(spark, sf):
    return DP.private_histogram(V.adult(spark, sf), "income_numerical", 20, 0.5, SEED)
