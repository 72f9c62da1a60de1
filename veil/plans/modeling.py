"""Queries of training, explanation, sweeps, combined protection, release and files (V6-V10, V24-V29, P18-P20, S).

Models have the sizes of the study, which are the operators' own defaults, and every query trains on the whole table; grids,
trials, rows of attribution and permutations are the study's too. The README gives what was measured of their times.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.exprs import join_groups, map_values
from veil.functions.lineage import materialize, scratch_path
from veil.functions.pool import concurrently
from veil.functions.rand import salt, uniform
from veil.operators import explain as X
from veil.operators import metrics as M
from veil.operators import models as ML
from veil.operators import release as R
from veil.operators import split as S
from veil.operators import sweep as W
from veil.operators.clean import flag_score
from veil.plans.clean_features import AGE_CODES, GENDER_CODES
from veil.plans.evaluation import rounded
from veil.plans.privacy_queries import PERT, SEED, lap_sql, rr_sql
from veil.plans.registry import APPT, CLEAN, HEALTH, query, uniform_sql
from veil.plans.risk_queries import SENSITIVE, T
from veil.roles import APPOINTMENT_ROLES as ROLES
from veil.sources import views as V
from veil.sources.tables import read_csv, read_delimited

KEY, GROUP = "appointment_id", "patient_id"
FLAGS = ["hypertension", "diabetes", "alcoholism", "handcap_binary", "scholarship"]
NUMERIC = ["age_code", "gender_code", "lead_days", "log_lead_days", "sms_received", "health_burden", *FLAGS]
CATEGORICAL = ["region", "appt_dow", "sched_dow"]


def labelled(df):
    """The table's own target as label. In the generated tables it is unrelated to the features, so rankings are near chance."""
    return df.withColumn("label", F.col(ROLES.target).cast("int"))


def features(df):
    return df.select(
        KEY, GROUP, "label", "region", "appt_dow", "sched_dow", "lead_days", "sms_received", *FLAGS,
        map_values(F.col("age_group"), AGE_CODES).alias("age_code"), map_values(F.col("gender"), GENDER_CODES).alias("gender_code"),
        F.log1p("lead_days").alias("log_lead_days"), flag_score(FLAGS[:4]).alias("health_burden"),
    )


def baseline(spark, sf):
    """Training rows from the cleaned, unperturbed table."""
    return ML.prepare(features(labelled(V.clean_appointments(spark, sf))), NUMERIC, CATEGORICAL, "label", [KEY, GROUP])


def anonymized(spark, sf):
    """Training rows from the staged release."""
    released, _ = R.staged_release(V.clean_appointments(spark, sf), ROLES, SEED)
    return ML.prepare(features(labelled(released)), NUMERIC, CATEGORICAL, "label", [KEY, GROUP])


LOGISTIC = ML.logistic(max_iter=500)
FOREST = ML.random_forest()
BOOSTING = ML.boosting()
MODELS = (LOGISTIC, FOREST, BOOSTING)


def datasets(spark, sf):
    return {"anonymized": anonymized(spark, sf), "non_anonymized": baseline(spark, sf)}


def holdout(prepared):
    sides = S.group_split(prepared.rows, GROUP, 0.3, SEED)
    return sides.where(F.col("side") == "train"), sides.where(F.col("side") == "test")


def _plain(spec):
    def run(spark, sf):
        train, test = holdout(baseline(spark, sf))
        scored = materialize(ML.score(ML.fit(spec, train), test).select("label", "score"), "scored")
        return rounded(M.evaluate(scored, 0.5), 4)

    return run


query("v6_logistic_regression")(_plain(LOGISTIC))
query("v7_random_forest")(_plain(FOREST))
query("v8_gradient_boosting")(_plain(BOOSTING))


@query("v9_calibrated_ensemble")
def v9(spark, sf):
    train, test = holdout(baseline(spark, sf))
    raw = M.brier_score(ML.score(ML.fit(FOREST, train), test)).select(F.lit("uncalibrated").alias("variant"), "brier_score")
    calibrated = ML.fit_calibrated(FOREST, train, KEY, 3).transform(test)
    return raw.unionByName(M.brier_score(calibrated).select(F.lit("calibrated").alias("variant"), "brier_score"))


@query("v10_out_of_fold")
def v10(spark, sf):
    def scored(name, prep, spec):
        found = ML.out_of_fold(spec, holdout(prep)[0], KEY, folds=5, inner=3)
        return found.select(F.lit(name).alias("dataset"), F.lit(spec.name).alias("model"), "*")

    runs = [partial(scored, name, prep, spec) for name, prep in datasets(spark, sf).items() for spec in MODELS]
    return reduce(DataFrame.unionByName, concurrently(spark, runs, 2))


MEASURES = ["threshold", "accuracy", "recall", "precision", "specificity", "roc_auc", "pr_auc", "f2", "brier_score", "flagged_pct"]
LOSSES = ["accuracy", "recall", "f2", "roc_auc"]


def trained_metrics(spark, sf):
    """(dataset, model, metric, value) of all models trained on both datasets, written once."""
    return ML.comparison_study({name: prep.rows for name, prep in datasets(spark, sf).items()}, MODELS, KEY, GROUP, folds=5, inner=3)


@query("v10_train_and_evaluate")
def v10b(spark, sf):
    """Comparison (V22), utility loss of each model (V23) and the best model of each dataset (V30), all from trained models."""
    metrics = trained_metrics(spark, sf)
    losses = M.utility_loss(metrics, "anonymized", "non_anonymized").where(F.col("metric").isin(LOSSES))
    cells = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}") for m in LOSSES for c in ("loss_points", "loss_pct")]
    best = M.best_model(metrics).select("dataset", F.col("model").alias("best_model"))
    table = M.comparison_table(metrics, MEASURES).join(losses.groupBy("model").agg(*cells), "model").join(best, "dataset")
    return table.select("dataset", "model", *MEASURES, *[f"{c}_{m}" for m in LOSSES for c in ("loss_points", "loss_pct")], "best_model")


@query("v24_feature_importance")
def v24(spark, sf):
    prepared = datasets(spark, sf)
    runs = {(name, spec.name): partial(lambda prep, spec: ML.fit(spec, holdout(prep)[0]), prep, spec) for name, prep in prepared.items() for spec in MODELS}
    models = dict(zip(runs, concurrently(spark, list(runs.values()))))
    return ML.importance_table(spark, models, {name: prep.names for name, prep in prepared.items()}, 10)


@query("v25_permutation_importance")
def v25(spark, sf):
    prep = baseline(spark, sf)
    train, test = holdout(prep)
    return X.forest_permutation_importance(ML.fit(FOREST, train), test, prep.names, KEY, repeats=10)


SHAPLEY_ROWS = 1000  # the study explains 800 to 1,000 rows


@query("v26_shapley_attribution")
def v26(spark, sf):
    prep = baseline(spark, sf)
    train, test = holdout(prep)
    sample = materialize(test.orderBy(uniform(salt(SEED, "sample"), KEY), KEY).limit(SHAPLEY_ROWS), "sample")
    return X.mean_absolute(X.forest_shapley_values(ML.fit(FOREST, train), sample, prep.names, KEY))


SWEEP_GRID = [(x / 100, 0.5) for x in range(5, 85, 5)]
SWEEP_TRIALS = 10


@query("v27_response_model_sweep")
def v27(spark, sf):
    rows = materialize(features(labelled(V.clean_appointments(spark, sf))), "sweep")
    split = lambda df, seed: S.stratified_split(df, "label", KEY, 0.3, seed)
    return W.response_model_sweep(rows, FLAGS, NUMERIC, CATEGORICAL, "label", KEY, ML.random_forest(trees=100, depth=10, min_leaf=1), SWEEP_GRID, SWEEP_TRIALS, split)


def _sweep_sql(trials: int = 10) -> str:
    cells = []
    for p, q in SWEEP_GRID:
        for t in range(trials):
            cells.append(
                f"SELECT {p}::DOUBLE AS p, {q}::DOUBLE AS q, abs((avg({rr_sql('hypertension', KEY, p, q, f'sweep{t}')}) - {p}::DOUBLE * (1 - {q}::DOUBLE)) / (1 - {p}::DOUBLE) - avg(hypertension)) AS error FROM clean"
            )
    return f"""WITH {CLEAN}, e AS ({' UNION ALL '.join(cells)}) SELECT p, q, round(avg(error), 6) AS error, round(stddev_pop(error), 6) AS error_std,
    round(ln(greatest((1 - p + p * q) / (p * q), (1 - p + p * (1 - q)) / (p * (1 - q)))), 6) AS epsilon FROM e GROUP BY 1, 2"""


@query("v27_response_estimate_sweep", _sweep_sql())
def v27b(spark, sf):
    return rounded(W.response_estimate_sweep(V.clean_appointments(spark, sf), "hypertension", KEY, SWEEP_GRID, SWEEP_TRIALS))


HEALTH_NUM, HEALTH_CAT = ["age", "hours_hospitalized", "released_sameday", "severity"], ["hospital", "marital_status"]


def health_rows(spark, sf):
    """Admissions with a target that depends on age and a noisy severity, split once."""
    rows = V.health(spark, sf).drop("lab_value", "admitted_ts", "has_diabetes")
    u = uniform(salt("label", "diabetes"), "admission_id")
    severity = F.round(100 * uniform(salt("label", "severity"), "admission_id"), 3)
    rows = rows.withColumn("severity", severity).withColumn(
        "has_diabetes", (u < 0.1 + 0.4 * F.col("age") / 95 + 0.4 * F.col("severity") / 100).cast("int")
    )
    return S.stratified_split(rows, "has_diabetes", "admission_id", 0.25, SEED)


def protect_health(df, epsilon, p, q, k, max_depth=None):
    return R.protect(df, "admission_id", ["age", "hours_hospitalized", "severity"], ["released_sameday"], ["age", "hospital", "marital_status"],
                     epsilon, p, q, k, SEED, max_depth)


SWEEP_EPSILON, SWEEP_P = [0.2, 0.5, 1.0, 2.0, 5.0], [0.1, 0.2, 0.3, 0.5, 0.7]
SWEEP_K = [2, 3, 5, 8, 10]  # splitting ends at k: a fixed depth would end it at the same partitions for all of them


# the study's trees have no depth limit; 30 is the most that Spark takes
HEALTH_MODELS = (
    ML.logistic(weight=None), ML.random_forest(trees=250, depth=30, min_leaf=1, weight=None),
    ML.boosting(rounds=100, depth=3, rate=0.1, subsample=1.0, feature_share=1.0, min_leaf=1, weight=None),
)


@query("v28_isolated_sweeps")
def v28(spark, sf):
    rows = materialize(health_rows(spark, sf), "health")
    return W.isolated_sweeps(rows, protect_health, HEALTH_NUM, HEALTH_CAT, "has_diabetes", "admission_id", HEALTH_MODELS, SWEEP_EPSILON, SWEEP_P, SWEEP_K, max_depth=None, seed=SEED)


@query("v29_unprotected_baseline")
def v29(spark, sf):
    ready = W.split_inputs(health_rows(spark, sf), HEALTH_NUM, HEALTH_CAT, "has_diabetes", "admission_id")
    measured = concurrently(spark, [partial(W.evaluate_prepared, spec, ready) for spec in HEALTH_MODELS])
    return reduce(DataFrame.unionByName, [rounded(m, 4).withColumn("model", F.lit(s.name)) for s, m in zip(HEALTH_MODELS, measured)])


@query("p18_combined_protection")
def p18(spark, sf):
    return protect_health(health_rows(spark, sf), 1.0, 0.3, 0.5, 100)


def _health_sql() -> str:
    """`health_rows` in the oracle dialect."""
    u = lambda name: uniform_sql(salt("label", name), "admission_id")
    label = f"CAST({u('diabetes')} < 0.1::DOUBLE + 0.4::DOUBLE * age / 95 + 0.4::DOUBLE * severity / 100 AS INT)"
    side = f"CASE WHEN {uniform_sql(salt(SEED, 'split'), "has_diabetes || '|' || admission_id")} < 0.25 THEN 'test' ELSE 'train' END"
    return f"""{HEALTH}, sev AS (SELECT admission_id, age, hours_hospitalized, released_sameday, round(100 * {u('severity')}, 3) AS severity FROM health),
     lab AS (SELECT *, {label} AS has_diabetes FROM sev), hr AS (SELECT *, {side} AS side FROM lab)"""


def _noised_sql(column: str) -> str:
    return f"round({column} + {lap_sql(uniform_sql(salt(SEED, column, 0), 'admission_id'), f'(SELECT (max({column}) - min({column}))::DOUBLE FROM hr)')}, 4) AS {column}"


@query(
    "p18_row_parts",
    f"""WITH {_health_sql()} SELECT admission_id, {_noised_sql('hours_hospitalized')}, {_noised_sql('severity')},
    {rr_sql('released_sameday', 'admission_id', 0.3, 0.5)} AS released_sameday, has_diabetes, side FROM hr""",
)
def p18_rows(spark, sf):
    """All that combined protection does row by row: noise, randomized response, and columns it must leave alone."""
    out = protect_health(health_rows(spark, sf), 1.0, 0.3, 0.5, 100)
    return out.select("admission_id", F.round("hours_hospitalized", 4).alias("hours_hospitalized"), F.round("severity", 4).alias("severity"), "released_sameday", "has_diabetes", "side")


@query("p18_class_guarantee", "SELECT count(*) AS n_rows, true AS all_classes_reach_k FROM events HAVING count(*) >= 100")
def p18_classes(spark, sf):
    """Combined protection releases every row, in classes of k or more."""
    classes = protect_health(health_rows(spark, sf), 1.0, 0.3, 0.5, 100).groupBy("age", "hospital", "marital_status").agg(F.count(F.lit(1)).alias("n"))
    return classes.agg(F.sum("n").alias("n_rows"), (F.min("n") >= 100).alias("all_classes_reach_k"))


_UTIL = ["lead_days", "appt_dow", "appt_month", "sched_dow", "sms_received"]
RELEASE = (
    f"{PERT}, rel AS (SELECT appointment_id, patient_id, age_group, gender, region, {', '.join(_UTIL)}, "
    + ", ".join(f"{rr_sql(a)} AS {a}" for a in SENSITIVE) + ", noshow FROM pert)"
)


@query(
    "p19_staged_release",
    f"""WITH {RELEASE} SELECT age_group, gender, region, CAST(lead_days AS INT) AS lead_days, appt_dow, appt_month, sched_dow, sms_received, {', '.join(SENSITIVE)}, noshow,
    round(ln(1 + lead_days), 6) AS log_lead_days, hypertension + diabetes + alcoholism + handcap_binary AS health_burden FROM rel""",
)
def p19(spark, sf):
    released, _ = R.staged_release(V.clean_appointments(spark, sf), ROLES, SEED)
    return released.drop(KEY, GROUP).withColumn("log_lead_days", F.round(F.log1p("lead_days"), 6)).withColumn(
        "health_burden", flag_score(["hypertension", "diabetes", "alcoholism", "handcap_binary"])
    )


def _guarantee_sql() -> str:
    ls = ", ".join(f"count(DISTINCT {a})" for a in SENSITIVE)
    eps = "ln(0.85::DOUBLE / 0.15)"
    return f"""WITH {PERT}, d AS (SELECT age_group, gender, region, count(*) AS k, least({ls}) AS min_l, round(abs(avg(noshow) - (SELECT avg(noshow) FROM pert)), 9) AS distance FROM pert GROUP BY ALL)
    SELECT 'min_k' AS guarantee, min(k)::DOUBLE AS value FROM d UNION ALL SELECT 'n_classes', count(*)::DOUBLE FROM d
    UNION ALL SELECT 'l_diverse_classes', count(*) FILTER (WHERE min_l >= 2)::DOUBLE FROM d UNION ALL SELECT 't_close_classes', count(*) FILTER (WHERE distance <= {T})::DOUBLE FROM d
    UNION ALL SELECT 'epsilon', round({eps}, 6) UNION ALL SELECT 'epsilon_total', round({eps} * 5, 6)"""


@query("p20_guarantees", _guarantee_sql())
def p20(spark, sf):
    _, perturbed = R.staged_release(V.clean_appointments(spark, sf), ROLES, SEED)
    return R.guarantees(perturbed, ROLES, T, 0.3, 0.5)


@query("s1_csv_with_schema", f"WITH {APPT} SELECT CAST(patient_id AS VARCHAR) AS patient_id, appointment_id, gender, age, neighbourhood, no_show FROM appt")
def s1(spark, sf):
    path = scratch_path(spark, "csv")
    V.appointments(spark, sf).select("patient_id", "appointment_id", "gender", "age", "neighbourhood", "no_show").write.option("header", True).csv(path)
    return read_csv(spark, path, "patient_id string, appointment_id bigint, gender string, age int, neighbourhood string, no_show string")


@query(
    "s2_headerless_delimited",
    "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS priority, o_totalprice AS price FROM orders",
)
def s2(spark, sf):
    from pyspark.sql import types as T_

    from veil.sources.tables import table

    path = scratch_path(spark, "delimited")
    line = F.concat_ws(", ", F.col("o_orderkey").cast("string"), "o_orderpriority", F.col("o_totalprice").cast("string"))
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return read_delimited(spark, path, ["key", "priority", "price"], {"price": T_.DoubleType()}, ", ")


@query("s3_csv_inferred", f"WITH {APPT} SELECT CAST(patient_id AS VARCHAR) AS patient_id, age, handcap, region FROM appt")
def s3(spark, sf):
    path = scratch_path(spark, "csv")
    V.appointments(spark, sf).select("patient_id", "age", "handcap", "region").write.option("header", True).csv(path)
    return read_csv(spark, path, strings=["patient_id"])


def _release_sql() -> str:
    ls = ", ".join(f"count(DISTINCT {a})" for a in SENSITIVE)
    return f"""WITH {RELEASE}, ok AS (SELECT age_group, gender, region FROM pert GROUP BY ALL
     HAVING count(*) >= 2 AND least({ls}) >= 2 AND round(abs(avg(noshow) - (SELECT avg(noshow) FROM pert)), 9) <= {T})
    SELECT rel.age_group, rel.gender, rel.region, CAST(lead_days AS INT) AS lead_days, appt_dow, appt_month, sched_dow, sms_received, {', '.join(SENSITIVE)}, noshow
    FROM rel JOIN ok ON rel.age_group IS NOT DISTINCT FROM ok.age_group AND rel.gender IS NOT DISTINCT FROM ok.gender AND rel.region IS NOT DISTINCT FROM ok.region"""


@query("s5_release_sink", _release_sql())
def s5(spark, sf):
    """Rows of classes that fulfil k 2, l 2 and t 0.2, the study's t; small tables have classes that do not, which are withheld."""
    released, perturbed = R.staged_release(V.clean_appointments(spark, sf), ROLES, SEED)
    kept = materialize(R.releasable_classes(perturbed, ROLES, 2, 2, T), "releasable")
    of = lambda df: join_groups(df, kept, ROLES.quasi, "left_semi")
    path = scratch_path(spark, "release")
    R.write_release(of(released), ROLES, path, k=2, l=2, t=T, verified=of(perturbed), partition_by=["region"], population=perturbed)
    return spark.read.parquet(path)


@query(
    "s6_results_sink",
    f"""WITH {CLEAN} SELECT 'raw' AS stage, count(*) AS n_classes FROM (SELECT 1 FROM clean GROUP BY age, gender, neighbourhood)
    UNION ALL SELECT 'generalized', count(*) FROM (SELECT 1 FROM clean GROUP BY age_group, gender, region)""",
)
def s6(spark, sf):
    from veil.operators.risk import class_sizes, risk_profile

    rows, path = V.clean_appointments(spark, sf), scratch_path(spark, "results")
    for name, quasi in (("raw", ["age", "gender", "neighbourhood"]), ("generalized", ROLES.quasi)):
        profile = risk_profile(class_sizes(rows, quasi)).select(F.lit(name).alias("stage"), "n_classes")
        R.write_results(profile, path)
    return spark.read.parquet(path)
