"""Queries of splits and metrics (V1-V5, V11-V21, V23, V30) on the fixed score column."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions.rand import salt, uniform
from veil.operators import metrics as M
from veil.operators import split as S
from veil.plans.registry import APPT, CLEAN, SCORED, query, uniform_sql
from veil.sources import views as V

SEED = "veil"
G = uniform_sql(salt(SEED, "group"), "patient_id")


def rounded(df, digits=6):
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


@query("v1_group_split", f"WITH {CLEAN} SELECT appointment_id, patient_id, CASE WHEN {G} < 0.3 THEN 'test' ELSE 'train' END AS side FROM clean")
def v1(spark, sf):
    return S.group_split(V.clean_appointments(spark, sf).select("appointment_id", "patient_id"), "patient_id", 0.3, SEED)


def _lab_u(which: str) -> str:
    return f"((('0x'||substr(md5('{salt(SEED, which)}|'||noshow||'|'||appointment_id),1,13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


@query("v2_stratified_split", f"WITH {CLEAN} SELECT appointment_id, noshow, CASE WHEN {_lab_u('split')} < 0.25 THEN 'test' ELSE 'train' END AS side FROM clean")
def v2(spark, sf):
    return S.stratified_split(V.clean_appointments(spark, sf).select("appointment_id", "noshow"), "noshow", "appointment_id", 0.25, SEED)


@query(
    "v2_stratified_split_exact",
    f"""WITH {CLEAN}, r AS (SELECT appointment_id, noshow, row_number() OVER (PARTITION BY noshow ORDER BY {_lab_u('split')}, appointment_id) AS rk, count(*) OVER (PARTITION BY noshow) AS n FROM clean)
    SELECT appointment_id, noshow, CASE WHEN rk <= round(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS side FROM r""",
)
def v2b(spark, sf):
    rows = V.clean_appointments(spark, sf).select("appointment_id", "noshow")
    return S.stratified_split(rows, "noshow", "appointment_id", 0.3, SEED, exact=True)


@query("v3_folds", f"WITH {CLEAN} SELECT appointment_id, noshow, CAST(floor({_lab_u('fold')} * 5) AS INT) AS fold FROM clean")
def v3(spark, sf):
    return S.assign_folds(V.clean_appointments(spark, sf).select("appointment_id", "noshow"), "noshow", "appointment_id", 5, SEED)


@query(
    "v3_folds_exact",
    f"""WITH {CLEAN} SELECT appointment_id, noshow, CAST((row_number() OVER (PARTITION BY noshow ORDER BY {_lab_u('fold')}, appointment_id) - 1) % 5 AS INT) AS fold FROM clean""",
)
def v3b(spark, sf):
    rows = V.clean_appointments(spark, sf).select("appointment_id", "noshow")
    return S.assign_folds(rows, "noshow", "appointment_id", 5, SEED, exact=True)


@query(
    "v4_split_report",
    f"""WITH {CLEAN} SELECT CASE WHEN {G} < 0.3 THEN 'test' ELSE 'train' END AS side, count(*) AS n_rows, count(DISTINCT patient_id) AS n_groups,
    round(avg(noshow), 6) AS target_rate FROM clean GROUP BY 1""",
)
def v4(spark, sf):
    return S.split_report(S.group_split(V.clean_appointments(spark, sf), "patient_id", 0.3, SEED), "side", "patient_id", "noshow")


@query(
    "v5_class_weights",
    f"""WITH {CLEAN}, c AS (SELECT count(*)::DOUBLE AS n, sum(noshow)::DOUBLE AS p FROM clean)
    SELECT noshow, round(max(CASE WHEN noshow = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END), 6) AS weight, count(*) AS n,
    max(CASE WHEN noshow = 1 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS fixed_weight FROM clean, c GROUP BY 1""",
)
def v5(spark, sf):
    rows = S.class_weights(V.clean_appointments(spark, sf).select("noshow"), "noshow")
    rows = S.class_weights(rows, "noshow", 4.0, "fixed_weight")
    return rows.groupBy("noshow").agg(
        F.round(F.max("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"), F.max("fixed_weight").alias("fixed_weight")
    )


def _thresholds_sql(lo: int, hi: int) -> str:
    values = ", ".join(f"({i / 100}::DOUBLE)" for i in range(lo, hi + 1))
    return f"""th AS (SELECT * FROM (VALUES {values}) t(threshold)), cm AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp,
    count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp, count(*) FILTER (WHERE label = 0 AND score < threshold) AS tn,
    count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn FROM th CROSS JOIN scored GROUP BY 1),
    mt AS (SELECT *, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS spec,
    coalesce((5 * tp)::DOUBLE / nullif(5 * tp + 4 * fn + fp, 0), 0) AS f2, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fn + fp, 0), 0) AS f1 FROM cm)"""


def _choice_sql(min_recall: float) -> str:
    return f"""WITH {SCORED}, {_thresholds_sql(1, 99)}, b AS (SELECT *, (recall + spec) / 2 AS balanced_accuracy, recall >= {min_recall} AS feasible FROM mt)
    SELECT threshold, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(balanced_accuracy, 6) AS balanced_accuracy, feasible FROM b
    ORDER BY feasible DESC, CASE WHEN feasible THEN accuracy ELSE balanced_accuracy END DESC, threshold LIMIT 1"""


@query("v11_choose_threshold", _choice_sql(0.8))
def v11(spark, sf):
    return rounded(M.choose_threshold(V.scored_appointments(spark, sf), 0.8))


@query("v11_choose_threshold_fallback", _choice_sql(1.5))
def v11b(spark, sf):
    return rounded(M.choose_threshold(V.scored_appointments(spark, sf), 1.5))


@query("v11_threshold_table", f"WITH {SCORED}, {_thresholds_sql(1, 99)} SELECT threshold, tp, fp, tn, fn FROM cm")
def v11c(spark, sf):
    return M.threshold_table(V.scored_appointments(spark, sf), M.percent_thresholds(1, 99))


for _metric in ("f2", "f1", "recall"):

    @query(
        f"v12_best_threshold_{_metric}",
        f"WITH {SCORED}, {_thresholds_sql(10, 90)} SELECT threshold, round({_metric}, 6) AS value FROM mt ORDER BY {_metric} DESC, threshold LIMIT 1",
    )
    def _v12(spark, sf, metric=_metric):
        return rounded(M.best_threshold(V.scored_appointments(spark, sf), metric, M.percent_thresholds(10, 90)))


CM = SCORED + """, cm AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.4) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.4) AS fp,
 count(*) FILTER (WHERE label = 0 AND score < 0.4) AS tn, count(*) FILTER (WHERE label = 1 AND score < 0.4) AS fn FROM scored)"""


@query(
    "v13_confusion_matrix",
    f"""WITH {CM} SELECT 0 AS label, 0 AS predicted, tn AS n FROM cm UNION ALL SELECT 0, 1, fp FROM cm UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 1, 1, tp FROM cm""",
)
def v13(spark, sf):
    return M.confusion_cells(V.scored_appointments(spark, sf), 0.4)


METRICS14 = """round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(tp::DOUBLE / (tp + fp), 6) AS precision,
 round(tn::DOUBLE / (tn + fp), 6) AS specificity, round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 6) AS balanced_accuracy,
 round((2 * tp)::DOUBLE / (2 * tp + fp + fn), 6) AS f1, round((5 * tp)::DOUBLE / (5 * tp + 4 * fn + fp), 6) AS f2"""


@query("v14_classification_metrics", f"WITH {CM} SELECT {METRICS14} FROM cm")
def v14(spark, sf):
    return rounded(M.classification_metrics(V.scored_appointments(spark, sf), 0.4))


GROUPED = SCORED + """, sc AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY 1),
 cu AS (SELECT *, sum(pos) OVER w AS hits, sum(neg) OVER w AS alarms, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM sc WINDOW w AS (ORDER BY score DESC))"""


@query("v15_roc_auc", f"WITH {GROUPED} SELECT round(sum(pos * (n - alarms + neg / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)), 6) AS roc_auc FROM cu")
def v15(spark, sf):
    return rounded(M.roc_auc(V.scored_appointments(spark, sf)))


@query("v16_average_precision", f"WITH {GROUPED} SELECT round(sum(pos * (hits::DOUBLE / (hits + alarms))) / max(p), 6) AS pr_auc FROM cu")
def v16(spark, sf):
    return rounded(M.average_precision(V.scored_appointments(spark, sf)))


@query(
    "v17_roc_curve",
    f"WITH {GROUPED} SELECT score AS threshold, round(alarms::DOUBLE / n, 6) AS fpr, round(hits::DOUBLE / p, 6) AS tpr FROM cu UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE",
)
def v17(spark, sf):
    return rounded(M.roc_curve(V.scored_appointments(spark, sf)))


@query("v18_brier_score", f"WITH {SCORED} SELECT round(avg((score - label) * (score - label)), 6) AS brier_score FROM scored")
def v18(spark, sf):
    return rounded(M.brier_score(V.scored_appointments(spark, sf)))


@query(
    "v19_calibration_curve",
    f"""WITH {SCORED} SELECT CAST({' + '.join(f'CAST(score > {i / 10}::DOUBLE AS INT)' for i in range(1, 10))} AS INT) AS bin,
    round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed_rate, count(*) AS n FROM scored GROUP BY 1""",
)
def v19(spark, sf):
    return rounded(M.calibration_curve(V.scored_appointments(spark, sf)))


@query(
    "v20_class_report",
    f"""WITH {CM}, z AS (SELECT tn::DOUBLE / (tn + fn) AS p0, tn::DOUBLE / (tn + fp) AS r0, (2 * tn)::DOUBLE / (2 * tn + fp + fn) AS f0, tn + fp AS s0,
    tp::DOUBLE / (tp + fp) AS p1, tp::DOUBLE / (tp + fn) AS r1, (2 * tp)::DOUBLE / (2 * tp + fp + fn) AS f1, tp + fn AS s1 FROM cm)
    SELECT 'showed' AS row_name, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM z
    UNION ALL SELECT 'no_show', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM z
    UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), s0 + s1 FROM z
    UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6), round((r0 * s0 + r1 * s1) / (s0 + s1), 6), round((f0 * s0 + f1 * s1) / (s0 + s1), 6), s0 + s1 FROM z""",
)
def v20(spark, sf):
    return rounded(M.class_report(V.scored_appointments(spark, sf), 0.4))


@query(
    "v21_workload",
    f"""WITH {CM} SELECT tp + fp AS flagged_count, round(100 * ((tp + fp)::DOUBLE / (tp + fp + tn + fn)), 6) AS flagged_pct,
    round(100 * ((tp + fp)::DOUBLE / (tp + fp + tn + fn)) * (1 - tp::DOUBLE / (tp + fp)), 6) AS wasted_pct FROM cm""",
)
def v21(spark, sf):
    return rounded(M.workload(V.scored_appointments(spark, sf), 0.4))


# two stand-in models on two datasets: the fixed score, and a noisier one
VARIANTS = {("raw", "sharp"): ("s", 0.25), ("raw", "blunt"): ("s2", 0.15), ("protected", "sharp"): ("s3", 0.2), ("protected", "blunt"): ("s4", 0.05)}


def variant_metrics(spark, sf):
    """(dataset, model, metric, value) of keyed scores with different signal."""
    rows = V.appointments(spark, sf).select("appointment_id", (F.col("no_show") == "Yes").cast("int").alias("label"))
    scores = {
        f"{dataset}/{model}": F.round(0.55 * uniform(name, "appointment_id") + pull * F.col("label") + 0.1, 4)
        for (dataset, model), (name, pull) in VARIANTS.items()
    }
    measures = M.rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    wide = M.confusion_by_score(rows, scores, 0.4).select(
        F.split_part("variant", F.lit("/"), F.lit(1)).alias("dataset"), F.split_part("variant", F.lit("/"), F.lit(2)).alias("model"),
        *[c.alias(n) for n, c in measures.items()],
    )
    return wide.unpivot(["dataset", "model"], list(measures), "metric", "value")


def _variants_sql() -> str:
    parts = []
    for (dataset, model), (name, pull) in VARIANTS.items():
        parts.append(
            f"SELECT '{dataset}' AS dataset, '{model}' AS model, CAST(no_show = 'Yes' AS INT) AS label,"
            f" round(0.55::DOUBLE * {uniform_sql(name, 'appointment_id')} + {pull}::DOUBLE * CAST(no_show = 'Yes' AS INT) + 0.1::DOUBLE, 4) AS score FROM appt"
        )
    exprs = {
        "accuracy": "(tp + tn)::DOUBLE / (tp + fp + tn + fn)", "recall": "tp::DOUBLE / (tp + fn)", "precision": "tp::DOUBLE / (tp + fp)",
        "specificity": "tn::DOUBLE / (tn + fp)", "balanced_accuracy": "(tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2",
        "f1": "(2 * tp)::DOUBLE / (2 * tp + fp + fn)", "f2": "(5 * tp)::DOUBLE / (5 * tp + 4 * fn + fp)",
    }
    long = " UNION ALL ".join(f"SELECT dataset, model, '{k}' AS metric, {v} AS value FROM cm" for k, v in exprs.items())
    return f"""{APPT}, sv AS ({' UNION ALL '.join(parts)}), cm AS (SELECT dataset, model, count(*) FILTER (WHERE label = 1 AND score >= 0.4) AS tp,
    count(*) FILTER (WHERE label = 0 AND score >= 0.4) AS fp, count(*) FILTER (WHERE label = 0 AND score < 0.4) AS tn, count(*) FILTER (WHERE label = 1 AND score < 0.4) AS fn
    FROM sv GROUP BY 1, 2), mx AS ({long}), ls AS (SELECT b.model, b.metric, 100 * (b.value - p.value) AS pts, 100 * ((b.value - p.value) / b.value) AS pct
    FROM mx b JOIN mx p ON b.model = p.model AND b.metric = p.metric AND b.dataset = 'raw' AND p.dataset = 'protected')"""


VARIANTS_SQL = _variants_sql()


@query(
    "v22_comparison_table",
    f"WITH {VARIANTS_SQL} SELECT dataset, model, "
    + ", ".join(f"round(max(value) FILTER (WHERE metric = '{m}'), 3) AS {m}" for m in ("accuracy", "recall", "precision", "specificity", "f2"))
    + " FROM mx GROUP BY 1, 2",
)
def v22(spark, sf):
    return M.comparison_table(variant_metrics(spark, sf), ["accuracy", "recall", "precision", "specificity", "f2"])


@query("v23_utility_loss", f"WITH {VARIANTS_SQL} SELECT model, metric, round(pts, 6) AS loss_points, round(pct, 6) AS loss_pct FROM ls")
def v23(spark, sf):
    return M.utility_loss(variant_metrics(spark, sf), "protected", "raw")


@query("v23_mean_loss", f"WITH {VARIANTS_SQL} SELECT model, round(avg(round(pct, 6)), 6) AS mean_loss_pct FROM ls WHERE metric IN ('accuracy', 'recall', 'f2') GROUP BY 1")
def v23b(spark, sf):
    return M.mean_loss(M.utility_loss(variant_metrics(spark, sf), "protected", "raw"), ["accuracy", "recall", "f2"])


@query(
    "v30_best_model",
    f"WITH {VARIANTS_SQL} SELECT dataset, arg_min(model, (-value, model)) AS model, round(max(value), 6) AS value FROM mx WHERE metric = 'balanced_accuracy' GROUP BY 1",
)
def v30(spark, sf):
    return M.best_model(variant_metrics(spark, sf), "balanced_accuracy")
