"""Registered model and protection queries do the whole job: no fixed depth, full grids, all models."""

from pyspark.sql import functions as F

from veil.plans import QUERIES, modeling


def test_k_alone_ends_splitting_in_p18(spark):
    out = QUERIES["p18_combined_protection"](spark, "/root/testdata/sf0.01")
    boxes = out.groupBy("age", "hospital", "marital_status").agg(F.count(F.lit(1)).alias("n"))
    sizes = [r["n"] for r in boxes.collect()]
    assert sum(sizes) == 10_000 and min(sizes) >= 100
    assert len(sizes) > 32  # what a depth of 5 allows


def test_k_of_the_sweep_decides(spark, sf_dir, monkeypatch):
    rows, found, partition = modeling.health_rows(spark, sf_dir), [], modeling.R.partition
    monkeypatch.setattr(modeling.R, "partition", lambda *a, **b: found.append(partition(*a, **b)) or found[-1])
    for k in (modeling.SWEEP_K[0], modeling.SWEEP_K[-1]):
        modeling.protect_health(rows, None, None, None, k)
    fine, coarse = (p.cells.select("part_id").distinct().count() for p in found)
    assert modeling.SWEEP_K == [2, 3, 5, 8, 10] and fine > coarse > 16  # 16: what a depth of 4 allows


def test_v28_passes_no_depth(spark, sf_dir, monkeypatch):
    seen = {}
    monkeypatch.setattr(modeling.W, "isolated_sweeps", lambda *a, **b: seen.update(args=a, **b))
    QUERIES["v28_isolated_sweeps"](spark, sf_dir)
    assert seen["max_depth"] is None and modeling.SWEEP_K in seen["args"]
    assert [s.name for s in seen["args"][6]] == ["logistic", "random_forest", "boosting"]


def test_registered_sizes_are_those_of_the_study(spark, sf_dir, monkeypatch):
    forest, boosting = modeling.FOREST.build(1.0), modeling.BOOSTING.build(1.0)
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (400, 16)
    assert (boosting.getMaxIter(), boosting.getMaxDepth(), boosting.getStepSize()) == (400, 8, 0.05)
    assert len(modeling.SWEEP_GRID) == 16 and modeling.SWEEP_TRIALS == 10 and modeling.SHAPLEY_ROWS >= 800
    assert len(modeling.SWEEP_EPSILON) == len(modeling.SWEEP_P) == len(modeling.SWEEP_K) == 5
    seen = {}
    monkeypatch.setattr(modeling.W, "response_model_sweep", lambda *a, **b: seen.update(args=a))
    QUERIES["v27_response_model_sweep"](spark, sf_dir)
    spec, grid, trials = seen["args"][6:9]
    trees = spec.build(1.0)
    assert (trees.getNumTrees(), trees.getMaxDepth(), len(grid), trials) == (100, 10, 16, 10)


def test_all_models_on_both_datasets(spark, sf_dir, monkeypatch):
    """Small stand-ins of the three specs keep their names; what the queries loop over is checked."""
    assert [s.name for s in modeling.MODELS] == ["logistic", "random_forest", "boosting"]
    monkeypatch.setattr(modeling, "MODELS", (modeling.ML.logistic(5), modeling.ML.random_forest(2, 2), modeling.ML.boosting(1, 2)))
    monkeypatch.setattr(modeling.ML, "out_of_fold", lambda spec, df, key, folds, inner: df.limit(5).select(key, "label"))
    monkeypatch.setattr(
        modeling.ML, "train_and_evaluate",
        lambda rows, spec, key, group, name, folds, inner, results: modeling.M.evaluate(
            modeling.ML.score(modeling.ML.fit(spec, rows), rows).select("label", "score"), 0.5
        ).select(F.lit(name).alias("dataset"), F.lit(spec.name).alias("model"), "metric", "value"),
    )
    every = {(d, m.name) for d in ("anonymized", "non_anonymized") for m in modeling.MODELS}
    for name in ("v10_out_of_fold", "v10_train_and_evaluate", "v24_feature_importance"):
        rows = QUERIES[name](spark, sf_dir).collect()
        assert {(r["dataset"], r["model"]) for r in rows} == every, name
        if name == "v10_train_and_evaluate":
            assert len({(r["dataset"], r["best_model"]) for r in rows}) == 2 and all(r["loss_points_roc_auc"] is not None for r in rows)


def test_baseline_and_isolated_sweeps_run_all_models(spark, sf_dir, monkeypatch):
    """v29 and v28 with small stand-ins of the three specs and two settings of each parameter."""
    small = (modeling.ML.logistic(5, weight=None), modeling.ML.random_forest(2, 2, weight=None), modeling.ML.boosting(1, 2, weight=None))
    monkeypatch.setattr(modeling, "HEALTH_MODELS", small)
    assert {r["model"] for r in QUERIES["v29_unprotected_baseline"](spark, sf_dir).collect()} == {m.name for m in small}
    for name, values in (("SWEEP_EPSILON", [0.5, 5.0]), ("SWEEP_P", [0.1]), ("SWEEP_K", [3])):
        monkeypatch.setattr(modeling, name, values)
    rows = QUERIES["v28_isolated_sweeps"](spark, sf_dir).collect()
    assert len(rows) == 5 * 3 * 2 and {r["parameter"] for r in rows} == {"none", "epsilon", "p", "k"}
    assert all(0 <= r["value"] <= 1 for r in rows)


def test_logistic_gradient_is_zero_at_the_returned_coefficients(spark, sf_dir):
    """The penalized loss that V6 states, differentiated in columns over the training rows."""
    from pyspark.ml.functions import vector_to_array

    train, _ = modeling.holdout(modeling.baseline(spark, sf_dir))
    model = modeling.ML.fit(modeling.LOGISTIC, train)
    rows = modeling.ML.score(model, modeling.ML.weighted(train, "balanced")).withColumn("x", vector_to_array("features"))
    error = F.col("weight") * (F.col("score") - F.col("label"))
    total, constant, *slopes = rows.agg(F.sum("weight"), F.sum(error), *[F.sum(error * F.col("x")[j]) for j in range(len(model.coefficients))]).first()
    assert abs(constant) / total < 1e-5
    for slope, w in zip(slopes, model.coefficients):
        assert abs(slope + w) / total < 1e-5  # C = 1: the penalty's gradient is the coefficient itself
