"""Every registered query against its SQL in DuckDB; queries without SQL must give rows."""

import pytest

from oracle import compare, connect
from veil.plans import ORACLES, QUERIES

# many minutes together, see the README; the same operators run with small parameters in test_models, test_forest, test_restart and test_modeling
SLOW = {"v8_gradient_boosting", "v9_calibrated_ensemble", "v10_out_of_fold", "v10_train_and_evaluate", "v24_feature_importance", "v28_isolated_sweeps",
        "v27_response_model_sweep", "v29_unprotected_baseline"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
