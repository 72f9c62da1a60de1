"""Shape of the physical plans: no Python on the data path, pruned scans, no row-level single-task windows."""

import re

import pytest

from veil.operators import perturb
from veil.plans import QUERIES
from veil.plans.risk_queries import QUASI, SENSITIVE
from veil.sources import views as V

PLAIN = ["k5_before_after", "l1_class_diversity", "l7_enforce_diversity", "p6_respond_all", "p14_laplace_mechanism", "p19_staged_release",
         "t2_frequency_distance", "v15_roc_auc", "f3_numeric_summary", "m7_partition_bounded"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_python_and_no_cross_product_in_the_plan(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("PythonUDF", "ArrowEval", "BatchEval", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(QUERIES["k1_class_sizes"](spark, sf_dir))
    orders = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "o_" in s]
    assert orders and all("o_totalprice" not in s and "o_orderpriority" not in s for s in orders)


def test_response_is_a_narrow_stage(spark, sf_dir):
    base = plan(QUERIES["e13_numeric_coercion"](spark, sf_dir)).count("Exchange")
    assert plan(QUERIES["p6_respond_all"](spark, sf_dir)).count("Exchange") == base


def test_flips_are_limited_before_the_shuffle(spark, sf_dir):
    rows = V.clean_appointments(spark, sf_dir)
    marks, _ = perturb.failing_classes(rows, QUASI, SENSITIVE)
    assert "WindowGroupLimit" in plan(perturb.flip_picks(rows, "appointment_id", QUASI, SENSITIVE, "seed", marks))
