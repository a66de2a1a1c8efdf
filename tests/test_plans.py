"""Shapes of plans: no products, no Python, spread and pruned scans; a whole run on hot data."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.queries import CHECKS, inputs
from placewise.session import shuffle_partitions

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the generated tables")
# One row of medians beside every row.
ONE_ROW_BROADCAST = {"impute_median"}
FITS_MODELS = {"fit_revenue", "predict_all", "heldout_predictions"}


@pytest.fixture(scope="module")
def given(spark):
    return inputs(spark, SF_DIR)


@needs_tables
@pytest.mark.parametrize("name", [n for n in CHECKS if n not in FITS_MODELS])
def test_no_product_and_no_python(spark, given, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = CHECKS[name].build(given)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan
    if name not in ONE_ROW_BROADCAST:
        assert "NestedLoop" not in plan


@needs_tables
def test_hub_scan_reads_few_columns(given):
    plan = CHECKS["hub_postcodes"].build(given)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "mrch_city_nm_raw" not in schema and "pymt_crd_acct_num_raw" not in schema


def test_partitions_follow_the_input():
    assert shuffle_partitions(10**9) == 200
    assert shuffle_partitions(100 * 10**12) == 100_000
    assert shuffle_partitions(10**12) == 3726
