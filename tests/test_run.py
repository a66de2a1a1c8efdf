"""Files in, files out: the card plan and the choice of places on top of it."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import views
from checks.queries import inputs
from placewise.operators import housing
from placewise.plans.card_plan import run_card_plan
from placewise.plans.choice_plan import choose_places
from placewise.sources import tabular

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the generated tables")
GBT = {"maxIter": 2, "minInstancesPerNode": 1, "maxDepth": 2}


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    given = inputs(spark, SF_DIR)
    tabular.write_table(given.card, f"{folder}/card")
    given.geo.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in tabular.GEONAMES_COLUMNS])).write.text(
        f"{folder}/geonames"
    )
    params = replace(views.PARAMS, min_full_year=1)
    result = run_card_plan(spark, f"{folder}/card", f"{folder}/geonames", params, out=f"{folder}/out", **GBT)
    return given, folder, result


def test_outputs(spark, outcome):
    given, folder, result = outcome
    rows = result.collect()
    assert len(rows) == given.run.cells.count() and all(r.predicted_revenue > 0 for r in rows)
    read = tabular.read_csv_table(spark, f"{folder}/out/zip_revenue", "zip_code string, type string, predicted_revenue double")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows))
    scores = spark.read.csv(f"{folder}/out/metrics", header=True)
    assert {"population", "cells", "r2", "mape", "median_ape", "spearman", "top20_precision"} == set(scores.columns)
    assert scores.count() == 2


def test_choice(spark, outcome):
    given, _, result = outcome
    prices = housing.price_stats(given.coded)
    scenarios = spark.createDataFrame(
        [(1, "restaurant", 50_000.0, 25.0, 1), (2, "fast food", 1e9, 25.0, 3), (3, "restaurant", 1.0, 25.0, 5)],
        "scenario_id int, type string, budget double, area_m2 double, k int",
    )
    shown, totals = choose_places(given.codes, prices, result, scenarios)
    by_scenario = {r.scenario_id: r for r in totals.collect()}
    assert set(by_scenario) == {1, 2}  # nothing fits a budget of one
    assert by_scenario[1].n == 1 and by_scenario[2].n == 3
    chosen = shown.where("scenario_id = 1").first()
    pool = housing.candidate_join(housing.geo_price_join(given.codes, prices), result, "restaurant")
    best = max(r.revenue - r.total_cost for r in pool.collect() if r.total_cost <= 50_000)
    assert chosen.profit == pytest.approx(best)
