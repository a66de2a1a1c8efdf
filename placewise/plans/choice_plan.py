"""From postcodes, prices and predicted revenue to chosen places per scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.operators import housing, selection


def choose_places(
    codes: DataFrame, prices: DataFrame, zip_revenue: DataFrame, scenarios: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Chosen codes of every scenario, best profit first, and each scenario's totals.

    codes: postal_code with position; prices: avg_price_m2 per postal_code;
    scenarios: scenario_id, type, budget, area_m2, k.  The budget bounds costs
    as they are; the costs shown are rounded up.
    """
    candidates = housing.candidates_by_type(housing.geo_price_join(codes, prices), zip_revenue)
    chosen = selection.select_locations(candidates, scenarios)
    shown = chosen.withColumn("total_cost", F.ceil("total_cost")).orderBy("scenario_id", F.desc("profit"))
    return shown, selection.totals_by_scenario(chosen)
