"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8); with
BENCH_DEFAULT_FIT also the model of default size.  Stages of
the card run are built once, in order, and each is timed where it is built;
nothing is reused from an earlier run.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import replace

from checks import queries as q
from checks import views
from placewise.operators import demand, housing, model, registry, selection, spatial
from placewise.plans import housing_plan
from placewise.plans.card_plan import CardRun
from placewise.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # A busy postcode of these tables has more names than a small one's hub.
    params = replace(views.PARAMS, hub_min_names=int(os.environ.get("BENCH_HUB_NAMES", "60")))
    inputs = q.inputs(spark, sf_dir)
    inputs.card.count()  # the fact table as one flat Parquet file, which is the library's input
    run = CardRun(spark, lambda: inputs.card, inputs.geo, params, f"{inputs.prefix}_bench")
    times: dict[str, float] = {}

    def timed(name: str, build) -> None:
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    timed("hub_postcodes", lambda: run.hubs)
    timed("place_and_tills", lambda: run.keyed)
    timed("merchant_dim", lambda: run.merchants)
    timed("shop_facts", lambda: run.facts)
    timed("training_rows", lambda: run.training)
    timed("shop_table", lambda: run.shops)
    timed("shop_tx", lambda: run.shop_tx)
    timed("nearby_pairs", lambda: run.nearby)
    timed("demand", lambda: run.demand)
    timed("cells", lambda: run.cells)
    timed("card_month_rollup", lambda: demand.card_month_rollup(inputs.card, params.card_window))
    timed("area_other_spend", lambda: demand.area_other_spend(inputs.card, params.target_year))
    timed("merchant_location", lambda: registry.merchant_location(run.keyed))
    points = q._xy(inputs.priced)
    codes = housing_plan.project_codes(inputs.codes)
    timed("nearest_postcode", lambda: spatial.nearest_postcode(points, codes))
    timed("district_join", lambda: spatial.district_join(q._xy(inputs.sales), inputs.polygons))
    timed("price_stats", lambda: housing.price_stats(inputs.coded))
    inputs.register_path  # writes the register file
    timed("register_merge", lambda: inputs.register_run.merged())
    timed("model_metrics", lambda: model.model_metrics(inputs.scored))
    timed("select_locations", lambda: q._select(inputs))
    timed("select_exact_k2", lambda: selection.select_locations_exact_k2(inputs.parts, 300.0))
    total = round(sum(times.values()), 3)
    if os.environ.get("BENCH_DEFAULT_FIT"):
        # The default 400 trees, folds side by side; apart from the total, which it would outweigh.
        timed("predict_all_400_trees", run.predicted)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
