"""From card rows and a gazetteer to predicted revenue per postcode.

Each property is a frame of the run.  Frames read by several later steps are
stage tables (``session.reuse_or_build``): written once, read with column
pruning, and known by their size when Catalyst chooses a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.operators import cells as cell_ops
from placewise.operators import demand as demand_ops
from placewise.operators import model
from placewise.operators import registry as reg
from placewise.operators import shops as shop_ops
from placewise.operators.spatial import nearby_pairs
from placewise.params import Params
from placewise.session import checkpointed, input_manifest, reuse_or_build, stage_prefix
from placewise.sources.monthly import MonthlyTable
from placewise.sources.tabular import read_geonames, scan_card_tx, write_table


class CardRun:
    """One run over (card_tx, geonames) under ``params``.

    Stage tables start with ``prefix`` and are reused while they exist, so
    other inputs or parameters need another prefix (``session.stage_prefix``
    makes one) or ``rebuild``.  Tables with a row per payment or card-month are
    partitioned by month, so that later windows open only their months.

    With ``kept``, the sums by booked texts, which read and clean every payment,
    stay below the shared folder under that name after the run; the next run
    builds only months whose payments changed.
    """

    def __init__(
        self,
        spark: SparkSession,
        card_tx: DataFrame | Callable[[], DataFrame],
        geonames: DataFrame,
        params: Params = Params(),
        prefix: str = "placewise",
        rebuild: bool = False,
        kept: str | None = None,
    ) -> None:
        self.spark, self.params, self.prefix, self.rebuild, self.kept = spark, params, prefix, rebuild, kept
        self._card, self.geonames = card_tx, geonames
        self._done: dict[str, DataFrame] = {}

    def stage(self, name: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
        if name not in self._done:
            self._done[name] = reuse_or_build(self.spark, f"{self.prefix}_{name}", build, self.rebuild, partition_by)
        return self._done[name]

    # --- registry -----------------------------------------------------------
    @property
    def card_tx(self) -> DataFrame:
        return self._card() if callable(self._card) else self._card

    @property
    def tx(self) -> DataFrame:
        """Cleaned card rows, for counts and inspection; the run itself starts from ``raw_months``."""
        return reg.restaurant_tx(self.card_tx)

    @property
    def raw_months(self) -> DataFrame:
        """Sums by texts as booked, with the cleaned texts: each is cleaned once per month."""
        def build(rows: DataFrame) -> DataFrame:
            return reg.clean_names(reg.raw_months(rows))

        if not self.kept:
            return self.stage("raw_months", lambda: build(self.card_tx))
        if "raw_months" not in self._done:
            self._done["raw_months"] = MonthlyTable(self.spark, f"{self.kept}/raw_months", self.card_tx, build).refresh().read()
        return self._done["raw_months"]

    @property
    def name_months(self) -> DataFrame:
        return self.stage("name_months", lambda: reg.name_months(self.raw_months))

    @property
    def hubs(self) -> DataFrame:
        return self.stage("hubs", lambda: reg.hub_postcodes(self.name_months, self.params.hub_min_names))

    @property
    def centroids(self) -> DataFrame:
        return self.stage("centroids", lambda: reg.postcode_centroids(self.geonames))

    @property
    def city_county(self) -> DataFrame:
        return self.stage("city_county", lambda: reg.unambiguous_city_county(self.geonames))

    @property
    def placed(self) -> DataFrame:
        """Name-months with hub flag, place and name parts."""
        def build() -> DataFrame:
            flagged = reg.flag_hub_rows(self.name_months, self.hubs)
            return reg.name_parts_join(reg.resolve_place(flagged, self.centroids, self.city_county))

        return self.stage("placed", build)

    @property
    def components(self) -> DataFrame:
        return self.stage("components", lambda: reg.till_components(reg.till_cooccurrence(self.placed)))

    @property
    def stored(self) -> DataFrame:
        return reg.till_rep_join(self.placed, self.components)

    @property
    def outlets(self) -> DataFrame:
        return self.stage("outlets", lambda: reg.multi_outlets(self.stored))

    @property
    def keyed(self) -> DataFrame:
        """Name-months with their store and merchant."""
        return self.stage("keyed", lambda: reg.multi_outlet_merchants(self.stored, self.outlets))

    @property
    def location(self) -> DataFrame:
        return self.stage("location", lambda: reg.merchant_location(self.keyed))

    @property
    def branded(self) -> DataFrame:
        return self.stage(
            "branded", lambda: reg.assign_brands(reg.merchant_join(self.keyed, self.location, self.centroids))
        )

    @property
    def addresses(self) -> DataFrame:
        return reg.registration_addresses(self.branded, self.params.min_registrations)

    @property
    def merchants(self) -> DataFrame:
        return self.stage(
            "merchants", lambda: reg.flag_located(self.branded, self.addresses).select(*reg.MERCHANT_COLUMNS)
        )

    # --- card rows of shops -------------------------------------------------
    @property
    def booked(self) -> DataFrame:
        """What the registry knows of each name, city, postcode and month as booked."""
        def build() -> DataFrame:
            known = reg.located_merchants(self.merchants).select("merchant", "brand", "loc_pc5")
            keys = shop_ops.key_store(self.keyed).drop("hub").join(known, "merchant", "left")
            return shop_ops.booked_keys(self.raw_months.where(F.col("mcc").isin(*reg.MODEL_MCCS)), keys)

        return self.stage("booked", build)

    @property
    def facts(self) -> DataFrame:
        """Card-present rows of the model's categories with merchant, brand and location.

        This is the one join of payments with the registry, on the texts as
        booked, so no payment's text is cleaned.
        """
        def build() -> DataFrame:
            rows = reg.card_marks(reg.booked_rows(self.card_tx, reg.MODEL_MCCS))
            rows = rows.select(*reg.RAW_KEY, "card", "mcc", "amt", *reg.MARKS)
            return shop_ops.booked_to_merchant(rows, self.booked).drop("city", "mrch_city_nm_raw", "mrch_postal_code")

        return self.stage("facts", build, ("month",))

    @property
    def merchant_tx(self) -> DataFrame:
        """Rows of located merchants; a located merchant is one with a location here."""
        return self.facts.where(F.col("loc_pc5").isNotNull()).select(
            "merchant", F.col("loc_pc5").alias("pc5"), "brand", "mcc", "card", "month", "amt"
        )

    @property
    def training(self) -> DataFrame:
        p = self.params
        return self.stage(
            "training",
            lambda: reg.training_rows(self.merchant_tx, self.centroids, p.train_year, p.min_cards, p.min_shops_per_mcc),
        )

    @property
    def tills(self) -> DataFrame:
        def build() -> DataFrame:
            located = self.facts.where(F.col("loc_pc5").isNotNull())
            return shop_ops.till_to_training_rows(shop_ops.till_revenue(located, self.params), self.training)

        return self.stage("tills", build)

    @property
    def shops(self) -> DataFrame:
        return self.stage("shops", lambda: shop_ops.shop_table(self.tills))

    @property
    def split_shops(self) -> DataFrame:
        return shop_ops.split_shops(self.shops)

    # --- demand -------------------------------------------------------------
    @property
    def shop_tx(self) -> DataFrame:
        return self.stage(
            "shop_tx",
            lambda: demand_ops.shop_card_months(self.facts, self.split_shops, self.params.card_window),
            ("month",),
        )

    @property
    def nearby(self) -> DataFrame:
        return self.stage("nearby", lambda: nearby_pairs(self.centroids, self.params.catchment_km))

    @property
    def composition(self) -> DataFrame:
        p = self.params
        return self.stage(
            "composition", lambda: demand_ops.shop_composition(self.shop_tx, p.target_year, p.trend_before, p.trend_after)
        )

    @property
    def wallet(self) -> DataFrame:
        return self.stage("wallet", lambda: demand_ops.home_wallet(self.shop_tx, self.params.target_year))

    @property
    def shop_home(self) -> DataFrame:
        return self.stage("shop_home", lambda: demand_ops.shop_home_spend(self.shop_tx, self.params.target_year))

    @property
    def other(self) -> DataFrame:
        return self.stage("other", lambda: demand_ops.area_other_spend(self.card_tx, self.params.target_year))

    @property
    def demand_base(self) -> DataFrame:
        areas, own = demand_ops.catchment_join(self.nearby, self.wallet, self.split_shops, self.shop_home)
        return demand_ops.leave_one_out_join(self.composition, self.wallet, areas, own, self.other)

    @property
    def demand(self) -> DataFrame:
        return self.stage("demand", lambda: demand_ops.demand(self.demand_base))

    # --- cells and predictions ------------------------------------------------
    @property
    def cells(self) -> DataFrame:
        return self.stage("cells", lambda: cell_ops.cells(self.shops, self.demand))

    def heldout_scores(self, **gbt) -> DataFrame:
        full_year = self.cells.where(F.col("n_full_year") >= self.params.min_full_year)
        return model.heldout_scores(full_year, "revenue_full_year", **gbt)

    def evaluate(self, full_year_scores: DataFrame | None = None, **gbt) -> DataFrame:
        p = self.params
        return model.evaluate(self.cells, p.min_full_year, p.min_shops_per_cell, full_year_scores, **gbt)

    def predicted(self, **gbt) -> DataFrame:
        return model.predict_all(self.cells, min_full_year=self.params.min_full_year, **gbt)

    def zip_revenue(self, **gbt) -> DataFrame:
        return model.zip_revenue(self.predicted(**gbt))

    def counts(self) -> DataFrame:
        return reg.scan_counts(self.tx, self.hubs, self.merchants)


def run_card_plan(
    spark: SparkSession,
    card_path: str,
    geonames_path: str,
    params: Params = Params(),
    rebuild: bool = False,
    out: str | None = None,
    kept: str | None = None,
    **gbt,
) -> DataFrame:
    """Card file and gazetteer file to zip_code, type, predicted_revenue.

    Stage names carry the names, sizes and times of the input files, so a
    rewritten file is read again.

    With ``out``, the predictions, the out-of-fold report, the held-out
    predictions and the scores are written below that folder as CSV.  ``gbt``
    sets parameters of the trees.
    """
    run = CardRun(
        spark,
        lambda: scan_card_tx(spark, card_path),
        read_geonames(spark, geonames_path),
        params,
        stage_prefix(card_path, geonames_path, params, input_manifest(spark, card_path, geonames_path)),
        rebuild,
        kept,
    )
    # Written, reported and returned: scored once.
    predicted = checkpointed(run.predicted(**gbt))
    result = model.zip_revenue(predicted)
    if out:
        held_out = checkpointed(run.heldout_scores(**gbt))
        write_table(result, f"{out}/zip_revenue", "csv")
        write_table(model.out_of_fold_report(predicted), f"{out}/out_of_fold", "csv")
        write_table(model.heldout_table(held_out), f"{out}/heldout_predictions", "csv")
        write_table(run.evaluate(held_out, **gbt), f"{out}/metrics", "csv")
    return result
