"""From the land register to priced sales with a postcode, and prices per postcode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.operators import housing as h
from placewise.operators.spatial import nearest_postcode
from placewise.session import checkpointed, reuse_or_build
from placewise.sources import register as r

#: Members pack to a thirtieth of their size; files of so many keep the tasks that parse them short.
MEMBERS_PER_FILE = 50_000
#: A register has some ten feature classes; a task that writes members keeps a file of each open.
OPEN_FILES = 32


class RegisterRun:
    """A land-register file as layer tables, link tables and merged sales.

    The file is read once: its members are written by feature class, then each
    class is parsed once into a layer table that links and merge share.
    """

    def __init__(
        self, spark: SparkSession, path: str, member_end: str | None = None, prefix: str = "register", rebuild: bool = False
    ) -> None:
        self.spark, self.path, self.member_end = spark, path, member_end
        self.prefix, self.rebuild = prefix, rebuild
        self._done: dict[str, DataFrame] = {}

    def stage(
        self, name: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = (), bucket_by: tuple[str, ...] = (),
        rows_per_file: int = 0, open_files: int = 0,
    ) -> DataFrame:
        if name not in self._done:
            self._done[name] = reuse_or_build(
                self.spark, f"{self.prefix}_{name}", build, self.rebuild, partition_by, bucket_by, rows_per_file, open_files
            )
        return self._done[name]

    @property
    def members(self) -> DataFrame:
        return self.stage(
            "members", lambda: r.split_members(self.spark, self.path, self.member_end), ("feature",),
            rows_per_file=MEMBERS_PER_FILE, open_files=OPEN_FILES,
        )

    def layer(self, feature: str) -> DataFrame:
        """A feature class as a table in buckets of its id, on which links meet it."""
        def build() -> DataFrame:
            if self.member_end:
                # What a class holds is found from its own members; a run that asks for one layer reads no others.
                return r.parse_members(self.members, feature)
            return r.read_features(self.spark, self.path, feature)

        return self.stage(feature.lower(), build, bucket_by=("gml_id",))

    def layers(self) -> dict[str, DataFrame]:
        """Every feature class as a table."""
        return {feature: self.layer(feature) for feature in r.FEATURES}

    def links(self, feature: str) -> DataFrame:
        """Ids and links of a feature class: its layer if the run has it, else a table of these alone, in the same buckets."""
        name = feature.lower()
        made = name in self._done or (not self.rebuild and self.spark.catalog.tableExists(f"{self.prefix}_{name}"))
        if made or not self.member_end:
            return self.layer(feature)
        return self.stage(f"{name}_links", lambda: r.parse_links(self.members, feature), bucket_by=("gml_id",))

    def edges(self) -> dict[str, DataFrame]:
        """The six link tables."""
        trans, prop, premises = (self.links(f) for f in ("RCN_Transakcja", "RCN_Nieruchomosc", "RCN_Lokal"))
        return {
            "transaction_property": r.edges_transaction_property(trans),
            "transaction_document": r.edges_transaction_document(trans),
            "property_premises": r.edges_property_premises(prop),
            "property_building": r.edges_property_building(prop),
            "property_parcel": r.edges_property_parcel(prop),
            "premises_address": r.edges_premises_address(premises),
        }

    def bridge(self) -> DataFrame:
        e = self.edges()
        return h.feature_bridge(
            e["transaction_property"], e["transaction_document"], e["property_premises"],
            e["premises_address"], e["property_building"],
        )

    def merged(self) -> DataFrame:
        """One row per sold premises with the attributes of all linked features."""
        def plain(feature: str) -> DataFrame:
            drop = [*r.FEATURE_LINKS.get(feature, ())] + ([] if feature == "RCN_Lokal" else ["geometry_wkt"])
            return self.layer(feature).drop(*drop)

        # Layers first: the bridge then reads their links and parses none of their members again.
        sides = [plain(f) for f in ("RCN_Transakcja", "RCN_Lokal", "RCN_Dokument", "RCN_Budynek", "RCN_Adres")]
        return h.register_merge(self.bridge(), *sides)


def register_sales(
    run: RegisterRun, polygons: DataFrame, reproject: bool = True, lo: float = h.PRICE_BAND[0], years: tuple[int, int] = h.YEARS
) -> DataFrame:
    """Register file to the modelling columns of every usable apartment sale."""
    # Read twice by the join with districts.
    return h.sale_features(checkpointed(h.merged_sales(run.merged(), lo)), polygons, reproject, years=years)


def project_codes(codes: DataFrame) -> DataFrame:
    """Postcodes with x and y in metres of the national grid."""
    return geo.to_epsg2180(codes)


def price_by_postcode(sales: DataFrame, geonames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sales (cena_m2, X_2180, Y_2180) with their nearest code, and prices per code."""
    codes = project_codes(h.krakow_postcodes(h.krakow_filter(geonames)))
    points = checkpointed(sales.withColumns({"x": F.col("X_2180"), "y": F.col("Y_2180")}))
    coded = nearest_postcode(points, codes).drop("x", "y")
    return coded, h.price_stats(coded)
