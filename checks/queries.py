"""One check per operator: the Spark query, its output columns, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as o
from checks import views
from placewise.functions import brands, flags, geo, text
from placewise.functions.sqlreg import register_functions
from placewise.operators import cells as cell_ops
from placewise.operators import common, demand, housing, model, registry, selection, shops, spatial
from placewise.plans import housing_plan
from placewise.plans.card_plan import CardRun
from placewise.session import reuse_or_build, shared_dir, stage_prefix
from placewise.sources import register, tabular

P = views.PARAMS


class Inputs:
    """The given tables of one folder in the library's shapes, and a card run over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.prefix = stage_prefix(sf_dir, P, spark.sparkContext.applicationId)
        self.run = CardRun(spark, lambda: self.card, self.geo, P, self.prefix)

    def sql(self, text_: str) -> DataFrame:
        return self.spark.sql(views.for_spark(text_, self.sf_dir))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def written(self, name: str, write: Callable[[str], None]) -> str:
        """Folder of a file set Spark wrote from the tables, once per session."""
        path = f"{shared_dir(self.spark)}/placewise/{self.spark.sparkContext.applicationId}/{self.prefix}_files/{name}"
        if name not in _WRITTEN.setdefault((self.spark.sparkContext.applicationId, self.sf_dir), set()):
            write(path)
            _WRITTEN[(self.spark.sparkContext.applicationId, self.sf_dir)].add(name)
        return path

    @property
    def card(self) -> DataFrame:
        return reuse_or_build(self.spark, f"{self.prefix}_card", lambda: self.sql(views.CARD_TX))

    @cached_property
    def geo(self) -> DataFrame:
        return self.sql(views.GEONAMES)

    @cached_property
    def sales(self) -> DataFrame:
        return self.sql(views.SALES)

    @property
    def tx(self) -> DataFrame:
        return registry.restaurant_tx(self.card)

    # Row-level frames, one row per payment, for the operators' own checks; the
    # card run reaches the same results over name-months.
    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return reuse_or_build(self.spark, f"{self.prefix}_{name}", build)

    @property
    def placed(self) -> DataFrame:
        def build() -> DataFrame:
            flagged = registry.flag_hub_rows(registry.card_present(self.tx), self.run.hubs)
            return registry.name_parts_join(registry.resolve_place(flagged, self.run.centroids, self.run.city_county))
        return self.stage("rows_placed", build)

    @property
    def stored(self) -> DataFrame:
        return registry.till_rep_join(self.placed, self.run.components)

    @property
    def rest_cp(self) -> DataFrame:
        return self.stage("rows_rest_cp", lambda: registry.multi_outlet_merchants(self.stored, self.run.outlets))

    @property
    def merchant_tx(self) -> DataFrame:
        return self.stage("rows_merchant_tx", lambda: registry.merchant_tx(self.rest_cp, self.run.merchants))

    @property
    def raw_st(self) -> DataFrame:
        return shops.raw_to_merchant(shops.raw_till_tx(self.card), shops.key_store(self.rest_cp))

    @cached_property
    def priced(self) -> DataFrame:
        return housing.price_band(self.sales, 500).withColumn("geometry", F.col("geometry_wkt"))

    @property
    def codes(self) -> DataFrame:
        return housing.krakow_postcodes(self.geo)

    @property
    def coded(self) -> DataFrame:
        def build() -> DataFrame:
            x, y = geo.parse_point(F.col("geometry_wkt"))
            return spatial.nearest_postcode(self.priced.withColumns({"x": x, "y": y}), housing_plan.project_codes(self.codes))

        return reuse_or_build(self.spark, f"{self.prefix}_coded", build)

    @property
    def geo_prices(self) -> DataFrame:
        return housing.geo_price_join(self.codes, housing.price_stats(self.coded))

    @property
    def zip_rev(self) -> DataFrame:
        spent = (
            self.tx.where(F.col("mcc").isin(5812, 5814) & F.col("pc5").isNotNull())
            .groupBy("pc5", F.col("mcc").alias("mrch_catg_cd"))
            .agg((F.sum("amt").cast("double") / 1000).alias("predicted_revenue"))
        )
        return model.zip_revenue(spent)

    @property
    def candidates(self) -> DataFrame:
        return housing.candidate_join(self.geo_prices, self.zip_rev, "restaurant", 25)

    @property
    def parts(self) -> DataFrame:
        return self.table("part").select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("postal_code"),
            F.col("p_brand").alias("type"),
            F.col("p_retailprice").alias("revenue"),
            (F.col("p_size").cast("double") * 10).alias("total_cost"),
        )

    @property
    def scored(self) -> DataFrame:
        """A simple price guess for every sale, as (y, pred_y, revenue, pred_revenue)."""
        guess = F.col("powUzytkowaLokalu") * 900 + F.col("id") % 1000
        return self.priced.select(
            "id", F.ln("cenaTransakcjiBrutto").alias("y"), F.ln(guess).alias("pred_y"),
            F.col("cenaTransakcjiBrutto").alias("revenue"), guess.alias("pred_revenue"),
        )

    @property
    def polygons(self) -> DataFrame:
        """Per nation a square, or an L where its key is odd."""
        x, y = 560_000 + (F.col("n_nationkey") % 5) * 2800, 240_000 + F.floor(F.col("n_nationkey") / 5) * 1800
        def at(dx: int, dy: int):
            return F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
        square = F.array(at(0, 0), at(2500, 0), at(2500, 1500), at(0, 1500))
        ell = F.array(at(0, 0), at(2500, 0), at(2500, 700), at(1200, 700), at(1200, 1500), at(0, 1500))
        return self.table("nation").select(
            F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 1, ell).otherwise(square).alias("ring")
        )

    @property
    def register_path(self) -> str:
        # Packed files are read by a task each, so none holds more than this many members.
        return self.written("register", lambda path: _register_lines(self.table("orders")).write.mode("overwrite")
                            .option("maxRecordsPerFile", MEMBERS_PER_FILE).text(path, compression="gzip"))

    @property
    def register_run(self) -> housing_plan.RegisterRun:
        return housing_plan.RegisterRun(self.spark, self.register_path, MEMBER_END, f"{self.prefix}_register")

    def features(self, name: str) -> DataFrame:
        return register.read_features(self.spark, self.register_path, name, member_end=MEMBER_END)


MEMBER_END = "</gml:featureMember>"
MEMBERS_PER_FILE = 100_000
_WRITTEN: dict[tuple[str, str], set[str]] = {}


def _register_lines(orders: DataFrame) -> DataFrame:
    """Register XML, one feature per line, from the orders."""
    k, c = "{o_orderkey}", "{o_custkey % 50}"
    spaces = 'xmlns:rcn="urn:r" xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:xlink="http://www.w3.org/1999/xlink"'

    def line(template: str, rows: DataFrame) -> DataFrame:
        pieces = []
        template = f"<gml:featureMember>{template}{MEMBER_END}"
        for i, part in enumerate(template.replace("{", "\0").replace("}", "\0").split("\0")):
            pieces.append(F.expr(part).cast("string") if i % 2 else F.lit(part))
        return rows.select(F.concat(*pieces).alias("value"))

    third = orders.where("o_orderkey % 3 = 0")
    shared = orders.select((F.col("o_custkey") % 50).alias("j")).distinct()
    parcels = orders.select((F.col("o_orderkey") % 100).alias("j")).distinct()
    ring = '<gml:LinearRing><gml:posList srsDimension="2">{} 0 {} 0 {} 9 {} 0</gml:posList></gml:LinearRing>'.format("{j}", "{j + 9}", "{j + 9}", "{j}")
    hole = "{CASE WHEN j % 2 = 1 THEN concat('<gml:interior><gml:LinearRing><gml:posList>', j + 5, ' 1 ', j + 8, ' 1 ', j + 8, ' 4 ', j + 5, ' 1</gml:posList></gml:LinearRing></gml:interior>') ELSE '' END}"
    doc = "{CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(CASE WHEN o_orderkey % 5 = 0 THEN concat('<rcn:podstawaPrawna xlink:href=\"#X', o_orderkey, '\"/>') ELSE '' END, '<rcn:podstawaPrawna xlink:href=\"#D', o_orderkey, '\"/>') END}"
    second = "{CASE WHEN o_orderkey % 3 = 0 THEN concat('<rcn:nieruchomosc xlink:href=\"#N', o_orderkey, 'b\"/>') ELSE '' END}"
    parcel = "{CASE WHEN o_orderkey % 2 = 0 THEN concat('<rcn:dzialka xlink:href=\"#P', o_orderkey % 90, 'x\"/>') ELSE '' END}"
    address = "{CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('<rcn:adres xlink:href=\"#A', o_custkey % 50, '\"/>') END}"
    pos = "{560000 + o_custkey % 14000} {240000 + o_custkey % 9000}"
    parts = [
        line(f'<rcn:RCN_Transakcja {spaces} gml:id="T{k}">{doc}<rcn:nieruchomosc xlink:href="#N{k}"/>{second}'
             "<rcn:cenaTransakcjiBrutto>{CAST(o_totalprice AS DECIMAL(18,2))}</rcn:cenaTransakcjiBrutto>"
             "<rcn:rodzajTransakcji>1</rcn:rodzajTransakcji><rcn:rodzajRynku>{1 + o_orderkey % 2}</rcn:rodzajRynku></rcn:RCN_Transakcja>", orders),
        line(f'<rcn:RCN_Dokument {spaces} gml:id="D{k}"><rcn:dataSporzadzeniaDokumentu>{{CAST(o_orderdate AS DATE)}}</rcn:dataSporzadzeniaDokumentu></rcn:RCN_Dokument>', orders),
        line(f'<rcn:RCN_Nieruchomosc {spaces} gml:id="N{k}"><rcn:lokal xlink:href="#L{k}"/><rcn:budynek xlink:href="#B{c}"/>'
             f'<rcn:dzialka xlink:href="#P{{o_orderkey % 100}}"/>{parcel}</rcn:RCN_Nieruchomosc>', orders),
        line(f'<rcn:RCN_Nieruchomosc {spaces} gml:id="N{k}b"><rcn:lokal xlink:href="#L{k}b"/><rcn:lokal xlink:href="#L{k}c"/></rcn:RCN_Nieruchomosc>', third),
        line(f'<rcn:RCN_Lokal {spaces} gml:id="L{k}">{address}<rcn:powUzytkowaLokalu>{{12 + o_orderkey % 200}}</rcn:powUzytkowaLokalu>'
             "<rcn:nrKondygnacji>{o_orderkey % 12 - 1}</rcn:nrKondygnacji><rcn:liczbaIzb>{1 + o_orderkey % 5}</rcn:liczbaIzb>"
             "<rcn:dodatkoweInformacje>{CASE o_orderkey % 4 WHEN 0 THEN 'BALKON' WHEN 1 THEN 'udział 1/2' WHEN 2 THEN 'piwnica, garaż' ELSE 'brak' END}</rcn:dodatkoweInformacje>"
             '<rcn:uwagi kod="u{o_orderkey % 3}">nr {o_orderkey}</rcn:uwagi>'
             f"<rcn:funkcjaLokalu>1_mieszkalna</rcn:funkcjaLokalu><rcn:geometria><gml:Point><gml:pos>{pos}</gml:pos></gml:Point></rcn:geometria></rcn:RCN_Lokal>", orders),
        line(f'<rcn:RCN_Lokal {spaces} gml:id="L{k}b"><rcn:powUzytkowaLokalu>50</rcn:powUzytkowaLokalu></rcn:RCN_Lokal>', third),
        line(f'<rcn:RCN_Budynek {spaces} gml:id="B{{j}}"><rcn:rodzajBudynku>{{110 + j % 3}}</rcn:rodzajBudynku></rcn:RCN_Budynek>', shared),
        line(f'<rcn:RCN_Adres {spaces} gml:id="A{{j}}"><rcn:ulica>Ulica {{j % 9}}</rcn:ulica><rcn:numerPorzadkowy>{{j}}</rcn:numerPorzadkowy></rcn:RCN_Adres>', shared),
        line('<rcn:RCN_Dzialka gml:id="P{j}"><rcn:idDzialki>{j}</rcn:idDzialki><rcn:geometria><gml:Polygon><gml:exterior>' + ring
             + "</gml:exterior>" + hole + "</gml:Polygon></rcn:geometria></rcn:RCN_Dzialka>", parcels),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Check:
    """``cols``: "name:kind ..." with kinds s text, i whole number, d number (6 decimals),
    p number (2 decimals), x number as it is, b boolean, a texts."""

    build: Callable[[Inputs], DataFrame]
    cols: str
    sql: str | None = None

    def spec(self) -> list[tuple[str, str]]:
        return [tuple(c.rsplit(":", 1)) for c in self.cols.split()]

    def spark(self, inputs: Inputs) -> DataFrame:
        kinds = {
            "s": lambda c: F.col(c).cast("string"),
            "i": lambda c: F.col(c).cast("bigint"),
            "d": lambda c: F.round(F.col(c).cast("double"), 6),
            "b": lambda c: F.col(c).cast("boolean"),
            "a": lambda c: F.array_join(F.col(c), ","),
            "x": lambda c: F.col(c).cast("double"),
            "p": lambda c: F.round(F.col(c).cast("double"), 2),
        }
        return self.build(inputs).select(*[kinds[k](c).alias(c) for c, k in self.spec()])

    def duckdb(self) -> str | None:
        if self.sql is None:
            return None
        kinds = {
            "s": "CAST({c} AS VARCHAR)", "i": "CAST({c} AS BIGINT)", "d": "round(CAST({c} AS DOUBLE), 6)",
            "b": "CAST({c} AS BOOLEAN)", "a": "array_to_string({c}, ',')", "x": "CAST({c} AS DOUBLE)", "p": "round(CAST({c} AS DOUBLE), 2)",
        }
        body = self.sql if self.sql.lstrip().upper().startswith("SELECT") else f"SELECT * FROM {self.sql}"
        outer = ", ".join(f"{kinds[k].format(c=c)} AS {c}" for c, k in self.spec())
        return o.with_ctes(f"SELECT {outer} FROM ({body})")


CHECKS: dict[str, Check] = {}


def check(name: str, cols: str, build: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    CHECKS[name] = Check(build, cols, sql)


TX = "card:s month:i mcc:i cp:i nm1:s city:s pc5:s amt:d"
PLACED = TX + " hub:b place:s pc_known:b base:s num:s"
REST = PLACED + " store_nm:s merchant:s"
DIM = ("merchant:s store_nm:s place:s city:s first_month_ever:i spend_all:d booked_postcodes:i mcc:i loc_pc5:s lat:d lon:d "
       "loc_place:s loc_powiat:s")
BRANDED = DIM + " brand:s vending:b generic_name:b chain:b"
MERCHANTS = BRANDED + " registration:b located:b"
TRAINING = ("merchant:s brand:s pc5:s revenue:d cards:i months_active:i mcc:i lat:d lon:d place:s powiat:s powiat_key:s "
            "shops_in_mcc:i")
TILLS = ("mrch_nm_raw:s store:s brand:s pc5:s district:s mrch_catg_cd:i revenue_h2_2025:d revenue_h1_2026:d cards_2025:i "
         "months_active_2025:i full_year_2025:b")
SHOPS = TILLS + " year_revenue:d revenue:d cards:i months_active:i full_year:b postcode:s brand_tier:s"
COMP = "store:s shop_pc:s split:s " + " ".join(f"{c}:{'i' if c in ('txns', 'cards') else 'd'}" for c in demand.SUM_COLUMNS)
DEMAND = "store:s " + " ".join(f"{c}:d" for c in demand.DEMAND_COLUMNS[1:])
CELLS = ("pc5:s mrch_catg_cd:i revenue:d n_shops:i n_brands:i zip_cards:i share_big:d district:s full_year_share:d "
         "median_months_active:d n_full_year:i n_competitor_shops:i " + " ".join(f"{c}:d" for c in cell_ops.DEMAND_FEATURES)
         + " txns_per_card:d revenue_full_year:d cards_per_shop:d spend_per_shop_proxy:p split:s")
SALES = ("id:i cenaTransakcjiBrutto:d powUzytkowaLokalu:d ulica:s geometry_wkt:s dataSporzadzeniaDokumentu:s "
         "dodatkoweInformacje:s rodzajRynku:i nrKondygnacji:i liczbaIzb:i funkcjaLokalu:s rodzajTransakcji:s rodzajBudynku:i")
GEO = ("country_code:s postal_code:s place_name:s admin_name1:s admin_code1:s admin_name2:s admin_code2:s admin_name3:s "
       "admin_code3:s latitude:d longitude:d accuracy:s")
CODES = ("postal_code:s place_name:s admin_name1:s admin_name2:s admin_name3:s latitude:d longitude:d punktow_w_kodzie:i")

# --- sources and sinks --------------------------------------------------------
check("scan_card_tx", " ".join(f"{c}:{'d' if c == 'cs_tran_amt' else 'i' if k == 'int' else 's'}" for c, k in tabular.CARD_COLUMNS.items()),
      lambda c: tabular.scan_card_tx(c.spark, c.written("card", lambda p: tabular.write_table(c.card, p))), "card")
check("read_geonames", GEO,
      lambda c: tabular.read_geonames(c.spark, c.written("geonames", lambda p: c.geo.select(
          F.concat_ws("\t", *[F.coalesce(F.col(x).cast("string"), F.lit("NA")) for x in tabular.GEONAMES_COLUMNS])
      ).write.mode("overwrite").text(p))), "geo")
check("read_csv_table", SALES,
      lambda c: tabular.read_csv_table(c.spark, c.written("sales_csv", lambda p: tabular.write_table(c.sales, p, "csv")), c.sales.schema), "sales")
check("read_price_stats", "postal_code:s avg_price_m2:d median_price_m2:d",
      lambda c: tabular.read_price_stats(c.spark, c.written("prices", lambda p: housing.price_stats(c.coded).select(
          "postal_code", *[F.replace(F.col(x).cast("string"), F.lit("."), F.lit(",")).alias(f" {x} ") for x in tabular.PRICE_COLUMNS]
      ).write.mode("overwrite").csv(p, header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))), "price_stats")
check("write_table", GEO,
      lambda c: c.spark.read.parquet(c.written("geo_parquet", lambda p: tabular.write_table(c.geo, p))), "geo")
check("reuse_or_build", "pc5:s month:i n_names:i",
      lambda c: reuse_or_build(c.spark, f"{c.prefix}_reused", lambda: registry.hub_postcodes(c.tx, P.hub_min_names)), "hubs")
check("read_features", "gml_id:s powUzytkowaLokalu:s funkcjaLokalu:s geometry_wkt:s", lambda c: c.features("RCN_Lokal"),
      """SELECT 'L' || o_orderkey AS gml_id, CAST(12 + o_orderkey % 200 AS VARCHAR) AS powUzytkowaLokalu, '1_mieszkalna' AS funkcjaLokalu,
                'POINT (' || (560000 + o_custkey % 14000) || ' ' || (240000 + o_custkey % 9000) || ')' AS geometry_wkt FROM orders
         UNION ALL SELECT 'L' || o_orderkey || 'b', '50', NULL, NULL FROM orders WHERE o_orderkey % 3 = 0""")
check("read_features_open", "gml_id:s uwagi:s uwagi_kod:s nrKondygnacji:s", lambda c: c.features("RCN_Lokal"),
      """SELECT 'L' || o_orderkey AS gml_id, 'nr ' || o_orderkey AS uwagi, 'u' || (o_orderkey % 3) AS uwagi_kod, CAST(o_orderkey % 12 - 1 AS VARCHAR) AS nrKondygnacji
         FROM orders UNION ALL SELECT 'L' || o_orderkey || 'b', NULL, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0""")
check("read_features_rings", "gml_id:s idDzialki:s geometry_wkt:s", lambda c: c.features("RCN_Dzialka"),
      """SELECT 'P' || j AS gml_id, CAST(j AS VARCHAR) AS idDzialki, 'POLYGON ((' || j || ' 0, ' || (j + 9) || ' 0, ' || (j + 9) || ' 9, ' || j || ' 0)'
                || CASE WHEN j % 2 = 1 THEN ', (' || (j + 5) || ' 1, ' || (j + 8) || ' 1, ' || (j + 8) || ' 4, ' || (j + 5) || ' 1)' ELSE '' END || ')' AS geometry_wkt
         FROM (SELECT DISTINCT o_orderkey % 100 AS j FROM orders)""")

# --- projections, filters, predicates -------------------------------------------
check("restaurant_tx", TX, lambda c: registry.restaurant_tx(c.card), "tx")
check("card_present", TX, lambda c: registry.card_present(c.tx), "SELECT * FROM tx WHERE cp = 1")
check("month_window", TX, lambda c: registry.month_window(c.tx, P.train_year), f"SELECT * FROM tx WHERE {o.between(P.train_year)}")
check("non_hub_rows", REST, lambda c: registry.non_hub_rows(c.rest_cp), "non_hub")
check("located_merchants", MERCHANTS, lambda c: registry.located_merchants(c.run.merchants), "SELECT * FROM merchants WHERE located")
check("krakow_filter", GEO + " row_no:i", lambda c: housing.krakow_filter(c.geo), "krakow")
check("price_band", SALES + " cena_m2:x", lambda c: housing.price_band(c.sales, 500), "priced")
check("fractional_sale_filter", SALES, lambda c: housing.fractional_sale_filter(c.sales),
      f"""SELECT * REPLACE (coalesce(dodatkoweInformacje, '') AS dodatkoweInformacje) FROM sales
          WHERE NOT regexp_matches(lower(coalesce(dodatkoweInformacje, '')), {o.q('|'.join(flags.FRACTIONAL_WORDS))})""")
check("residential_sale_filter", SALES,
      lambda c: housing.residential_sale_filter(c.sales.withColumn("rok", flags.doc_year(F.col("dataSporzadzeniaDokumentu"))), years=(1995, 1997)),
      """SELECT * FROM sales WHERE powUzytkowaLokalu BETWEEN 15 AND 200 AND starts_with(funkcjaLokalu, '1') AND starts_with(rodzajTransakcji, '1')
         AND rodzajBudynku = 110 AND year(TRY_CAST(dataSporzadzeniaDokumentu AS DATE)) BETWEEN 1995 AND 1997 AND nrKondygnacji >= 0""")
check("preview", "pc5:s month:i n_names:i", lambda c: common.preview(registry.hub_postcodes(c.tx, P.hub_min_names), ["pc5", "month"], 5),
      "SELECT * FROM hubs ORDER BY pc5, month LIMIT 5")
check("complete_cases", SALES, lambda c: common.complete_cases(c.sales, ["dodatkoweInformacje", "cenaTransakcjiBrutto"]),
      "SELECT * FROM sales WHERE dodatkoweInformacje IS NOT NULL AND cenaTransakcjiBrutto IS NOT NULL")
check("drop_technical_columns", " ".join(x for x in SALES.split() if not any(p in x.split(":")[0] for p in ("id", "gml", "geometry_wkt"))),
      lambda c: common.drop_technical_columns(c.sales), "SELECT * EXCLUDE (id, geometry_wkt) FROM sales")
check("rename_recode", "sale:i rodzajRynku:s",
      lambda c: common.rename_recode(c.sales, {"id": "sale"}, {"rodzajRynku": housing.MARKETS}),
      "SELECT id AS sale, CASE rodzajRynku WHEN 1 THEN 'Pierwotny' WHEN 2 THEN 'Wtórny' END AS rodzajRynku FROM sales")
check("labelled_cells", CELLS, lambda c: cell_ops.labelled_cells(c.run.cells, P.min_full_year),
      f"SELECT * FROM cells WHERE n_full_year >= {P.min_full_year} AND revenue_full_year IS NOT NULL")
check("type_filter", "zip_code:s type:s predicted_revenue:d", lambda c: housing.type_filter(c.zip_rev, "fast food"),
      "SELECT * FROM zip_rev WHERE type = 'fast food'")

# --- joins ------------------------------------------------------------------------
check("flag_hub_rows", TX + " hub:b", lambda c: registry.flag_hub_rows(registry.card_present(c.tx), c.run.hubs), "flagged")
check("resolve_place", TX + " hub:b place:s pc_known:b",
      lambda c: registry.resolve_place(registry.flag_hub_rows(registry.card_present(c.tx), c.run.hubs), c.run.centroids, c.run.city_county), "located_tx")
check("name_parts_join", TX + " base:s num:s", lambda c: registry.name_parts_join(registry.card_present(c.tx)), "placed")
check("till_rep_join", PLACED + " store_nm:s", lambda c: registry.till_rep_join(c.placed, c.run.components), "stored")
check("multi_outlet_merchants", REST, lambda c: registry.multi_outlet_merchants(c.stored, c.run.outlets), "rest_cp")
check("merchant_dim", MERCHANTS, lambda c: registry.merchant_dim(c.rest_cp, c.run.location, c.run.centroids, P.min_registrations), "merchants")
check("merchant_tx", "merchant:s pc5:s brand:s mcc:i card:s month:i amt:d", lambda c: registry.merchant_tx(c.rest_cp, c.run.merchants), "m_tx")
check("nullsafe_key_join", "store:s shop_pc:s split:s month:i card:s home_pc5:s spend:d txns:i weekend_spend:d dinner_spend:d is_foreign:b is_premium:b is_business:b",
      lambda c: demand.nullsafe_key_join(demand.card_month_rollup(c.card, P.card_window), demand.merchant_key(c.rest_cp, P.card_window), c.run.split_shops), "shop_tx")
check("raw_to_merchant", "mrch_nm_raw:s nm1:s city:s pc5:s month:i mcc:i card:s amt:d merchant:s hub:b",
      lambda c: shops.raw_to_merchant(shops.raw_till_tx(c.card), shops.key_store(c.rest_cp)), "raw_st")
check("till_to_training_rows", TILLS, lambda c: shops.till_to_training_rows(shops.till_revenue(c.raw_st, P), c.run.training), "tills")
check("nearby_pairs", "shop_pc:s home_pc5:s", lambda c: spatial.nearby_pairs(registry.postcode_centroids(c.geo)), "nearby")
check("catchment_join", "shop_pc:s spend:d cards:i store:s own_spend:d",
      lambda c: _both_catchments(c), """SELECT coalesce(z.shop_pc, o.shop_pc) AS shop_pc, z.spend, z.cards, o.store, o.own_spend FROM catchment z
      FULL JOIN (SELECT s.shop_pc, p.store, p.own_spend FROM own_part p JOIN split_shops s ON s.store = p.store) o ON o.shop_pc = z.shop_pc""")
check("leave_one_out_join", "store:s shop_pc:s split:s " + " ".join(f"{c}:d" for c in demand.SUM_COLUMNS)
      + " resident_spend:d catchment_cards:i catchment_spend:d grocery_spend:d lodging_spend:d leisure_spend:d", lambda c: c.run.demand_base, "loo_join")
check("cell_assembly", CELLS, lambda c: cell_ops.cell_assembly(
          cell_ops.shop_counts(c.run.shops).join(common.grouped_medians(c.run.shops, cell_ops.CELL, ["revenue", "months_active"]).withColumnRenamed("months_active", "median_months_active"), list(cell_ops.CELL)),
          cell_ops.area_medians(c.run.shops, c.run.demand), cell_ops.full_year_median(c.run.shops)), "cells")
check("lookup_by_group", TX + " spent:d", lambda c: common.lookup_by_group(c.tx, ["pc5", "mcc"], F.sum("amt"), "spent"),
      """SELECT t.*, s.spent FROM tx t LEFT JOIN (SELECT pc5, mcc, sum(amt) AS spent FROM tx WHERE pc5 IS NOT NULL GROUP BY pc5, mcc) s
         ON s.pc5 = t.pc5 AND s.mcc = t.mcc""")
BRIDGE = "id_transakcji:s id_nieruchomosci:s id_dokumentu:s id_lokalu:s id_adresu:s id_budynku:s"
check("feature_bridge", BRIDGE, lambda c: c.register_run.bridge(), "bridge")
MERGED = "cenaTransakcjiBrutto:d rodzajTransakcji:s rodzajRynku:s powUzytkowaLokalu:d dataSporzadzeniaDokumentu:s rodzajBudynku:s ulica:s numerPorzadkowy:s"
check("register_merge", f"{BRIDGE} {MERGED.replace('powUzytkowaLokalu:d', 'powUzytkowaLokalu:s geometry_wkt:s')}", lambda c: c.register_run.merged(), "merged")
check("merged_sales", f"{MERGED} geometry:s cena_m2:x uwagi:s", lambda c: housing.merged_sales(c.register_run.merged(), 500), "merged_sales")
HOMES = " ".join(f"{c}:{'s' if c in ('rodzajRynku', 'dzielnica') else 'x' if c == 'cena_m2' else 'd'}" for c in housing.MODEL_COLUMNS)


def _register_sales(c: Inputs) -> DataFrame:
    return housing_plan.register_sales(c.register_run, c.polygons, reproject=False, lo=500, years=(1995, 1997))


check("register_sales", HOMES, _register_sales, "register_sales")
check("price_by_postcode", "postal_code:s avg_price_m2:d median_price_m2:d", lambda c: housing_plan.price_by_postcode(_register_sales(c), c.geo)[1],
      """SELECT postal_code, round(avg(cena_m2), 2) AS avg_price_m2, round(median(cena_m2), 2) AS median_price_m2 FROM register_coded GROUP BY postal_code""")
check("district_join", "id:i x:d y:d dzielnica:s", lambda c: spatial.district_join(_xy(c.sales), c.polygons),
      f"""SELECT s.id, s.x, s.y, n.n_name AS dzielnica FROM (SELECT id, {o.wkt_number('geometry_wkt', 1)} AS x, {o.wkt_number('geometry_wkt', 2)} AS y FROM sales) s
          LEFT JOIN (SELECT *, 560000 + n_nationkey % 5 * 2800 AS x0, 240000 + n_nationkey // 5 * 1800 AS y0 FROM nation) n
            ON s.x > n.x0 AND s.x < n.x0 + 2500 AND s.y > n.y0 AND s.y < n.y0 + 1500
           AND (n.n_nationkey % 2 = 0 OR s.y < n.y0 + 700 OR s.x < n.x0 + 1200)""")
check("nearest_postcode", "id:i x:d y:d postal_code:s postal_code_point_wkt:s",
      lambda c: spatial.nearest_postcode(_xy(c.priced), housing_plan.project_codes(c.codes)),
      "SELECT d.id, d.x, d.y, d.postal_code, printf('POINT(%.6f %.6f)', a.longitude, a.latitude) AS postal_code_point_wkt FROM coded d JOIN all_codes a ON a.postal_code = d.postal_code")
check("geo_price_join", CODES + " avg_price_m2:d median_price_m2:d", lambda c: housing.geo_price_join(c.codes, housing.price_stats(c.coded)), "geo_prices")
check("candidate_join", "postal_code:s latitude:d longitude:d revenue:d total_cost:d", lambda c: c.candidates, "candidates")
check("semi_join_codes", GEO + " row_no:i", lambda c: common.semi_join_codes(c.geo, housing.krakow_postcodes(housing.krakow_filter(c.geo))),
      "SELECT * FROM geo WHERE postal_code IN (SELECT postal_code FROM krakow)")

# --- aggregations -----------------------------------------------------------------
check("scan_counts", "n:i cp_rows:i hubs:i merchants:i located:i", lambda c: registry.scan_counts(c.tx, c.run.hubs, c.run.merchants),
      """SELECT (SELECT count(*) FROM tx) AS n, (SELECT count(*) FROM tx WHERE cp = 1) AS cp_rows, (SELECT count(DISTINCT pc5) FROM hubs) AS hubs,
         (SELECT count(*) FROM merchants) AS merchants, (SELECT count(*) FROM merchants WHERE located AND mcc IN (5812, 5814)) AS located""")
check("name_months", "nm1:s city:s pc5:s month:i mcc:i amt:d n:i", lambda c: registry.name_months(c.tx),
      "SELECT nm1, city, pc5, month, mcc, sum(amt) AS amt, count(*) AS n FROM tx WHERE cp = 1 GROUP BY nm1, city, pc5, month, mcc")
check("raw_months", "mrch_nm_raw:s mrch_city_nm_raw:s mrch_postal_code:s month:i mcc:i amt:d n:i", lambda c: registry.raw_months(c.card),
      """SELECT mrch_nm_raw, mrch_city_nm_raw, mrch_postal_code, prch_mnth_id AS month, mrch_catg_cd AS mcc, sum(cs_tran_amt) AS amt, count(*) AS n FROM card
         WHERE mrch_ctry_cd = 616 AND transaction_type <> 'ATM' AND cp_flag = 1 AND mrch_catg_cd IN (5811, 5812, 5813, 5814) GROUP BY 1, 2, 3, 4, 5""")
check("name_months_of_run", "nm1:s city:s pc5:s month:i mcc:i amt:d n:i", lambda c: c.run.name_months,
      "SELECT nm1, city, pc5, month, mcc, sum(amt) AS amt, count(*) AS n FROM tx WHERE cp = 1 GROUP BY nm1, city, pc5, month, mcc")
check("merchants_by_name_month", MERCHANTS, lambda c: c.run.merchants, "merchants")
check("shop_facts", "mrch_nm_raw:s nm1:s pc5:s month:i mcc:i card:s amt:d merchant:s", lambda c: c.run.facts, "raw_st")
check("shop_card_months", "store:s shop_pc:s split:s month:i card:s home_pc5:s spend:d txns:i weekend_spend:d dinner_spend:d is_foreign:b is_premium:b is_business:b",
      lambda c: demand.shop_card_months(c.run.facts, c.run.split_shops, P.card_window), "shop_tx")
check("matched_counts", "matched:i keyed:i share:d", lambda c: demand.matched_counts(c.run.shop_tx, demand.card_month_rollup(c.card, P.card_window)),
      """SELECT (SELECT count(*) FROM shop_tx) AS matched, (SELECT count(*) FROM rollup) AS keyed,
         CAST((SELECT count(*) FROM shop_tx) AS DOUBLE) / (SELECT count(*) FROM rollup) AS share""")
check("sale_counts", "n:i mean_price_m2:d", lambda c: housing.sale_counts(c.priced), "SELECT count(*) AS n, avg(cena_m2) AS mean_price_m2 FROM priced")
check("hub_postcodes", "pc5:s month:i n_names:i", lambda c: registry.hub_postcodes(c.tx, P.hub_min_names), "hubs")
check("postcode_centroids", "pc5:s lat:d lon:d place:s powiat:s powiat_code:s voiv:s n_places:i powiat_key:s", lambda c: registry.postcode_centroids(c.geo), "centroids")
check("krakow_postcodes", CODES + " point_wkt:s", lambda c: housing.krakow_postcodes(housing.krakow_filter(c.geo)), "krakow_codes")
check("unambiguous_city_county", "city_norm:s powiat_key:s", lambda c: registry.unambiguous_city_county(c.geo), "city_county")
check("till_cooccurrence", "base:s place:s pc5:s month:i nums:a", lambda c: registry.till_cooccurrence(c.placed), "cooc")
check("till_components", "base:s place:s num:s rep:s", lambda c: registry.till_components(registry.till_cooccurrence(c.placed)), "comps")
check("multi_outlets", "store_nm:s place:s", lambda c: registry.multi_outlets(c.stored), "outlets")
check("merchant_location", "merchant:s loc_pc5:s loc_month:i", lambda c: registry.merchant_location(c.rest_cp), "location")
check("dominant_mcc", "merchant:s mcc:i", lambda c: registry.dominant_mcc(c.rest_cp), "top_mcc")
check("merchant_attributes", "merchant:s store_nm:s place:s city:s first_month_ever:i spend_all:d booked_postcodes:i", lambda c: registry.merchant_attributes(c.rest_cp), "attrs")
check("registration_addresses", "brand:s loc_pc5:s", lambda c: registry.registration_addresses(c.run.merchants, P.min_registrations), "addresses")
check("training_rows", TRAINING, lambda c: registry.training_rows(c.merchant_tx, c.run.centroids, P.train_year, P.min_cards, P.min_shops_per_mcc), "training")
check("merchant_key", "card:s month:i pc5:s nm1:s mcc:i merchant:s", lambda c: demand.merchant_key(c.rest_cp, P.card_window), "merchant_key")
ROLLUP = "card:s month:i mcc:i pc5:s nm1:s spend:d txns:i weekend_spend:d dinner_spend:d home_pc5:s is_foreign:b is_premium:b is_business:b"
check("kept_card_months", ROLLUP,
      lambda c: demand.kept_card_months(c.spark, f"{c.prefix}_card_months", c.card).refresh().read(*P.card_window), "rollup")
check("card_month_rollup", ROLLUP,
      lambda c: demand.card_month_rollup(c.card, P.card_window), "rollup")
check("shop_composition", COMP, lambda c: demand.shop_composition(c.run.shop_tx, P.target_year, P.trend_before, P.trend_after), "composition")
check("home_wallet", "home_pc5:s spend:d cards:i", lambda c: demand.home_wallet(c.run.shop_tx, P.target_year), "wallet")
check("shop_home_spend", "store:s home_pc5:s spend:d", lambda c: demand.shop_home_spend(c.run.shop_tx, P.target_year), "shop_home")
check("catchment_by_postcode", "shop_pc:s spend:d cards:i", lambda c: demand.catchment_by_postcode(c.run.nearby, c.run.wallet), "catchment")
check("catchment_own", "store:s own_spend:d", lambda c: demand.catchment_own(c.run.split_shops, c.run.nearby, c.run.shop_home), "own_part")
check("area_other_spend", "pc5:s grocery_spend:d lodging_spend:d leisure_spend:d", lambda c: demand.area_other_spend(c.card, P.target_year), "other")
check("key_store", "nm1:s city:s pc5:s month:i merchant:s hub:b", lambda c: shops.key_store(c.rest_cp), "key_store")
check("till_revenue", "mrch_nm_raw:s merchant:s revenue_2025:d revenue_h2_2025:d revenue_h1_2026:d cards_2025:i months_active_2025:i mrch_catg_cd:i full_year_2025:b",
      lambda c: shops.till_revenue(c.raw_st, P), "till_rev")
check("shop_table", SHOPS, lambda c: shops.shop_table(c.run.tills), "shops")
check("demand", DEMAND, lambda c: demand.demand(c.run.demand_base), "demand")
check("area_medians", "pc5:s " + " ".join(f"{x}:d" for x in o.MEDIAN_FEATURES), lambda c: cell_ops.area_medians(c.run.shops, c.run.demand), "area_med")
check("largest_brand", "pc5:s mrch_catg_cd:i n:i", lambda c: cell_ops.largest_brand(c.run.shops), "big_brand")
check("cells", CELLS, lambda c: cell_ops.cells(c.run.shops, c.run.demand), "cells")
check("full_year_median", "pc5:s mrch_catg_cd:i revenue_full_year:d", lambda c: cell_ops.full_year_median(c.run.shops), "full_med")
check("mcc_median", "mrch_catg_cd:i med:d", lambda c: cell_ops.mcc_median(c.run.cells, "revenue"),
      "SELECT mrch_catg_cd, median(revenue) AS med FROM cells GROUP BY mrch_catg_cd")
check("price_stats", "postal_code:s avg_price_m2:d median_price_m2:d", lambda c: housing.price_stats(c.coded), "price_stats")
check("duplicate_profile", "n_rows:i n_duplicate_rows:i n_ids:i", lambda c: housing.duplicate_profile(c.sales, ["ulica", "powUzytkowaLokalu"]),
      """SELECT sum(n) AS n_rows, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS n_duplicate_rows, (SELECT count(DISTINCT id) FROM sales) AS n_ids
         FROM (SELECT count(*) AS n FROM sales GROUP BY ulica, powUzytkowaLokalu)""")
check("selection_totals", "n:i total_cost:d total_profit:d", lambda c: selection.selection_totals(selection.top_k_profit(c.candidates, 1e9, 20)),
      """SELECT count(*) AS n, coalesce(sum(ceil(total_cost)), 0) AS total_cost, coalesce(sum(profit), 0) AS total_profit FROM (
         SELECT total_cost, revenue - total_cost AS profit FROM candidates WHERE revenue > total_cost ORDER BY profit DESC, postal_code LIMIT 20)""")
check("grouped_quantile", "rodzajRynku:i liczbaIzb:i cenaTransakcjiBrutto:d", lambda c: common.grouped_quantile(c.sales, ["rodzajRynku", "liczbaIzb"], "cenaTransakcjiBrutto", 0.8),
      "SELECT rodzajRynku, liczbaIzb, quantile_cont(CAST(cenaTransakcjiBrutto AS DOUBLE), 0.8) AS cenaTransakcjiBrutto FROM sales GROUP BY rodzajRynku, liczbaIzb")

# --- windows and group-relative values ----------------------------------------------
check("shops_in_mcc", "merchant:s mcc:i shops_in_mcc:i",
      lambda c: registry.shops_in_mcc(registry.dominant_mcc(c.merchant_tx), P.min_shops_per_mcc),
      f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mcc) AS shops_in_mcc FROM (
            SELECT merchant, mcc FROM (SELECT merchant, mcc, row_number() OVER (PARTITION BY merchant ORDER BY sum(amt) DESC, count(*) DESC, mcc) AS rn
            FROM m_tx GROUP BY merchant, mcc) WHERE rn = 1)) WHERE shops_in_mcc >= {P.min_shops_per_mcc}""")
check("brand_tier", "store:s brand:s brand_tier:s", lambda c: shops.brand_tier(c.run.shops.drop("brand_tier")), "shops")
check("dedupe_keep_first", SALES, lambda c: common.dedupe_keep_first(c.sales, ["ulica", "powUzytkowaLokalu"], "id"),
      "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ulica, powUzytkowaLokalu ORDER BY id) AS rn FROM sales) WHERE rn = 1")
check("first_per_shop", TILLS + " year_revenue:d", lambda c: shops.first_per_shop(shops.year_revenue(c.run.tills)), "first_tills")
check("leave_one_out", "store:s " + " ".join(f"{c}:d" for c in demand.SUM_COLUMNS), lambda c: demand.leave_one_out(c.run.composition), "loo")
check("average_rank", "id:i powUzytkowaLokalu:d rank:d", lambda c: common.average_rank(c.priced, "powUzytkowaLokalu"),
      """SELECT id, powUzytkowaLokalu, rank() OVER (ORDER BY powUzytkowaLokalu) + (count(*) OVER (PARTITION BY powUzytkowaLokalu) - 1) / 2.0 AS rank FROM priced""")
check("running_best", "rodzajRynku:i id:i best:i", lambda c: common.running_best(c.sales.select("rodzajRynku", "cenaTransakcjiBrutto", "id", "powUzytkowaLokalu"), ["rodzajRynku"], "cenaTransakcjiBrutto", ["id"], "powUzytkowaLokalu", "best"),
      """SELECT rodzajRynku, id, max(powUzytkowaLokalu) OVER (PARTITION BY rodzajRynku ORDER BY cenaTransakcjiBrutto, id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sales""")

# --- sorts, limits, top-k; set operations ---------------------------------------------
check("ordered_output", CELLS, lambda c: common.ordered_output(c.run.cells, ["mrch_catg_cd", "pc5"]), "cells")
check("top_quintile_precision", "value:d", lambda c: model.top_quintile_precision(c.scored),
      "SELECT avg(CASE WHEN y >= cy THEN 1.0 ELSE 0.0 END) FILTER (WHERE pred_y >= cp) AS value FROM sample_fit, fit_cuts")
check("top_k_profit", "postal_code:s revenue:d total_cost:d profit:d", lambda c: selection.top_k_profit(c.candidates, 1e9, 7),
      "SELECT postal_code, revenue, total_cost, revenue - total_cost AS profit FROM candidates WHERE revenue > total_cost ORDER BY profit DESC, postal_code LIMIT 7")
check("stack_populations", "population:s n:i revenue:d",
      lambda c: model.stack_populations({n: f.agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue")) for n, f in
                                         (("full", c.run.shops.where("full_year")), ("all", c.run.shops))}),
      """SELECT 'full' AS population, count(*) AS n, sum(revenue) AS revenue FROM shops WHERE full_year
         UNION ALL SELECT 'all', count(*), sum(revenue) FROM shops""")
check("stack_oof", "pc5:s mrch_catg_cd:i predicted_revenue:d out_of_fold:b",
      lambda c: model.stack_oof(c.run.cells.withColumn("predicted_revenue", F.col("revenue")),
                                cell_ops.labelled_cells(c.run.cells, P.min_full_year).withColumn("predicted_revenue", F.col("revenue_full_year"))),
      f"""SELECT pc5, mrch_catg_cd, CASE WHEN n_full_year >= {P.min_full_year} AND revenue_full_year IS NOT NULL THEN revenue_full_year ELSE revenue END AS predicted_revenue,
          coalesce(n_full_year >= {P.min_full_year} AND revenue_full_year IS NOT NULL, false) AS out_of_fold FROM cells""")
check("distinct_names", "nm1:s", lambda c: registry.distinct_names(c.tx), "SELECT DISTINCT nm1 FROM tx")


def _xy(df: DataFrame) -> DataFrame:
    x, y = geo.parse_point(F.col("geometry_wkt"))
    return df.withColumns({"x": x, "y": y})


def _both_catchments(c: Inputs) -> DataFrame:
    areas, own = demand.catchment_join(c.run.nearby, c.run.wallet, c.run.split_shops, c.run.shop_home)
    return areas.join(own.join(c.run.split_shops.select("store", "shop_pc"), "store"), "shop_pc", "full")


# --- column functions -------------------------------------------------------------------
def expr(name: str, cols: str, table: str, columns: Callable[[], dict], sql: str, key: str | None = None) -> None:
    """A projection of one input table; ``key`` columns are kept beside the results."""
    def build(c: Inputs) -> DataFrame:
        source = {"card": lambda: c.card, "geo": lambda: c.geo, "sales": lambda: c.sales, "pages": lambda: c.table("pages"),
                  "documents": lambda: c.table("documents")}[table]()
        return source.select(*[v.alias(k) for k, v in columns().items()])
    check(f"expr_{name}", cols, build, f"SELECT {sql} FROM {table}")


C = F.col
expr("digits", "v:s", "card", lambda: {"v": text.digits(C("mrch_postal_code"))}, f"{o.dig('mrch_postal_code')} AS v")
expr("pc5", "v:s", "card", lambda: {"v": text.pc5(C("pstl_cd_enr"))}, f"{o.pc5('pstl_cd_enr')} AS v")
expr("postcode_dash", "v:s", "card", lambda: {"v": text.postcode_dash(text.pc5(C("mrch_postal_code")))},
     f"substr({o.pc5('mrch_postal_code')}, 1, 2) || '-' || substr({o.pc5('mrch_postal_code')}, 3) AS v")
expr("postcode_key", "v:s", "geo", lambda: {"v": text.postcode_key(C("postal_code"))}, "trim(replace(postal_code, '-', '')) AS v")
expr("name_norm", "v:s", "card", lambda: {"v": text.name_norm(C("mrch_nm_raw"))}, f"{o.norm('mrch_nm_raw')} AS v")
expr("name_norm_text", "doc_id:i v:s", "documents", lambda: {"doc_id": C("doc_id"), "v": text.name_norm(C("text"))}, f"doc_id, {o.norm('text')} AS v")
expr("strip_tills", "v:s", "card", lambda: {"v": text.strip_tills(text.name_norm(C("mrch_nm_raw")))}, f"{o.no_tills(o.norm('mrch_nm_raw'))} AS v")
expr("split_trailing_number", "base:s num:s", "card",
     lambda: dict(zip(("base", "num"), text.split_trailing_number(text.name_norm(C("mrch_nm_raw"))))),
     f"""CASE WHEN regexp_matches({o.norm('mrch_nm_raw')}, '^.* [0-9]{{1,2}}$') THEN trim(regexp_extract({o.norm('mrch_nm_raw')}, '^(.*) [0-9]{{1,2}}$', 1))
         ELSE {o.norm('mrch_nm_raw')} END AS base, regexp_extract({o.norm('mrch_nm_raw')}, ' ([0-9]{{1,2}})$', 1) AS num""")
expr("store_name", "v:s", "card", lambda: {"v": text.store_name(C("mrch_city_nm_raw"), F.when(C("cp_flag") == 1, C("mrch_catg_cd").cast("string")).otherwise(""))},
     "CASE WHEN cp_flag = 1 THEN mrch_city_nm_raw || ' ' || mrch_catg_cd ELSE mrch_city_nm_raw END AS v")
expr("merchant_id", "v:s", "card", lambda: {"v": text.merchant_id(C("mrch_nm_raw"), C("mrch_city_nm_raw"), C("mrch_catg_cd") == 5812, C("cp_flag") == 0, text.pc5(C("mrch_postal_code")))},
     f"""mrch_nm_raw || '|' || mrch_city_nm_raw || CASE WHEN mrch_catg_cd <> 5812 THEN '' WHEN cp_flag = 0 OR {o.pc5('mrch_postal_code')} IS NULL THEN '|HUB'
         ELSE '|' || {o.pc5('mrch_postal_code')} END AS v""")
expr("haversine_km", "row_no:i v:d", "geo", lambda: {"row_no": C("row_no"), "v": geo.haversine_km(C("latitude"), C("longitude"), F.lit(50.0614), F.lit(19.9366))},
     f"row_no, {o.hav('latitude', 'longitude', '50.0614', '19.9366')} AS v")
expr("is_weekend", "prch_dt:s v:b", "card", lambda: {"prch_dt": C("prch_dt"), "v": flags.is_weekend(C("prch_dt"))}, "prch_dt, isodow(prch_dt) > 5 AS v")
expr("is_dinner", "tran_id_gmt_tm:i v:b", "card", lambda: {"tran_id_gmt_tm": C("tran_id_gmt_tm"), "v": flags.is_dinner(C("tran_id_gmt_tm"))},
     "tran_id_gmt_tm, (tran_id_gmt_tm // 10000 + 2) % 24 BETWEEN 17 AND 21 AS v")
expr("is_foreign", "issr_ctry_cd:s v:b", "card", lambda: {"issr_ctry_cd": C("issr_ctry_cd"), "v": flags.is_foreign(C("issr_ctry_cd"))},
     "issr_ctry_cd, TRY_CAST(issr_ctry_cd AS INT) <> 616 AS v")
expr("is_premium", "crd_typ_nm:s v:b", "card", lambda: {"crd_typ_nm": C("crd_typ_nm"), "v": flags.is_premium(C("crd_typ_nm"))},
     f"crd_typ_nm, regexp_matches(upper(coalesce(crd_typ_nm, '')), {o.q('|'.join(flags.PREMIUM_WORDS))}) AS v")
expr("is_business", "prod_id_pltfrm_cd_vcis:s v:b", "card", lambda: {"prod_id_pltfrm_cd_vcis": C("prod_id_pltfrm_cd_vcis"), "v": flags.is_business(C("prod_id_pltfrm_cd_vcis"))},
     "prod_id_pltfrm_cd_vcis, upper(coalesce(prod_id_pltfrm_cd_vcis, '')) IN ('CO', 'BZ', 'GV') AS v")
expr("safe_share", "id:i v:d", "sales", lambda: {"id": C("id"), "v": flags.safe_share(C("powUzytkowaLokalu").cast("double"), C("nrKondygnacji").cast("double"))},
     "id, CASE WHEN nrKondygnacji > 0 THEN powUzytkowaLokalu / CAST(nrKondygnacji AS DOUBLE) END AS v")
expr("outside_share", "id:i v:d", "sales", lambda: {"id": C("id"), "v": flags.outside_share(C("nrKondygnacji").cast("double"), C("liczbaIzb").cast("double"))},
     "id, CASE WHEN nrKondygnacji > 0 THEN greatest(nrKondygnacji - liczbaIzb, 0) / CAST(nrKondygnacji AS DOUBLE) END AS v")
expr("per_shop_features", "id:i cards_per_shop:d spend_per_shop_proxy:d", "sales",
     lambda: {"id": C("id"), **flags.per_shop_features(C("powUzytkowaLokalu"), C("liczbaIzb"), C("nrKondygnacji"), C("cenaTransakcjiBrutto").cast("double"))},
     "id, powUzytkowaLokalu / CAST(liczbaIzb AS DOUBLE) AS cards_per_shop, powUzytkowaLokalu / CAST(liczbaIzb AS DOUBLE) * nrKondygnacji * CAST(cenaTransakcjiBrutto AS DOUBLE) AS spend_per_shop_proxy")
expr("price_per_m2", "id:i v:x", "sales", lambda: {"id": C("id"), "v": flags.price_per_m2(C("cenaTransakcjiBrutto"), C("powUzytkowaLokalu"))},
     "id, CAST(cenaTransakcjiBrutto AS DOUBLE) / powUzytkowaLokalu AS v")
expr("doc_year", "id:i v:i", "sales", lambda: {"id": C("id"), "v": flags.doc_year(C("dataSporzadzeniaDokumentu"))},
     "id, year(TRY_CAST(dataSporzadzeniaDokumentu AS DATE)) AS v")
expr("amenity_flags", "id:i has_parking:i has_balcony:i has_storage:i", "sales", lambda: {"id": C("id"), **flags.amenity_flags(C("dodatkoweInformacje"))},
     f"id, {o.words_flag('dodatkoweInformacje', flags.PARKING_WORDS)} AS has_parking, {o.words_flag('dodatkoweInformacje', flags.BALCONY_WORDS)} AS has_balcony, {o.words_flag('dodatkoweInformacje', flags.STORAGE_WORDS)} AS has_storage")
_X, _Y = o.wkt_number("geometry_wkt", 1), o.wkt_number("geometry_wkt", 2)
expr("distance_to_centre", "id:i v:d", "sales", lambda: {"id": C("id"), "v": geo.distance_to_centre(*geo.parse_point(C("geometry_wkt")))},
     f"id, sqrt(pow({_X} - 566350, 2) + pow({_Y} - 244150, 2)) AS v")
expr("point_wkt", "row_no:i v:s", "geo", lambda: {"row_no": C("row_no"), "v": geo.point_wkt(C("longitude"), C("latitude"))},
     "row_no, printf('POINT(%.6f %.6f)', longitude, latitude) AS v")
expr("parse_point", "id:i x:d y:d", "sales", lambda: {"id": C("id"), **dict(zip("xy", geo.parse_point(C("geometry_wkt"))))}, f"id, {_X} AS x, {_Y} AS y")
_E, _N = o.tm_forward("latitude", "longitude")
check("expr_to_epsg2180", "row_no:i x:d y:d",
      lambda c: geo.to_epsg2180(c.geo).select("row_no", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")),
      f"SELECT row_no, round({_E}, 3) AS x, round({_N}, 3) AS y FROM geo")
_LAT, _LON = o.tm_inverse(f"({_X} - 560000 + 7420000)", f"({_Y} - 240000 + 5540000)", geo.PL_2000_ZONE_7)


def _reprojected(c: Inputs) -> DataFrame:
    x, y = geo.parse_point(C("geometry_wkt"))
    shifted = c.sales.select("id", (x - 560000 + 7420000).alias("x"), (y - 240000 + 5540000).alias("y"))
    return geo.reproject_2178_2180(shifted).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


_RE, _RN = o.tm_forward("lat", "lon")
check("expr_reproject_2178_2180", "id:i x:d y:d", _reprojected,
      f"SELECT id, round({_RE}, 3) AS x, round({_RN}, 3) AS y FROM (SELECT id, {_LAT} AS lat, {_LON} AS lon FROM sales)")
expr("href_id", "v:s", "sales", lambda: {"v": text.href_id(F.concat(F.lit("#T"), C("id").cast("string")))}, "'T' || id AS v")
expr("location_cost", "id:i cost:d up:i profit:d", "sales",
     lambda: (lambda cost: {"id": C("id"), "cost": cost, "up": F.ceil(cost), "profit": C("cenaTransakcjiBrutto").cast("double") - cost})(
         flags.location_cost(C("powUzytkowaLokalu").cast("double"), F.lit(25.0))),
     "id, powUzytkowaLokalu * 25.0::DOUBLE / 12 AS cost, ceil(powUzytkowaLokalu * 25.0::DOUBLE / 12) AS up, CAST(cenaTransakcjiBrutto AS DOUBLE) - powUzytkowaLokalu * 25.0::DOUBLE / 12 AS profit")
expr("ape", "id:i v:d", "sales", lambda: {"id": C("id"), "v": flags.ape(C("cenaTransakcjiBrutto").cast("double"), C("powUzytkowaLokalu") * 1000.0)},
     "id, abs(CAST(cenaTransakcjiBrutto AS DOUBLE) - powUzytkowaLokalu * 1000.0::DOUBLE) / CAST(cenaTransakcjiBrutto AS DOUBLE) AS v")
expr("log_target", "id:i v:d back:d", "sales",
     lambda: {"id": C("id"), "v": flags.log_target(C("cenaTransakcjiBrutto").cast("double"), F.lit(5000.0)),
              "back": flags.unlog_target(F.ln(C("powUzytkowaLokalu")), F.lit(2.0))},
     "id, ln(CAST(cenaTransakcjiBrutto AS DOUBLE) / 5000) AS v, exp(ln(powUzytkowaLokalu)) * 2 AS back")


def _sql_functions(c: Inputs) -> DataFrame:
    register_functions(c.spark)
    return c.card.select("mrch_nm_raw", "mrch_postal_code").select(
        F.expr("strip_tills(name_norm(mrch_nm_raw))").alias("nm1"), F.expr("digits(mrch_postal_code)").alias("d"),
        F.expr("hav_km(50D, 19D, 50D + length(mrch_nm_raw) / 100D, 20D)").alias("km"))


check("register_functions", "nm1:s d:s km:d", _sql_functions,
      f"""SELECT {o.no_tills(o.norm('mrch_nm_raw'))} AS nm1, {o.dig('mrch_postal_code')} AS d,
          {o.hav('50', '19', '(50 + length(mrch_nm_raw) / 100.0::DOUBLE)', '20')} AS km FROM card""")

# --- brands -------------------------------------------------------------------------------
def _name_rows(c: Inputs) -> DataFrame:
    return c.tx.select("nm1", "city").distinct()


NAMES = "(SELECT DISTINCT nm1, city, 'm' AS merchant FROM tx)"
_STEPS = o.brand_steps(NAMES, "nm1", "city", "merchant")
check("vending_filter", "nm1:s city:s vending:b", lambda c: _name_rows(c).withColumn("vending", brands.vending_filter(C("nm1"))), _STEPS)
check("clean_base", "nm1:s city:s base:s", lambda c: _name_rows(c).withColumn("base", brands.clean_base(C("nm1"), C("city"))), _STEPS)
check("operator_prefix", "nm1:s city:s op_chain:s", lambda c: _name_rows(c).withColumn("op_chain", brands.operator_prefix(C("nm1"))), _STEPS)
check("chain_match", "nm1:s city:s base_chain:s",
      lambda c: _name_rows(c).withColumn("base_chain", brands.chain_match(brands.clean_base(C("nm1"), C("city")))),
      f"SELECT nm1, city, base_chain FROM ({_STEPS})")
check("generic_test", "tok:s v:b", lambda c: _name_rows(c).select(F.explode(F.split("nm1", " ")).alias("tok")).distinct().withColumn("v", brands.generic_test(C("tok"))),
      f"""SELECT tok, list_contains({o.names(brands.generic_vocabulary())}, tok) AS v FROM (SELECT DISTINCT unnest(string_split(nm1, ' ')) AS tok FROM tx)""")
check("assign_brands", BRANDED, lambda c: brands.assign_brands(registry.merchant_join(c.rest_cp, c.run.location, c.run.centroids)), "branded")

# --- register links ---------------------------------------------------------------------------
for _key, _feature, _ids, _cte in (
    ("edges_transaction_property", "RCN_Transakcja", "id_transakcji:s id_nieruchomosci:s", "e_tp"),
    ("edges_transaction_document", "RCN_Transakcja", "id_transakcji:s id_dokumentu:s", "e_td"),
    ("edges_property_premises", "RCN_Nieruchomosc", "id_nieruchomosci:s id_lokalu:s", "e_pl"),
    ("edges_property_building", "RCN_Nieruchomosc", "id_nieruchomosci:s id_budynku:s", "e_pb"),
    ("edges_property_parcel", "RCN_Nieruchomosc", "id_nieruchomosci:s id_dzialki:s", "e_pd"),
    ("edges_premises_address", "RCN_Lokal", "id_lokalu:s id_adresu:s", "e_la"),
):
    check(_key, _ids, lambda c, k=_key, f=_feature: getattr(register, k)(c.register_run.layer(f)), _cte)

# --- model and selection --------------------------------------------------------------------------
SMALL_GBT = {"maxIter": 5, "minInstancesPerNode": 1}
check("shop_split", "store:s split:s", lambda c: shops.shop_split(c.run.shops), f"SELECT store, {o.in_hash('store')} AS split FROM shops")
check("cell_split", "pc5:s mrch_catg_cd:i split:s", lambda c: cell_ops.cell_split(c.run.cells), f"SELECT pc5, mrch_catg_cd, {o.in_hash('pc5')} AS split FROM cells")
check("impute_median", "pc5:s mrch_catg_cd:i avg_ticket:d local_share:d grocery_spend:d",
      lambda c: cell_ops.impute_median(c.run.cells.where("split = 'train'"), c.run.cells, ["avg_ticket", "local_share", "grocery_spend"]),
      """SELECT c.pc5, c.mrch_catg_cd, coalesce(c.avg_ticket, m.a) AS avg_ticket, coalesce(c.local_share, m.l) AS local_share, coalesce(c.grocery_spend, m.g) AS grocery_spend
         FROM cells c, (SELECT median(avg_ticket) AS a, median(local_share) AS l, median(grocery_spend) AS g FROM cells WHERE split = 'train') m""")
# SQL grows no trees, so it fixes the rows, the scales and who may be scored, not the scores.
_FOLD = "CAST(('0x' || substr(md5('fold|' || {0}.pc5), 1, 8)) AS BIGINT) % 5"


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("scored", F.coalesce(C("predicted_revenue") > 0, F.lit(False)))


check("fit_revenue", "pc5:s mrch_catg_cd:i med:d scored:b",
      lambda c: _scored(model.fit_revenue(c.run.cells, "revenue", **SMALL_GBT).score(c.run.cells)),
      """SELECT c.pc5, c.mrch_catg_cd, m.med, m.med IS NOT NULL AS scored FROM cells c
         LEFT JOIN (SELECT mrch_catg_cd, median(revenue) AS med FROM cells GROUP BY mrch_catg_cd) m ON m.mrch_catg_cd = c.mrch_catg_cd""")
check("predict_all", "pc5:s mrch_catg_cd:i out_of_fold:b scored:b",
      lambda c: _scored(model.predict_all(c.run.cells, "revenue", min_full_year=0, **SMALL_GBT)),
      f"""SELECT c.pc5, c.mrch_catg_cd, c.revenue IS NOT NULL AND EXISTS (SELECT 1 FROM cells r WHERE r.mrch_catg_cd = c.mrch_catg_cd
              AND r.revenue IS NOT NULL AND {_FOLD.format('r')} <> {_FOLD.format('c')}) AS out_of_fold,
          EXISTS (SELECT 1 FROM cells r WHERE r.mrch_catg_cd = c.mrch_catg_cd AND r.revenue IS NOT NULL) AS scored FROM cells c""")
check("heldout_predictions", "pc5:s mrch_catg_cd:i district:s n_shops:i n_full_year:i actual_revenue:d scored:b error_right:b",
      lambda c: _scored(model.heldout_predictions(c.run.cells, "revenue", **SMALL_GBT)).withColumn(
          "error_right", F.abs(C("ape") * C("actual_revenue") - F.abs(C("actual_revenue") - C("predicted_revenue"))) < 1e-6),
      """SELECT pc5, mrch_catg_cd, district, n_shops, n_full_year, revenue AS actual_revenue, trained AS scored, CASE WHEN trained THEN true END AS error_right
         FROM (SELECT c.*, EXISTS (SELECT 1 FROM cells r WHERE r.mrch_catg_cd = c.mrch_catg_cd AND r.split = 'train' AND r.revenue IS NOT NULL) AS trained
               FROM cells c WHERE c.split = 'test' AND c.revenue IS NOT NULL)""")
check("out_of_fold_report", "cells:i mape:d median_ape:d full_model_cells:i",
      lambda c: model.out_of_fold_report(c.run.cells.withColumn("predicted_revenue", C("revenue")).withColumn(
          "out_of_fold", (C("n_full_year") >= P.min_full_year) & C("revenue_full_year").isNotNull())),
      f"""SELECT count(*) FILTER (WHERE held) AS cells, avg(e) AS mape, median(e) AS median_ape, count(*) FILTER (WHERE NOT held) AS full_model_cells
          FROM (SELECT held, CASE WHEN held THEN abs(revenue_full_year - revenue) / revenue_full_year END AS e
                FROM (SELECT *, n_full_year >= {P.min_full_year} AND revenue_full_year IS NOT NULL AS held FROM cells))""")
check("model_metrics", "cells:i r2:d mape:d median_ape:d spearman:d top20_precision:d", lambda c: model.model_metrics(c.scored),
      """SELECT count(*) AS cells, 1 - sum((y - pred_y) * (y - pred_y)) / sum((y - my) * (y - my)) AS r2, avg(e) AS mape, median(e) AS median_ape,
                corr(ry, rp) AS spearman, avg(CASE WHEN y >= cy THEN 1.0 ELSE 0.0 END) FILTER (WHERE pred_y >= cp) AS top20_precision FROM fit_ranks, fit_cuts""")
check("zip_revenue", "zip_code:s type:s predicted_revenue:d", lambda c: model.zip_revenue(c.run.cells.withColumn("predicted_revenue", F.col("revenue"))),
      """SELECT substr(pc5, 1, 2) || '-' || substr(pc5, 3) AS zip_code, CASE mrch_catg_cd WHEN 5812 THEN 'restaurant' WHEN 5814 THEN 'fast food' END AS type,
         round(revenue, 2) AS predicted_revenue FROM cells""")


def _scenarios(c: Inputs) -> DataFrame:
    """One scenario per supplier over the parts of one brand."""
    return c.table("supplier").select(
        F.col("s_suppkey").alias("scenario_id"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("type"),
        (F.lit(200.0) + (F.col("s_suppkey") % 7) * 150).alias("budget"), F.lit(12.0).alias("area_m2"), (1 + F.col("s_suppkey") % 6).cast("int").alias("k"),
    )


def _select(c: Inputs, k: int | None = None, max_gap: float = selection.MAX_GAP) -> DataFrame:
    offers = c.parts.select("postal_code", "type", "revenue", F.col("total_cost").alias("avg_price_m2"))
    scenarios = _scenarios(c)
    return selection.select_locations(offers, scenarios.withColumn("k", F.lit(k)) if k else scenarios, max_gap=max_gap)


_ASKED = """SELECT s_suppkey AS scenario_id, 'Brand#' || (s_suppkey % 25 + 1) AS type, 200 + s_suppkey % 7 * 150 AS budget FROM supplier"""
check("select_locations_k1", "scenario_id:i postal_code:s revenue:d total_cost:d profit:d", lambda c: _select(c, 1),
      f"""SELECT scenario_id, postal_code, revenue, total_cost, profit FROM (
            SELECT s.scenario_id, p.postal_code, p.revenue, p.total_cost, p.revenue - p.total_cost AS profit,
                   row_number() OVER (PARTITION BY s.scenario_id ORDER BY p.revenue - p.total_cost DESC, p.total_cost, p.postal_code) AS rn
            FROM ({_ASKED}) s JOIN part_items p ON p.type = s.type AND p.total_cost <= s.budget AND p.revenue > p.total_cost) WHERE rn = 1""")


def _choice_facts(c: Inputs) -> DataFrame:
    """What holds for a choice whatever codes it names, and the best single profit it competes with."""
    chosen = _select(c).groupBy("scenario_id").agg(
        F.count("*").alias("n"), F.count_distinct("postal_code").alias("codes"), F.sum("total_cost").alias("cost"),
        F.sum("profit").alias("profit"), F.max("bound").alias("bound"), F.max("gap").alias("gap"))
    single = _select(c, 1).select("scenario_id", C("profit").alias("best_single"))
    met = _scenarios(c).join(chosen, "scenario_id").join(single, "scenario_id")
    return met.select("scenario_id", "best_single", (C("n") <= C("k")).alias("count_kept"), (C("n") == C("codes")).alias("codes_differ"),
                      (C("cost") <= C("budget") + 1e-6).alias("budget_kept"), (C("profit") <= C("bound") + 1e-6).alias("bound_holds"),
                      (C("profit") >= C("best_single") - 1e-6).alias("beats_single"), (C("gap") <= selection.MAX_GAP + 1e-9).alias("gap_kept"),
                      (F.abs(C("gap") * C("bound") - (C("bound") - C("profit"))) < 1e-6).alias("gap_right"))


check("select_locations", "scenario_id:i best_single:d count_kept:b codes_differ:b budget_kept:b bound_holds:b beats_single:b gap_kept:b gap_right:b",
      _choice_facts,
      f"""SELECT s.scenario_id, max(p.revenue - p.total_cost) AS best_single, true AS count_kept, true AS codes_differ, true AS budget_kept,
                 true AS bound_holds, true AS beats_single, true AS gap_kept, true AS gap_right
          FROM ({_ASKED}) s JOIN part_items p ON p.type = s.type AND p.total_cost <= s.budget AND p.revenue > p.total_cost GROUP BY s.scenario_id""")
_OFFERED = f"""(SELECT s.scenario_id, s.budget, p.postal_code AS code, p.total_cost AS cost, p.revenue - p.total_cost AS profit
                FROM ({_ASKED}) s JOIN part_items p ON p.type = s.type AND p.total_cost <= s.budget AND p.revenue > p.total_cost)"""
_PAIR = f"LEFT JOIN {_OFFERED} b ON b.scenario_id = a.scenario_id AND b.code > a.code AND a.cost + b.cost <= a.budget"
_THIRD = f"LEFT JOIN {_OFFERED} d ON d.scenario_id = a.scenario_id AND d.code > b.code AND a.cost + b.cost + d.cost <= a.budget"
# Without a gap the choice of many scenarios is the best set; SQL tries every set.
for _k, _joins, _profit in ((2, _PAIR, "coalesce(b.profit, 0)"), (3, f"{_PAIR} {_THIRD}", "coalesce(b.profit, 0) + coalesce(d.profit, 0)")):
    check(f"select_locations_best_of_{_k}", "scenario_id:i profit:d",
          lambda c, k=_k: _select(c, k, 0.0).groupBy("scenario_id").agg(F.sum("profit").alias("profit")),
          f"SELECT a.scenario_id, max(a.profit + {_profit}) AS profit FROM {_OFFERED} a {_joins} GROUP BY a.scenario_id")
check("select_locations_exact_k2", "pc_a:s pc_b:s profit:d", lambda c: selection.select_locations_exact_k2(c.parts, 300.0),
      """SELECT least(a.postal_code, b.postal_code) AS pc_a, greatest(a.postal_code, b.postal_code) AS pc_b,
                a.revenue - a.total_cost + b.revenue - b.total_cost AS profit
         FROM part_items a JOIN part_items b ON a.postal_code < b.postal_code AND a.total_cost + b.total_cost <= 300
         ORDER BY profit DESC, pc_a, pc_b LIMIT 1""")
check("sale_features", HOMES,
      lambda c: housing.sale_features(housing.clean_sales(c.priced, "id"), c.polygons, reproject=False, years=(1995, 1997)),
      f"""SELECT s.cena_m2, s.powUzytkowaLokalu, s.nrKondygnacji, s.liczbaIzb, CASE s.rodzajRynku WHEN 1 THEN 'Pierwotny' ELSE 'Wtórny' END AS rodzajRynku,
                 n.n_name AS dzielnica, year(TRY_CAST(s.dataSporzadzeniaDokumentu AS DATE)) AS rok,
                 sqrt(pow(s.x - 566350, 2) + pow(s.y - 244150, 2)) AS dist_to_center, {o.words_flag('dodatkoweInformacje', flags.PARKING_WORDS)} AS has_parking,
                 {o.words_flag('dodatkoweInformacje', flags.BALCONY_WORDS)} AS has_balcony, {o.words_flag('dodatkoweInformacje', flags.STORAGE_WORDS)} AS has_storage,
                 s.x AS X_2180, s.y AS Y_2180
          FROM first_sales s JOIN shapes n ON s.x > n.x0 AND s.x < n.x0 + 2500 AND s.y > n.y0 AND s.y < n.y0 + 1500
           AND (n.n_nationkey % 2 = 0 OR s.y < n.y0 + 700 OR s.x < n.x0 + 1200)
          WHERE NOT regexp_matches(lower(coalesce(dodatkoweInformacje, '')), {o.q('|'.join(flags.FRACTIONAL_WORDS))})
            AND powUzytkowaLokalu BETWEEN 15 AND 200 AND starts_with(funkcjaLokalu, '1') AND starts_with(rodzajTransakcji, '1') AND rodzajBudynku = 110
            AND year(TRY_CAST(dataSporzadzeniaDokumentu AS DATE)) BETWEEN 1995 AND 1997 AND nrKondygnacji >= 0""")


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(spark, sf_dir.rstrip("/"))
