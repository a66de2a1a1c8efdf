"""The given tables in the shape of the library's inputs, as SQL for two engines."""

from __future__ import annotations

from placewise.params import Params

PARAMS = Params(
    train_year=(199801, 199812),
    target_year=(199807, 199906),
    half_first=(199807, 199812),
    half_second=(199901, 199906),
    trend_before=(199801, 199806),
    trend_after=(199901, 199906),
    card_window=(199801, 199906),
    hub_min_names=8,
    min_cards=5,
    min_shops_per_mcc=10,
    min_registrations=2,
    min_full_year=1,
)

CARD_TX = """
SELECT 'C' || CAST(o.o_custkey AS STRING) AS pymt_crd_acct_num_raw,
       CAST(year(l.l_shipdate) * 100 + month(l.l_shipdate) AS INT) AS prch_mnth_id,
       CAST(l.l_shipdate AS DATE) AS prch_dt,
       CAST((l.l_orderkey * 7919 + l.l_linenumber * 104729) % 240000 AS INT) AS tran_id_gmt_tm,
       CAST(split_part('5812,5812,5812,5814,5814,5814,5811,5813,5411,7011', ',', CAST((l.l_suppkey + CASE WHEN l.l_linenumber = 3 AND l.l_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 10 AS INT) + 1) AS INT) AS mrch_catg_cd,
       CASE WHEN l.l_orderkey % 19 = 0 THEN 0 ELSE 1 END AS cp_flag,
       CASE WHEN l.l_orderkey % 23 = 0 THEN 'ATM' ELSE 'PURCHASE' END AS transaction_type,
       CASE WHEN l.l_partkey % 20 = 0 THEN 276 ELSE 616 END AS mrch_ctry_cd,
       split_part('McDonald''s|PL KFC Galeria|Pizzeria Da Grasso|Restauracja|Bar Mleczny|Bafra Kebab|Żółty Smok|U Babci Malina|Automaty AS Vending|Cafe Łąka Sp z o o|FHU Kawiarnia Słonecz44103|Am Am Kebab|SUMUP Piccolo|Anna|Hanoi52790|The King Kebab', '|', CAST(l.l_suppkey % 16 AS INT) + 1)
         || CASE WHEN l.l_suppkey % 5 = 0 THEN ' 3' ELSE '' END
         || CASE l.l_orderkey % 4 WHEN 0 THEN ' KASA 1' WHEN 1 THEN ' POS 12' WHEN 2 THEN ' 2' ELSE '' END AS mrch_nm_raw,
       split_part('Kraków|Łódź|Gdańsk|Poznań|Wrocław|Zakopane', '|', CAST(l.l_suppkey % 6 AS INT) + 1) AS mrch_city_nm_raw,
       CASE WHEN l.l_orderkey % 11 = 0 THEN '30-000'
            WHEN l.l_orderkey % 13 = 0 THEN 'n/a'
            ELSE '30-' || lpad(CAST((l.l_suppkey % 39 + 1) * 7 AS STRING), 3, '0') END AS mrch_postal_code,
       CAST(l.l_extendedprice AS DECIMAL(18, 2)) AS cs_tran_amt,
       CASE WHEN o.o_custkey % 17 = 0 THEN NULL ELSE '30' || lpad(CAST((o.o_custkey % 40) * 7 AS STRING), 3, '0') END AS pstl_cd_enr,
       CASE WHEN c.c_nationkey % 5 = 0 THEN '276' WHEN c.c_nationkey % 7 = 0 THEN 'x' ELSE '616' END AS issr_ctry_cd,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Visa Gold' WHEN 'MACHINERY' THEN 'Infinite' WHEN 'HOUSEHOLD' THEN NULL ELSE 'Classic' END AS crd_typ_nm,
       CASE WHEN o.o_orderkey % 9 = 0 THEN 'bz' WHEN o.o_orderkey % 9 = 1 THEN 'CO' ELSE 'cr' END AS prod_id_pltfrm_cd_vcis
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

GEONAMES = """
SELECT 'PL' AS country_code,
       '30-' || lpad(CAST((c_custkey % 40) * 7 AS STRING), 3, '0') AS postal_code,
       split_part('Kraków|Łódź|Gdańsk|Poznań|Wrocław|Zakopane', '|', CAST(c_custkey % 40 % 6 AS INT) + 1) AS place_name,
       'V' || CAST(c_custkey % 40 % 2 AS STRING) AS admin_name1,
       CAST(c_custkey % 40 % 2 AS STRING) AS admin_code1,
       CASE c_custkey % 40 % 6 WHEN 0 THEN 'Kraków' WHEN 1 THEN 'powiat krakowski' ELSE 'Powiat ' || CAST(c_custkey % 40 % 4 AS STRING) END AS admin_name2,
       CAST(c_custkey % 40 % 6 AS STRING) AS admin_code2,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Gmina ' || CAST(c_custkey % 9 AS STRING) END AS admin_name3,
       CAST(c_custkey % 9 AS STRING) AS admin_code3,
       CAST(50.0 + (c_custkey % 40) * 0.01 + (c_custkey % 7) * 0.001 AS DOUBLE) AS latitude,
       CAST(19.8 + (c_custkey % 8) * 0.03 AS DOUBLE) AS longitude,
       '4' AS accuracy,
       c_custkey AS row_no
FROM {customer}
"""

SALES = """
SELECT o_orderkey AS id,
       CAST(o_totalprice AS DECIMAL(18, 2)) AS cenaTransakcjiBrutto,
       CAST(12 + o_orderkey % 200 AS INT) AS powUzytkowaLokalu,
       'Street ' || CAST(o_custkey % 50 AS STRING) AS ulica,
       'POINT(' || CAST(560000 + (o_custkey * 37) % 14000 AS STRING) || ' ' || CAST(240000 + (o_custkey * 53) % 9000 AS STRING) || ')' AS geometry_wkt,
       CASE WHEN o_orderkey % 97 = 0 THEN 'bad date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS dataSporzadzeniaDokumentu,
       CASE o_orderkey % 8 WHEN 0 THEN 'Miejsce postojowe, piwnica' WHEN 1 THEN 'GARAŻ i BALKON' WHEN 2 THEN 'udział 1/2' WHEN 3 THEN 'Komórka, taras' WHEN 4 THEN NULL ELSE 'brak' END AS dodatkoweInformacje,
       CAST(1 + o_orderkey % 2 AS INT) AS rodzajRynku,
       CAST(o_orderkey % 12 - 1 AS INT) AS nrKondygnacji,
       CAST(1 + o_orderkey % 5 AS INT) AS liczbaIzb,
       CASE WHEN o_orderkey % 10 = 0 THEN '2_inna' ELSE '1_mieszkalna' END AS funkcjaLokalu,
       CASE WHEN o_orderkey % 14 = 0 THEN '3' ELSE '1' END AS rodzajTransakcji,
       CASE WHEN o_orderkey % 15 = 0 THEN 122 ELSE 110 END AS rodzajBudynku
FROM {orders}
"""

TABLES = ("lineitem", "orders", "customer", "part", "supplier", "documents", "pages")


def for_duckdb(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def for_spark(sql: str, sf_dir: str) -> str:
    return sql.format(**{t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in TABLES})
