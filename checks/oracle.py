"""SQL twins: named building blocks that each check chains into one statement."""

from __future__ import annotations

import re

from checks import views
from placewise.functions import brands, flags, geo
from placewise.functions.text import TILL_RE, TRAILING_NUMBER_RE

P = views.PARAMS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def dig(x: str) -> str:
    return f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '[^0-9]', '', 'g')"


def pc5(x: str) -> str:
    return f"CASE WHEN length({dig(x)}) = 5 THEN {dig(x)} END"


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(upper(coalesce({x}, ''))), 'Ł', 'L'), '[^A-Z0-9]+', ' ', 'g'))"


def no_tills(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(TILL_RE)}, ''))"


def between(window, col: str = "month") -> str:
    return f"{col} BETWEEN {window[0]} AND {window[1]}"


def share(part: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN CAST({part} AS DOUBLE) / CAST({total} AS DOUBLE) END"


def hav(a1: str, o1: str, a2: str, o2: str) -> str:
    return (
        f"2 * 6371.0 * asin(sqrt(pow(sin(radians({a2} - {a1}) / 2), 2)"
        f" + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2)))"
    )


def tm_forward(lat: str, lon: str, grid=geo.PL_1992) -> tuple[str, str]:
    lon0, k0, fe, fn = grid
    e = repr(geo.ECCENTRICITY)
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {e} * atanh({e} * {s}))"
    dl = f"radians({lon} - {lon0})"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + pow({t}, 2)))"
    a = geo.ALPHA
    es = " + ".join(f"{a[j]!r} * cos({2 * j + 2} * {xi}) * sinh({2 * j + 2} * {eta})" for j in range(4))
    ns = " + ".join(f"{a[j]!r} * sin({2 * j + 2} * {xi}) * cosh({2 * j + 2} * {eta})" for j in range(4))
    size = repr(k0 * geo.RECTIFYING)
    return f"({fe} + {size} * ({eta} + {es}))", f"({fn} + {size} * ({xi} + {ns}))"


def tm_inverse(east: str, north: str, grid) -> tuple[str, str]:
    lon0, k0, fe, fn = grid
    size = repr(k0 * geo.RECTIFYING)
    xi, eta = f"(({north} - {fn}) / {size})", f"(({east} - {fe}) / {size})"
    b = geo.BETA
    x = f"({xi} - (" + " + ".join(f"{b[j]!r} * sin({2 * j + 2} * {xi}) * cosh({2 * j + 2} * {eta})" for j in range(4)) + "))"
    n = f"({eta} - (" + " + ".join(f"{b[j]!r} * cos({2 * j + 2} * {xi}) * sinh({2 * j + 2} * {eta})" for j in range(4)) + "))"
    chi = f"asin(sin({x}) / cosh({n}))"
    lat = f"degrees({chi} + " + " + ".join(f"{geo.DELTA[j]!r} * sin({2 * j + 2} * {chi})" for j in range(4)) + ")"
    return lat, f"({lon0} + degrees(atan2(sinh({n}), cos({x}))))"


def wkt_number(col: str, which: int) -> str:
    return f"TRY_CAST(regexp_extract({col}, '^POINT ?\\(([-0-9.]+) ([-0-9.]+)', {which}) AS DOUBLE)"


def words_flag(col: str, words) -> str:
    return f"CAST(regexp_matches(lower(coalesce({col}, '')), {q('|'.join(words))}) AS INT)"


def in_hash(key: str) -> str:
    return f"CASE WHEN CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) < {int(0.7 * 2**32)} THEN 'train' ELSE 'test' END"


def brand_steps(source: str, name: str, city: str, merchant: str) -> str:
    """Rows of ``source`` with base, chain_name, vague, vending and brand."""
    prefixes = "|".join(brands.FACILITATOR_PREFIXES)
    generic = names(brands.generic_vocabulary())
    chain_case = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN {q(c)}" for c, p in brands.CHAINS.items()) + " END"
    operator = "CASE " + " ".join(
        f"WHEN {name} = {q(p)} OR starts_with({name}, {q(p + ' ')}) THEN {q(c)}" for p, c in brands.OPERATOR_PREFIXES.items()
    ) + " END"
    return f"""
    SELECT *, CASE WHEN vending THEN NULL WHEN chain_name IS NOT NULL THEN chain_name
                   WHEN vague THEN '#' || {merchant} ELSE base END AS brand
    FROM (SELECT *, coalesce(op_chain, base_chain) AS chain_name FROM (
          SELECT *, list_filter(list_transform(tails, lambda t: {chain_case}), lambda c: c IS NOT NULL)[1] AS base_chain,
                 len(list_filter(toks, lambda t: NOT list_contains({generic}, t))) = 0 AS vague
          FROM (SELECT *, list_transform(range(0, least(lead, len(toks) - 1) + 1), lambda i: array_to_string(toks[i + 1:], ' ')) AS tails
                FROM (SELECT *, array_to_string(toks, ' ') AS base,
                             coalesce(list_position(list_transform(toks, lambda t: list_contains({generic}, t)), false) - 1, len(toks)) AS lead
                      FROM (SELECT *, list_filter(string_split(legal, ' '), lambda t: length(t) > 1 AND NOT list_contains({names(brands.BUSINESS_CODES)}, t)
                                             AND NOT list_contains(string_split({city}, ' '), t)) AS toks
                            FROM (SELECT *, regexp_replace(array_to_string(list_filter(string_split(led, ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+')), ' '),
                                                    {q(brands.LEGAL_FORM_RE)}, ' ', 'g') AS legal
                                  FROM (SELECT *, regexp_matches({name}, {q(brands.VENDING_RE)}) AS vending, {operator} AS op_chain,
                                               regexp_replace(regexp_replace(regexp_replace({name}, '([A-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Z])', '\\1 \\2', 'g') || ' ',
                                                              '^ *(?:(?:{prefixes}) +)+', '') AS led
                                        FROM {source})))))))
    """


COMP_SUMS = ("spend", "txns", "cards", "local_spend", "foreign_spend", "premium_spend", "business_spend",
             "weekend_spend", "dinner_spend", "h1_2025", "h1_2026")
KINDS = ("local", "foreign", "premium", "business", "weekend", "dinner")
MEDIAN_FEATURES = ("avg_ticket", "foreign_share", "local_share", "leak_outside_share", "lodging_spend", "grocery_spend",
                   "premium_share", "business_share", "spend_trend", "dinner_share", "weekend_share",
                   "catchment_cards", "catchment_spend", "txns_per_card")

_PURCHASE = "mrch_ctry_cd = 616 AND transaction_type <> 'ATM'"
_E, _N = tm_forward("latitude", "longitude")
_NOW = between(P.target_year)

CTES: dict[str, str] = {
    "card": views.for_duckdb(views.CARD_TX),
    "geo": views.for_duckdb(views.GEONAMES),
    "sales": views.for_duckdb(views.SALES),
    "tx": f"""SELECT pymt_crd_acct_num_raw AS card, prch_mnth_id AS month, mrch_catg_cd AS mcc, cp_flag AS cp,
                     {no_tills(norm('mrch_nm_raw'))} AS nm1, {norm('mrch_city_nm_raw')} AS city,
                     {pc5('mrch_postal_code')} AS pc5, cs_tran_amt AS amt
              FROM card WHERE {_PURCHASE} AND mrch_catg_cd IN (5811, 5812, 5813, 5814)""",
    "hubs": f"""SELECT pc5, month, count(DISTINCT nm1) AS n_names FROM tx WHERE cp = 1 AND pc5 IS NOT NULL
                GROUP BY pc5, month HAVING count(DISTINCT nm1) >= {P.hub_min_names}""",
    "centroids": """SELECT *, voiv || '|' || powiat AS powiat_key FROM (
                      SELECT replace(postal_code, '-', '') AS pc5, avg(latitude) AS lat, avg(longitude) AS lon,
                             arg_min(place_name, row_no) AS place, arg_min(admin_name2, row_no) AS powiat,
                             arg_min(admin_code2, row_no) AS powiat_code, arg_min(admin_name1, row_no) AS voiv, count(*) AS n_places
                      FROM geo GROUP BY 1)""",
    "city_county": f"""SELECT {norm('place_name')} AS city_norm, min(admin_name1 || '|' || admin_name2) AS powiat_key FROM geo
                       GROUP BY 1 HAVING count(DISTINCT admin_name1 || '|' || admin_name2) = 1""",
    "flagged": """SELECT t.*, EXISTS (SELECT 1 FROM hubs h WHERE h.pc5 = t.pc5 AND h.month = t.month) AS hub
                  FROM tx t WHERE t.cp = 1""",
    "located_tx": """SELECT f.*, coalesce(g.powiat_key, c.powiat_key, 'C:' || f.city) AS place, g.pc5 IS NOT NULL AS pc_known
                     FROM flagged f LEFT JOIN centroids g ON g.pc5 = f.pc5 LEFT JOIN city_county c ON c.city_norm = f.city""",
    "placed": f"""SELECT *, CASE WHEN regexp_matches(nm1, {q(TRAILING_NUMBER_RE)}) THEN trim(regexp_extract(nm1, {q(TRAILING_NUMBER_RE)}, 1)) ELSE nm1 END AS base,
                         regexp_extract(nm1, {q(TRAILING_NUMBER_RE)}, 2) AS num
                  FROM located_tx""",
    "cooc": """SELECT base, place, pc5, month, list_sort(list(DISTINCT num)) AS nums FROM placed
               WHERE NOT hub AND pc5 IS NOT NULL GROUP BY base, place, pc5, month HAVING count(DISTINCT num) > 1""",
    "links": """SELECT DISTINCT a.base, a.place, a.n AS n1, b.n AS n2
                FROM (SELECT base, place, pc5, month, unnest(nums) AS n FROM cooc) a
                JOIN (SELECT base, place, pc5, month, unnest(nums) AS n FROM cooc) b
                  ON a.base = b.base AND a.place = b.place AND a.pc5 = b.pc5 AND a.month = b.month""",
    "reach": """SELECT DISTINCT base, place, n1 AS num, n1 AS r FROM links
                UNION SELECT k.base, k.place, k.num, l.n2 FROM reach k JOIN links l ON l.base = k.base AND l.place = k.place AND l.n1 = k.r""",
    "comps": "SELECT base, place, num, min(r) AS rep FROM reach GROUP BY base, place, num",
    "stored": """SELECT p.*, CASE WHEN coalesce(c.rep, p.num) = '' THEN p.base ELSE p.base || ' ' || coalesce(c.rep, p.num) END AS store_nm
                 FROM placed p LEFT JOIN comps c ON c.base = p.base AND c.place = p.place AND c.num = p.num""",
    "outlets": """SELECT store_nm, place FROM (SELECT store_nm, place, month, count(DISTINCT pc5) AS pcs FROM stored
                    WHERE NOT hub AND pc5 IS NOT NULL GROUP BY store_nm, place, month)
                  GROUP BY store_nm, place HAVING sum(CASE WHEN pcs >= 2 THEN 1 ELSE 0 END) >= 3""",
    "rest_cp": """SELECT s.*, s.store_nm || '|' || s.place || CASE WHEN o.store_nm IS NULL THEN '' WHEN s.hub OR s.pc5 IS NULL THEN '|HUB'
                         ELSE '|' || s.pc5 END AS merchant
                  FROM stored s LEFT JOIN outlets o ON o.store_nm = s.store_nm AND o.place = s.place""",
    "non_hub": "SELECT * FROM rest_cp WHERE NOT hub AND pc_known AND right(merchant, 4) <> '|HUB'",
    "location": """SELECT merchant, pc5 AS loc_pc5, first_month AS loc_month FROM (
                     SELECT merchant, month, pc5, min(month) OVER (PARTITION BY merchant) AS first_month,
                            row_number() OVER (PARTITION BY merchant ORDER BY month, count(*) DESC, pc5) AS rn
                     FROM non_hub GROUP BY merchant, month, pc5) WHERE rn = 1""",
    "top_mcc": """SELECT merchant, mcc FROM (SELECT merchant, mcc, row_number() OVER (PARTITION BY merchant ORDER BY sum(amt) DESC, count(*) DESC, mcc) AS rn
                    FROM rest_cp GROUP BY merchant, mcc) WHERE rn = 1""",
    "attrs": """SELECT a.*, c.city FROM (
                  SELECT merchant, min(store_nm) AS store_nm, min(place) AS place, min(month) AS first_month_ever,
                         sum(amt) AS spend_all, count(DISTINCT pc5) AS booked_postcodes FROM rest_cp GROUP BY merchant) a
                JOIN (SELECT merchant, city, row_number() OVER (PARTITION BY merchant ORDER BY count(*) DESC, city) AS rn
                      FROM rest_cp GROUP BY merchant, city) c ON c.merchant = a.merchant AND c.rn = 1""",
    "mjoin": f"""SELECT a.merchant, a.store_nm, a.place, a.city, a.first_month_ever, a.spend_all, a.booked_postcodes, t.mcc, l.loc_pc5,
                        g.lat, g.lon, g.place AS loc_place, g.powiat AS loc_powiat,
                        trim(a.city || ' ' || {norm('g.place')}) AS city_text
                 FROM attrs a JOIN top_mcc t ON t.merchant = a.merchant LEFT JOIN location l ON l.merchant = a.merchant
                 LEFT JOIN centroids g ON g.pc5 = l.loc_pc5""",
    "brand_rows": brand_steps("mjoin", "store_nm", "city_text", "merchant"),
    "branded": f"""SELECT * EXCLUDE (tails, toks, legal, led, op_chain, base_chain, lead), coalesce(brand LIKE '#%', false) AS generic_name,
                          coalesce(list_contains({names(brands.CHAINS)}, brand), false) AS chain FROM brand_rows""",
    "addresses": f"""SELECT brand, loc_pc5 FROM branded WHERE NOT vending AND NOT generic_name AND loc_pc5 IS NOT NULL
                     GROUP BY brand, loc_pc5 HAVING count(*) >= {P.min_registrations}""",
    "merchants": """SELECT b.*, a.brand IS NOT NULL AS registration,
                           b.loc_pc5 IS NOT NULL AND a.brand IS NULL AND NOT b.vending AS located
                    FROM branded b LEFT JOIN addresses a ON a.brand = b.brand AND a.loc_pc5 = b.loc_pc5""",
    "m_tx": """SELECT r.merchant, d.loc_pc5 AS pc5, d.brand, r.mcc, r.card, r.month, r.amt
               FROM rest_cp r JOIN merchants d ON d.merchant = r.merchant WHERE d.located AND r.mcc IN (5812, 5814)""",
    "train_year_tx": f"SELECT * FROM m_tx WHERE {between(P.train_year)}",
    "train_mcc": """SELECT merchant, mcc FROM (SELECT merchant, mcc, row_number() OVER (PARTITION BY merchant ORDER BY sum(amt) DESC, count(*) DESC, mcc) AS rn
                      FROM train_year_tx GROUP BY merchant, mcc) WHERE rn = 1""",
    "train_base": f"""SELECT a.*, t.mcc, g.lat, g.lon, g.place, g.powiat, g.powiat_key FROM (
                        SELECT merchant, min(brand) AS brand, min(pc5) AS pc5, sum(amt) AS revenue, count(DISTINCT card) AS cards,
                               count(DISTINCT month) AS months_active FROM train_year_tx GROUP BY merchant) a
                      JOIN train_mcc t ON t.merchant = a.merchant JOIN centroids g ON g.pc5 = a.pc5 WHERE a.cards >= {P.min_cards}""",
    "training": f"""SELECT b.*, n.shops_in_mcc FROM train_base b JOIN (SELECT mcc, count(*) AS shops_in_mcc FROM train_base GROUP BY mcc
                      HAVING count(*) >= {P.min_shops_per_mcc}) n ON n.mcc = b.mcc""",
    "key_store": """SELECT nm1, city, pc5, month, min(merchant) AS merchant, bool_or(hub) AS hub FROM rest_cp
                    WHERE mcc IN (5812, 5814) GROUP BY nm1, city, pc5, month""",
    "raw_tx": f"""SELECT mrch_nm_raw, {no_tills(norm('mrch_nm_raw'))} AS nm1, {norm('mrch_city_nm_raw')} AS city, {pc5('mrch_postal_code')} AS pc5,
                         prch_mnth_id AS month, mrch_catg_cd AS mcc, pymt_crd_acct_num_raw AS card, cs_tran_amt AS amt
                  FROM card WHERE {_PURCHASE} AND cp_flag = 1 AND mrch_catg_cd IN (5812, 5814)""",
    "raw_st": """SELECT r.*, k.merchant, k.hub FROM raw_tx r JOIN key_store k ON k.nm1 = r.nm1 AND k.month = r.month
                 AND k.city IS NOT DISTINCT FROM r.city AND k.pc5 IS NOT DISTINCT FROM r.pc5""",
    "till_main": f"""SELECT mrch_nm_raw, merchant, mcc FROM (SELECT mrch_nm_raw, merchant, mcc,
                         row_number() OVER (PARTITION BY mrch_nm_raw, merchant ORDER BY amt DESC, mcc) AS rn
                       FROM raw_st WHERE {between(P.train_year)}) WHERE rn = 1""",
    "till_rev": f"""SELECT r.mrch_nm_raw, r.merchant, r.revenue_2025, r.revenue_h2_2025, r.revenue_h1_2026, r.cards_2025, r.months_active_2025,
                           m.mcc AS mrch_catg_cd, r.months_active_2025 = 12 AS full_year_2025
                    FROM (SELECT mrch_nm_raw, merchant, sum(CASE WHEN {between(P.train_year)} THEN amt END) AS revenue_2025,
                                 sum(CASE WHEN {between(P.half_first)} THEN amt END) AS revenue_h2_2025,
                                 sum(CASE WHEN {between(P.half_second)} THEN amt END) AS revenue_h1_2026,
                                 count(DISTINCT CASE WHEN {between(P.train_year)} THEN card END) AS cards_2025,
                                 count(DISTINCT CASE WHEN {between(P.train_year)} THEN month END) AS months_active_2025
                          FROM raw_st GROUP BY mrch_nm_raw, merchant) r
                    LEFT JOIN till_main m ON m.merchant = r.merchant AND m.mrch_nm_raw = r.mrch_nm_raw""",
    "tills": """SELECT r.mrch_nm_raw, r.merchant AS store, t.brand, t.pc5, t.powiat AS district, r.mrch_catg_cd, r.revenue_h2_2025,
                       r.revenue_h1_2026, r.cards_2025, r.months_active_2025, r.full_year_2025,
                       coalesce(r.revenue_h2_2025, 0) + coalesce(r.revenue_h1_2026, 0) AS year_revenue
                FROM till_rev r JOIN training t ON t.merchant = r.merchant WHERE r.revenue_2025 > 0""",
    "first_tills": "SELECT store, " + ", ".join(
        f"first({c} ORDER BY year_revenue DESC, mrch_nm_raw) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in ("mrch_nm_raw", "brand", "pc5", "district", "mrch_catg_cd", "revenue_h2_2025", "revenue_h1_2026",
                  "cards_2025", "months_active_2025", "full_year_2025", "year_revenue")) + " FROM tills GROUP BY store",
    "shop_base": """SELECT f.* EXCLUDE (brand), coalesce(f.brand, f.store) AS brand, s.revenue, s.cards, s.months_active, s.full_year,
                           substr(f.pc5, 1, 2) || '-' || substr(f.pc5, 3) AS postcode
                    FROM first_tills f JOIN (SELECT store, sum(year_revenue) AS revenue, sum(cards_2025) AS cards,
                           max(months_active_2025) AS months_active, bool_or(full_year_2025) AS full_year FROM tills GROUP BY store) s
                      ON s.store = f.store WHERE s.revenue > 0 AND f.pc5 IS NOT NULL""",
    "shops": """SELECT b.*, CASE WHEN n.n = 1 THEN 'small' WHEN n.n < 5 THEN 'medium' ELSE 'big' END AS brand_tier
                FROM shop_base b JOIN (SELECT brand, count(DISTINCT store) AS n FROM shop_base GROUP BY brand) n ON n.brand = b.brand""",
    "split_shops": f"SELECT store, {pc5('postcode')} AS shop_pc, {in_hash('store')} AS split FROM shops",
    "merchant_key": f"""SELECT card, month, pc5, nm1, mcc, min(merchant) AS merchant FROM rest_cp
                        WHERE cp = 1 AND mcc IN (5812, 5814) AND {between(P.card_window)} GROUP BY card, month, pc5, nm1, mcc""",
    "rollup_rows": f"""SELECT pymt_crd_acct_num_raw AS card, prch_mnth_id AS month, mrch_catg_cd AS mcc, {pc5('mrch_postal_code')} AS pc5,
                              {no_tills(norm('mrch_nm_raw'))} AS nm1, cs_tran_amt AS amt, dayofweek(prch_dt) IN (0, 6) AS weekend,
                              (TRY_CAST(substr(lpad(regexp_replace(CAST(tran_id_gmt_tm AS VARCHAR), '[^0-9]', '', 'g'), 6, '0'), 1, 2) AS INT) + 2) % 24 BETWEEN 17 AND 21 AS dinner,
                              {pc5('pstl_cd_enr')} AS home_pc5, TRY_CAST(issr_ctry_cd AS INT) <> 616 AS is_foreign,
                              regexp_matches(upper(coalesce(crd_typ_nm, '')), {q('|'.join(flags.PREMIUM_WORDS))}) AS is_premium,
                              upper(coalesce(prod_id_pltfrm_cd_vcis, '')) IN ('CO', 'BZ', 'GV') AS is_business
                       FROM card WHERE {_PURCHASE} AND cp_flag = 1 AND mrch_catg_cd IN (5812, 5814) AND {between(P.card_window, 'prch_mnth_id')}""",
    "rollup": """SELECT card, month, mcc, pc5, nm1, sum(amt) AS spend, count(*) AS txns, sum(CASE WHEN weekend THEN amt END) AS weekend_spend,
                        sum(CASE WHEN dinner THEN amt END) AS dinner_spend, min(home_pc5) AS home_pc5, bool_or(is_foreign) AS is_foreign,
                        bool_or(is_premium) AS is_premium, bool_or(is_business) AS is_business
                 FROM rollup_rows GROUP BY card, month, mcc, pc5, nm1""",
    "shop_tx": """SELECT s.store, s.shop_pc, s.split, t.month, t.card, t.home_pc5, t.spend, t.txns, t.weekend_spend, t.dinner_spend,
                         t.is_foreign, t.is_premium, t.is_business
                  FROM rollup t JOIN merchant_key k ON k.card = t.card AND k.month = t.month AND k.mcc = t.mcc AND k.nm1 = t.nm1
                   AND k.pc5 IS NOT DISTINCT FROM t.pc5 JOIN split_shops s ON s.store = k.merchant""",
    "composition": f"""SELECT store, min(shop_pc) AS shop_pc, min(split) AS split, sum(spend) FILTER (WHERE {_NOW}) AS spend,
                              sum(txns) FILTER (WHERE {_NOW}) AS txns, count(DISTINCT card) FILTER (WHERE {_NOW}) AS cards,
                              sum(spend) FILTER (WHERE {_NOW} AND home_pc5 IS NOT DISTINCT FROM shop_pc) AS local_spend,
                              sum(spend) FILTER (WHERE {_NOW} AND is_foreign) AS foreign_spend,
                              sum(spend) FILTER (WHERE {_NOW} AND is_premium) AS premium_spend,
                              sum(spend) FILTER (WHERE {_NOW} AND is_business) AS business_spend,
                              sum(weekend_spend) FILTER (WHERE {_NOW}) AS weekend_spend, sum(dinner_spend) FILTER (WHERE {_NOW}) AS dinner_spend,
                              sum(spend) FILTER (WHERE {between(P.trend_before)}) AS h1_2025,
                              sum(spend) FILTER (WHERE {between(P.trend_after)}) AS h1_2026
                       FROM shop_tx GROUP BY store""",
    "residents": f"SELECT * FROM shop_tx WHERE split = 'train' AND {_NOW} AND home_pc5 IS NOT NULL",
    "wallet": "SELECT home_pc5, sum(spend) AS spend, count(DISTINCT card) AS cards FROM residents GROUP BY home_pc5",
    "shop_home": "SELECT store, home_pc5, sum(spend) AS spend FROM residents GROUP BY store, home_pc5",
    "nearby": f"""SELECT a.pc5 AS shop_pc, b.pc5 AS home_pc5 FROM centroids a, centroids b
                  WHERE abs(a.lat - b.lat) <= 0.0462 AND abs(a.lon - b.lon) <= 0.0462 / cos(radians(a.lat))
                    AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 5""",
    "catchment": """SELECT n.shop_pc, sum(w.spend) AS spend, sum(w.cards) AS cards FROM nearby n JOIN wallet w ON w.home_pc5 = n.home_pc5
                    GROUP BY n.shop_pc""",
    "own_part": """SELECT s.store, sum(h.spend) AS own_spend FROM split_shops s JOIN nearby n ON n.shop_pc = s.shop_pc
                   JOIN shop_home h ON h.store = s.store AND h.home_pc5 = n.home_pc5 WHERE s.split = 'train' GROUP BY s.store""",
    "other": f"""SELECT * FROM (SELECT {pc5('mrch_postal_code')} AS pc5, sum(CASE WHEN mrch_catg_cd = 5411 THEN cs_tran_amt END) AS grocery_spend,
                        sum(CASE WHEN mrch_catg_cd IN (7011, 7012) THEN cs_tran_amt END) AS lodging_spend,
                        sum(CASE WHEN mrch_catg_cd IN (5813, 7832, 7922, 7941, 7991, 7996) THEN cs_tran_amt END) AS leisure_spend
                 FROM card WHERE {_PURCHASE} AND cp_flag = 1 AND {between(P.target_year, 'prch_mnth_id')}
                  AND mrch_catg_cd IN (5411, 7011, 7012, 5813, 7832, 7922, 7941, 7991, 7996) GROUP BY 1) WHERE pc5 IS NOT NULL""",
    "area_sums": "SELECT shop_pc, " + ", ".join(f"sum(coalesce({c}, 0)) AS {c}" for c in COMP_SUMS)
                 + " FROM composition WHERE split = 'train' AND shop_pc IS NOT NULL GROUP BY shop_pc",
    "loo": "SELECT c.store, " + ", ".join(
        f"coalesce(z.{c}, 0) - CASE WHEN c.split = 'train' THEN coalesce(c.{c}, 0) ELSE 0 END AS {c}" for c in COMP_SUMS)
           + " FROM composition c LEFT JOIN area_sums z ON z.shop_pc = c.shop_pc",
    "loo_join": """SELECT c.shop_pc, c.split, l.*, coalesce(w.spend, 0) - CASE WHEN c.split = 'train' THEN coalesce(c.local_spend, 0) ELSE 0 END AS resident_spend,
                          z.cards AS catchment_cards,
                          coalesce(z.spend, 0) - CASE WHEN c.split = 'train' THEN coalesce(o.own_spend, 0) ELSE 0 END AS catchment_spend,
                          t.grocery_spend, t.lodging_spend, t.leisure_spend
                   FROM composition c JOIN loo l ON l.store = c.store LEFT JOIN wallet w ON w.home_pc5 = c.shop_pc
                   LEFT JOIN catchment z ON z.shop_pc = c.shop_pc LEFT JOIN own_part o ON o.store = c.store
                   LEFT JOIN other t ON t.pc5 = c.shop_pc""",
    "demand": f"""SELECT store, {share('greatest(CAST(resident_spend AS DOUBLE) - CAST(local_spend AS DOUBLE), 0)', 'resident_spend')} AS leak_outside_share,
                  {', '.join(f"{share(k + '_spend', 'spend')} AS {k}_share" for k in KINDS)},
                  {share('spend', 'txns')} AS avg_ticket, {share('txns', 'cards')} AS txns_per_card, {share('h1_2026', 'h1_2025')} AS spend_trend,
                  CAST(catchment_cards AS DOUBLE) AS catchment_cards, CAST(catchment_spend AS DOUBLE) AS catchment_spend,
                  CAST(grocery_spend AS DOUBLE) AS grocery_spend, CAST(lodging_spend AS DOUBLE) AS lodging_spend FROM loo_join""",
    "shop_demand": "SELECT s.*, d.* EXCLUDE (store) FROM shops s LEFT JOIN demand d ON d.store = s.store",
    "area_med": "SELECT pc5, " + ", ".join(f"median({c}) AS {c}" for c in MEDIAN_FEATURES) + " FROM shop_demand GROUP BY pc5",
    "big_brand": """SELECT pc5, mrch_catg_cd, max(n) AS n FROM (SELECT pc5, mrch_catg_cd, brand, count(*) AS n FROM shops
                    GROUP BY pc5, mrch_catg_cd, brand) GROUP BY pc5, mrch_catg_cd""",
    "full_med": """SELECT pc5, mrch_catg_cd, median(CAST(revenue AS DOUBLE)) AS revenue_full_year FROM shops WHERE full_year
                   GROUP BY pc5, mrch_catg_cd""",
    "cell_base": """SELECT pc5, mrch_catg_cd, median(CAST(revenue AS DOUBLE)) AS revenue, count(*) AS n_shops, count(DISTINCT brand) AS n_brands,
                           sum(cards) AS zip_cards, avg(CASE WHEN brand_tier = 'big' THEN 1.0 ELSE 0.0 END) AS share_big,
                           first(district ORDER BY store) AS district, avg(CASE WHEN full_year THEN 1.0 ELSE 0.0 END) AS full_year_share,
                           median(CAST(months_active AS DOUBLE)) AS median_months_active, sum(CASE WHEN full_year THEN 1 ELSE 0 END) AS n_full_year
                    FROM shops GROUP BY pc5, mrch_catg_cd""",
    "cells": f"""SELECT c.*, c.n_shops - b.n AS n_competitor_shops, m.* EXCLUDE (pc5), f.revenue_full_year,
                        CAST(c.zip_cards AS DOUBLE) / c.n_shops AS cards_per_shop,
                        CAST(c.zip_cards AS DOUBLE) / c.n_shops * m.txns_per_card * m.avg_ticket AS spend_per_shop_proxy,
                        {in_hash('c.pc5')} AS split
                 FROM cell_base c JOIN big_brand b ON b.pc5 = c.pc5 AND b.mrch_catg_cd = c.mrch_catg_cd
                 LEFT JOIN area_med m ON m.pc5 = c.pc5
                 LEFT JOIN full_med f ON f.pc5 = c.pc5 AND f.mrch_catg_cd = c.mrch_catg_cd""",
    # --- property sales -----------------------------------------------------
    "priced": """SELECT * FROM (SELECT * REPLACE (TRY_CAST(cenaTransakcjiBrutto AS DOUBLE) AS cenaTransakcjiBrutto,
                        TRY_CAST(powUzytkowaLokalu AS DOUBLE) AS powUzytkowaLokalu),
                        TRY_CAST(cenaTransakcjiBrutto AS DOUBLE) / powUzytkowaLokalu AS cena_m2, geometry_wkt AS geometry FROM sales)
                 WHERE cena_m2 BETWEEN 500 AND 55000""",
    "krakow": """SELECT * FROM geo WHERE lower(place_name) = 'kraków' OR lower(admin_name2) IN ('kraków', 'powiat krakowski')""",
    "all_codes": """SELECT postal_code, arg_min(place_name, row_no) AS place_name, arg_min(admin_name1, row_no) AS admin_name1,
                           arg_min(admin_name2, row_no) AS admin_name2, arg_min(admin_name3, row_no) AS admin_name3,
                           avg(latitude) AS latitude, avg(longitude) AS longitude, count(country_code) AS punktow_w_kodzie
                    FROM geo GROUP BY postal_code""",
    "krakow_codes": """SELECT postal_code, arg_min(place_name, row_no) AS place_name, arg_min(admin_name1, row_no) AS admin_name1,
                              arg_min(admin_name2, row_no) AS admin_name2, arg_min(admin_name3, row_no) AS admin_name3,
                              avg(latitude) AS latitude, avg(longitude) AS longitude, count(country_code) AS punktow_w_kodzie,
                              printf('POINT(%.6f %.6f)', avg(longitude), avg(latitude)) AS point_wkt
                       FROM krakow GROUP BY postal_code""",
    "xy_codes": f"SELECT *, {_E} AS x, {_N} AS y FROM all_codes",
    "xy_krakow": f"SELECT *, {_E} AS x, {_N} AS y FROM krakow_codes",
    "sale_points": f"SELECT *, {wkt_number('geometry_wkt', 1)} AS x, {wkt_number('geometry_wkt', 2)} AS y FROM priced",
    "coded": """SELECT * FROM (SELECT s.*, c.postal_code, row_number() OVER (PARTITION BY s.id ORDER BY (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y), c.postal_code) AS rn
                  FROM sale_points s, xy_codes c) WHERE rn = 1""",
    "price_stats": """SELECT postal_code, round(avg(cena_m2), 2) AS avg_price_m2, round(median(cena_m2), 2) AS median_price_m2
                      FROM coded GROUP BY postal_code""",
    "geo_prices": "SELECT c.*, p.avg_price_m2, p.median_price_m2 FROM all_codes c JOIN price_stats p ON p.postal_code = c.postal_code",
    "zip_rev": """SELECT substr(pc5, 1, 2) || '-' || substr(pc5, 3) AS zip_code, CASE mcc WHEN 5812 THEN 'restaurant' ELSE 'fast food' END AS type,
                         round(CAST(sum(amt) AS DOUBLE) / 1000, 2) AS predicted_revenue
                  FROM tx WHERE mcc IN (5812, 5814) AND pc5 IS NOT NULL GROUP BY pc5, mcc""",
    "candidates": """SELECT g.postal_code, g.latitude, g.longitude, g.avg_price_m2, z.predicted_revenue AS revenue, g.avg_price_m2 * 25.0 / 12.0 AS total_cost
                     FROM geo_prices g JOIN zip_rev z ON replace(z.zip_code, '-', '') = replace(g.postal_code, '-', '') WHERE z.type = 'restaurant'""",
    "part_items": """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS postal_code, p_brand AS type, p_retailprice AS revenue,
                            CAST(p_size AS DOUBLE) * 10 AS total_cost FROM part""",
    "sample_fit": """SELECT id, ln(cenaTransakcjiBrutto) AS y, ln(powUzytkowaLokalu * 900 + id % 1000) AS pred_y, cenaTransakcjiBrutto AS revenue,
                     powUzytkowaLokalu * 900 + id % 1000 AS pred_revenue FROM priced""",
    "fit_cuts": "SELECT quantile_cont(y, 0.8) AS cy, quantile_cont(pred_y, 0.8) AS cp, avg(y) AS my FROM sample_fit",
    "fit_ranks": """SELECT *, abs(revenue - pred_revenue) / revenue AS e,
                           rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
                           rank() OVER (ORDER BY pred_y) + (count(*) OVER (PARTITION BY pred_y) - 1) / 2.0 AS rp FROM sample_fit""",
    "first_sales": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cenaTransakcjiBrutto, powUzytkowaLokalu, ulica, geometry ORDER BY id) AS rn
                      FROM sale_points) WHERE rn = 1""",
    "shapes": "SELECT *, 560000 + n_nationkey % 5 * 2800 AS x0, 240000 + n_nationkey // 5 * 1800 AS y0 FROM nation",
    # --- register ------------------------------------------------------------
    "e_tp": """SELECT 'T' || o_orderkey AS id_transakcji, 'N' || o_orderkey AS id_nieruchomosci FROM orders
               UNION ALL SELECT 'T' || o_orderkey, 'N' || o_orderkey || 'b' FROM orders WHERE o_orderkey % 3 = 0""",
    "e_td": "SELECT 'T' || o_orderkey AS id_transakcji, 'D' || o_orderkey AS id_dokumentu FROM orders WHERE o_orderkey % 7 <> 0",
    "e_pl": """SELECT 'N' || o_orderkey AS id_nieruchomosci, 'L' || o_orderkey AS id_lokalu FROM orders
               UNION ALL SELECT 'N' || o_orderkey || 'b', 'L' || o_orderkey || 'b' FROM orders WHERE o_orderkey % 3 = 0
               UNION ALL SELECT 'N' || o_orderkey || 'b', 'L' || o_orderkey || 'c' FROM orders WHERE o_orderkey % 3 = 0""",
    "e_pb": """SELECT 'N' || o_orderkey AS id_nieruchomosci, 'B' || (o_custkey % 50) AS id_budynku FROM orders""",
    "e_pd": """SELECT 'N' || o_orderkey AS id_nieruchomosci, 'P' || (o_orderkey % 100) AS id_dzialki FROM orders
               UNION ALL SELECT 'N' || o_orderkey, 'P' || (o_orderkey % 90) || 'x' FROM orders WHERE o_orderkey % 2 = 0""",
    "e_la": """SELECT 'L' || o_orderkey AS id_lokalu, 'A' || (o_custkey % 50) AS id_adresu FROM orders WHERE o_orderkey % 11 <> 0""",
    "bridge": """SELECT p.id_transakcji, p.id_nieruchomosci, d.id_dokumentu, l.id_lokalu, a.id_adresu, b.id_budynku
                 FROM e_tp p LEFT JOIN e_td d ON d.id_transakcji = p.id_transakcji JOIN e_pl l ON l.id_nieruchomosci = p.id_nieruchomosci
                 LEFT JOIN e_la a ON a.id_lokalu = l.id_lokalu LEFT JOIN e_pb b ON b.id_nieruchomosci = p.id_nieruchomosci""",
    "merged": """SELECT b.*, t.o_totalprice AS cenaTransakcjiBrutto, '1' AS rodzajTransakcji, 1 + t.o_orderkey % 2 AS rodzajRynku,
                l.pow AS powUzytkowaLokalu, l.wkt AS geometry_wkt, CAST(d.o_orderdate AS DATE) AS dataSporzadzeniaDokumentu,
                CAST(110 + TRY_CAST(substr(b.id_budynku, 2) AS INT) % 3 AS VARCHAR) AS rodzajBudynku,
                'Ulica ' || (TRY_CAST(substr(b.id_adresu, 2) AS INT) % 9) AS ulica, substr(b.id_adresu, 2) AS numerPorzadkowy,
                l.k AS premises_key
         FROM bridge b JOIN orders t ON 'T' || t.o_orderkey = b.id_transakcji
         JOIN (SELECT 'L' || o_orderkey AS id, CAST(12 + o_orderkey % 200 AS VARCHAR) AS pow,
                      'POINT (' || (560000 + o_custkey % 14000) || ' ' || (240000 + o_custkey % 9000) || ')' AS wkt, o_orderkey AS k FROM orders
               UNION ALL SELECT 'L' || o_orderkey || 'b', '50', NULL, NULL FROM orders WHERE o_orderkey % 3 = 0) l ON l.id = b.id_lokalu
         LEFT JOIN orders d ON 'D' || d.o_orderkey = b.id_dokumentu""",
    "merged_sales": """SELECT *, 'nr ' || premises_key AS uwagi, cenaTransakcjiBrutto / powUzytkowaLokalu AS cena_m2, geometry_wkt AS geometry
         FROM (SELECT * REPLACE (CAST(cenaTransakcjiBrutto AS DOUBLE) AS cenaTransakcjiBrutto, CAST(powUzytkowaLokalu AS DOUBLE) AS powUzytkowaLokalu),
                      row_number() OVER (PARTITION BY cenaTransakcjiBrutto, powUzytkowaLokalu, ulica, geometry_wkt
                          ORDER BY id_transakcji NULLS FIRST, id_nieruchomosci NULLS FIRST, id_lokalu NULLS FIRST, id_budynku NULLS FIRST) AS rn
               FROM merged WHERE geometry_wkt IS NOT NULL AND CAST(cenaTransakcjiBrutto AS DOUBLE) / CAST(powUzytkowaLokalu AS DOUBLE) BETWEEN 500 AND 55000) WHERE rn = 1""",
    "register_sales": """SELECT s.cena_m2, s.powUzytkowaLokalu, s.premises_key % 12 - 1 AS nrKondygnacji, 1 + s.premises_key % 5 AS liczbaIzb,
                CASE s.rodzajRynku WHEN 1 THEN 'Pierwotny' ELSE 'Wtórny' END AS rodzajRynku, n.n_name AS dzielnica,
                year(s.dataSporzadzeniaDokumentu) AS rok, sqrt(pow(s.x - 566350, 2) + pow(s.y - 244150, 2)) AS dist_to_center,
                CASE WHEN s.premises_key % 4 = 2 THEN 1 ELSE 0 END AS has_parking, CASE WHEN s.premises_key % 4 = 0 THEN 1 ELSE 0 END AS has_balcony,
                CASE WHEN s.premises_key % 4 = 2 THEN 1 ELSE 0 END AS has_storage, s.x AS X_2180, s.y AS Y_2180
         FROM (SELECT *, CAST(split_part(substr(geometry, 8), ' ', 1) AS DOUBLE) AS x, CAST(rtrim(split_part(substr(geometry, 8), ' ', 2), ')') AS DOUBLE) AS y FROM merged_sales) s
         JOIN shapes n ON s.x > n.x0 AND s.x < n.x0 + 2500 AND s.y > n.y0 AND s.y < n.y0 + 1500
          AND (n.n_nationkey % 2 = 0 OR s.y < n.y0 + 700 OR s.x < n.x0 + 1200)
         WHERE s.premises_key % 4 <> 1 AND s.powUzytkowaLokalu BETWEEN 15 AND 200 AND s.rodzajBudynku = '110'
           AND year(s.dataSporzadzeniaDokumentu) BETWEEN 1995 AND 1997 AND s.premises_key % 12 >= 1""",
    "register_coded": """SELECT r.cena_m2, (SELECT arg_min(c.postal_code, {'d': (r.X_2180 - c.x) * (r.X_2180 - c.x) + (r.Y_2180 - c.y) * (r.Y_2180 - c.y), 'c': c.postal_code})
                         FROM xy_krakow c) AS postal_code FROM register_sales r""",
}
RECURSIVE = {"reach"}


def _uses(sql: str) -> list[str]:
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql)
    words = set(re.findall(r"(?<![.\w])(?<!AS )([a-z_]+)\b", bare))
    return [w for w in words if w in CTES]


def with_ctes(final: str) -> str:
    """The statement with every building block it needs, in dependency order."""
    order: list[str] = []

    def need(name: str, path: tuple[str, ...]) -> None:
        if name in order or name in path:
            return
        for other in sorted(_uses(CTES[name])):
            need(other, (*path, name))
        order.append(name)

    for name in sorted(_uses(final)):
        need(name, ())
    parts = [f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n]})" for n in order]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + final
