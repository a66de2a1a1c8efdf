from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from placewise.functions import brands

# Worked examples (name, city, brand); "#" marks a merchant that is its own brand.
EXAMPLES = [
    ("MCDONALDS 010 KRAKOW", "KRAKOW", "MCDONALDS"),
    ("PL KFC KRAKOW BONARKA", "KRAKOW", "KFC"),
    ("PL PH WROCLAW ASTRA DEL", "WROCLAW", "PIZZA HUT"),
    ("PL SBX KATOWICE GALERIA", "KATOWICE", "STARBUCKS"),
    ("BK GDANSK AK", "GDANSK", "BURGER KING"),
    ("RESTAURACJA SPHINX GDYNIA", "GDYNIA", "SPHINX"),
    ("PIZZERIA DA GRASSO", "LODZ", "DA GRASSO"),
    ("GRYCAN LODZIARNIE FIRM", "WARSZAWA", "GRYCAN"),
    ("LODZIARNIE FIRMOWE", "WARSZAWA", "GRYCAN"),
    ("BAFRA KEBAB MPK 300", "POZNAN", "BAFRA KEBAB"),
    ("BAFRA KEBAB ST005", "LODZ", "BAFRA KEBAB"),
    ("1 MINUTE 54602", "GDANSK", "1 MINUTE"),
    ("AM AM KEBAB 79239", "LUBLIN", "AM AM KEBAB"),
    ("AM AM KEBAB LUBLIN", "LUBLIN", "AM AM KEBAB"),
    ("KEBAB U PAJDY GLIWICE", "GLIWICE", "KEBAB U PAJDY"),
    ("RESTAURACJA HANOI52790", "OPOLE", "RESTAURACJA HANOI"),
    ("PIZZERIA ROMA 2", "PLOCK", "PIZZERIA ROMA"),
    ("THE KING KEBAB KCYNIA", "KCYNIA", "THE KING KEBAB"),
    ("RESTAURACJA", "KRAKOW", "#m"),
    ("BAR MLECZNY", "WARSZAWA", "#m"),
    ("MALA GASTRONOMIA", "ZORY", "#m"),
    ("USLUGI GASTRONOMICZN 01", "RADOM", "#m"),
    ("FIRMA HANDLOWO USLUG 06", "RADOM", "#m"),
    ("ANNA", "RADOM", "#m"),
    ("ANNA SZOLTYSIK", "RYBNIK", "ANNA SZOLTYSIK"),
    ("FHU KAWIARNIA SLONECZ44103", "OPOLE", "KAWIARNIA SLONECZ"),
    ("GREEN COFFEE SP Z O O", "WARSZAWA", "GREEN CAFFE NERO"),
    ("PICCOLO SP ZO O", "POZNAN", "PICCOLO"),
    ("AUTOMATY AS VENDING", "ZORY", None),
    ("C C DELIKOMAT PL 18676", "LODZ", None),
    ("AUTOMAT SPEC", "LISZKI", None),
]
# Own rows: other prefixes, codes, legal forms, chains behind generic words, empty names.
MORE = [
    ("SUMUP PAYU SMOK WAWELSKI", "KRAKOW", "SMOK WAWELSKI"),
    ("PPHU JANEX", "LODZ", "JANEX"),
    ("JANEX SPOLKA Z OGRANICZONA ODPOWIEDZIALNOSCIA", "LODZ", "JANEX"),
    ("KAWIARNIA COSTA", "LODZ", "COSTA COFFEE"),
    ("BAR RESTAURACJA KEBAB PAJDY", "LODZ", "KEBAB U PAJDY"),
    ("PL KFCX", "LODZ", "KFCX"),
    ("SUBWAYS", "LODZ", "SUBWAYS"),
    ("12 34", "LODZ", "#m"),
    ("", "LODZ", "#m"),
    ("LODZ", "LODZ", "#m"),
    ("KAWOMAT", "LODZ", None),
    ("SMOK 5 SMOK", "LODZ", "SMOK SMOK"),
]


@pytest.fixture(scope="module")
def branded(spark):
    rows = [(name, city, brand) for name, city, brand in EXAMPLES + MORE]
    df = spark.createDataFrame(rows, "store_nm string, city string, want string").withColumns(
        {"loc_place": F.lit(None).cast("string"), "merchant": F.lit("m")}
    )
    return brands.assign_brands(df)


def test_examples(branded):
    wrong = [(r.store_nm, r.brand, r.want) for r in branded.collect() if r.brand != r.want]
    assert wrong == []


def test_column_form_agrees(branded):
    both = branded.withColumn("one", brands.brand_of(F.col("store_nm"), F.col("city"), F.col("merchant")))
    assert both.where(~F.col("one").eqNullSafe(F.col("brand"))).count() == 0


def test_flags(branded):
    rows = {r.store_nm: r for r in branded.collect()}
    assert rows["PIZZERIA DA GRASSO"].chain and not rows["PIZZERIA ROMA 2"].chain
    assert rows["ANNA"].generic_name and not rows["ANNA SZOLTYSIK"].generic_name
    assert rows["KAWOMAT"].vending and rows["KAWOMAT"].brand is None


def test_no_python_in_plan(branded):
    plan = branded._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
