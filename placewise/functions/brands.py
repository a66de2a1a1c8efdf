"""Brand assignment as column expressions over cleaned merchant names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.text import name_norm, place_norm

# ---------------------------------------------------------------------------
# Word lists, codes and chain patterns.  They decide results, so
# they stand here as plain text.
# ---------------------------------------------------------------------------
FACILITATOR_PREFIXES = "PL POL SUMUP SQ ZETTLE IZ PAYU PAYPRO STRIPE PAYPAL TPAY DOTPAY SRV SP C".split()
BUSINESS_CODES = """
FHU PHU PPHU FPHU FUH FH PW PUH FPUH PPUH ZPHU PHUP PPH PU FU PHP FHUP PPHUP FHG ZPH PTH
""".split()
LEGAL_FORM_RE = (
    r"\b(SPOLKA|SPOL|SP)( (Z|ZO|ZOO|O|OO|J|K|KOM|KA|C|A|OGR|OGRANICZONA|ODPOWIEDZIALNOSCIA|CYWILNA|JAWNA|"
    r"KOMANDYTOWA|AKCYJNA))*\b|\bSPZOO\b|\bS (C|A|J|K)\b"
)
VENDING_RE = (
    r"\b(AUTOMAT[A-Z]*|[A-Z]*VENDING[A-Z]*|DELIKOMAT|DELEKTOMAT[A-Z]*|VEMAT|SELL ?MATIC|KAWOMAT|[A-Z]+OMATY?)\b"
)
GENERIC_WORDS = """
RESTAURACJA RESTAURACJE RESTAURANT RESTAURANTS RESTAURANTE RISTORANTE REST BAR BARY PUB PUBY BISTRO PIZZERIA PIZZERIE
PIZZA PIZZY KEBAB KEBABY KEBAP DONER KAWIARNIA KAWIARENKA KLUBOKAWIARNIA CAFE CAFFE CAFFEE COFFEE KAWA HERBACIARNIA
LODY LODZIARNIA LODZIARNIE GOFRY CUKIERNIA PIEKARNIA NALESNIKARNIA PIEROGARNIA PIEROGI PIWIARNIA PIJALNIA ZAPIEKARNIA
ZAJAZD KARCZMA GOSPODA GOSCINIEC OBERZA TAWERNA TRATTORIA OSTERIA JADLODAJNIA STOLOWKA KANTYNA BUFET SMAZALNIA
ZAPIEKANKI ZAPIEKANKA BURGER BURGERY BURGERS GRILL SUSHI RAMEN PHO KUCHNIA KUCHNIE FOODTRUCK
MALA GASTRONOMIA GASTRONOMICZNA GASTRONOMICZNE GASTRONOMICZNY GASTRO USLUGI USLUGA FIRMA HANDLOWO USLUGOWA
USLUGOWO HANDLOWA HANDLOWE HANDEL PRODUKCYJNO PRZEDSIEBIORSTWO ZAKLAD PUNKT LOKAL LOKALIZACJA CATERING CATERINGOWE
HOTEL HOSTEL MOTEL PENSJONAT KLUB CLUB SALA BANKIETOWA OSRODEK WYPOCZYNKOWY CENTRUM DOM SKLEP SKLEPIK SPOZYWCZY KIOSK
BUDKA FOOD FOODS TRUCK STREET FAST MLECZNY OBIADY DOMOWE DOMOWA DOMOWY POLSKA POLSKIE POLSKI SMAKI SMAK SMAKOW SMAKU
PRZYSMAKI KURCZAK KURCZE PIECZONE PIECZONY RYB RYBY RYBACKA NA POD PRZY DO PO ZA NAD OD LA LE EL IL DA DE DI DEL THE
AND OF AT MR SPOLDZIELNIA SOCJALNA FUNDACJA STOWARZYSZENIE PARAFIA SZKOLNY SZKOLNA STUDENCKA ORIENTALNY ORIENTALNA
CHINSKI CHINSKA WIETNAMSKI WIETNAMSKA WLOSKA TURECKI EXPRESS EKSPRES MINI MAXI SUPER PLUS NOWA NOWY STARA STARY
""".split()
FIRST_NAMES = """
ANNA MARIA KATARZYNA MALGORZATA AGNIESZKA BARBARA EWA KRZYSZTOF ANDRZEJ PIOTR TOMASZ PAWEL MICHAL MAREK JAN JOANNA
MAGDALENA MONIKA BEATA JOLANTA ELZBIETA ALEKSANDRA JUSTYNA DOROTA IWONA GRZEGORZ JAKUB LUKASZ ADAM ROBERT MARCIN
WOJCIECH RAFAL JACEK DARIUSZ ZBIGNIEW KAMIL MATEUSZ BARTOSZ DANUTA HALINA IRENA TERESA ZOFIA KRYSTYNA URSZULA RENATA
SYLWIA EDYTA KAROLINA NATALIA PATRYK DAWID DANIEL MACIEJ MARTA ARTUR DAMIAN MARIUSZ SEBASTIAN SLAWOMIR LESZEK HENRYK
JERZY RYSZARD STANISLAW JOZEF TADEUSZ KAZIMIERZ WLADYSLAW ZDZISLAW JANUSZ MIROSLAW WIESLAW WITOLD BOGDAN ROMAN
PRZEMYSLAW RADOSLAW SZYMON FILIP KACPER KRYSTIAN HUBERT OSKAR BARTLOMIEJ ADRIAN NORBERT KONRAD IGOR EMIL ARKADIUSZ
AGATA PAULINA WERONIKA JULIA ZUZANNA WIKTORIA KINGA ANETA IZABELA KLAUDIA MARZENA GRAZYNA BOZENA ALICJA MILENA EMILIA
OLGA LIDIA DOMINIKA ANGELIKA DIANA LUCYNA WANDA HANNA HELENA JADWIGA STEFANIA GABRIELA MARIOLA ILONA EWELINA MARLENA
ADRIANNA OLIWIA AMELIA NIKOLA LAURA MICHALINA KORNELIA ZANETA PATRYCJA VOLODYMYR OLEKSANDR OLENA TETIANA IRYNA
""".split()
CHAINS = {
    "MCDONALDS": r"^MC ?DONALDS?\b|^MCD\b",
    "KFC": r"^KFC\b",
    "BURGER KING": r"^BURGER KING\b|^BK\b",
    "PIZZA HUT": r"^PIZZA HUT\b|^PH (EXPRESS|GALERIA|DELIVERY|DEL)\b",
    "STARBUCKS": r"^STARBUCKS\b|^SBX\b",
    "COSTA COFFEE": r"^COSTA (COFFEE|CAFFEE|CAFE)\b|^COSTA\b",
    "SUBWAY": r"^SUBWAY\b",
    "DOMINOS PIZZA": r"^DOMINOS\b",
    "TELEPIZZA": r"^TELEPIZZA\b",
    "PAPA JOHNS": r"^PAPA JOHNS?\b",
    "POPEYES": r"^POPEYES\b",
    "MAX BURGERS": r"^MAX (PREMIUM )?BURGERS\b",
    "NORTH FISH": r"^NORTH FISH\b",
    "SALAD STORY": r"^SALAD STORY\b",
    "SPHINX": r"^SPHINX\b",
    "OLIMP": r"^OLIMP\b",
    "DA GRASSO": r"^DA ?GRASSO\b",
    "BAFRA KEBAB": r"^BAFRA\b",
    "ZAHIR KEBAB": r"^ZAHIR KEBAB\b",
    "BERLIN DONER KEBAP": r"^BERLIN DONER\b",
    "AM AM KEBAB": r"^AM AM\b",
    "KEBAB U PAJDY": r"^PAJDY\b|^KEBAB PAJDY\b",
    "TENDUR KEBAP": r"^TENDUR\b",
    "LODOLANDIA": r"^LODOLANDIA\b",
    "KOLACZ NA OKRAGLO": r"^KOLACZ NA OKRAGLO\b",
    "GRYCAN": r"^GRYCAN\b|^LODZIARNIE FIRMOWE\b",
    "GREEN CAFFE NERO": r"^GREEN (CAFFE|COFFEE)( NERO)?\b",
    "SO COFFEE": r"^SO COFFEE\b",
    "CRAZY BUBBLE": r"^CRAZY BUBBLE\b",
    "KOKU SUSHI": r"^KOKU SUSHI\b",
    "NOVA SUSHI": r"^NOVA SUSHI\b",
    "SUSHI KUSHI": r"^SUSHI KUSHI\b",
    "SILVER DRAGON": r"^SILVER DRAGON\b",
    "KURCZAK Z ROZNA": r"^KURCZAK ROZNA\b",
    "1 MINUTE": r"^MINUTE\b",
    "INMEDIO": r"^INMEDIO\b",
    "PIJALNIA WODKI I PIWA": r"^PIJALNIA WODKI PIWA\b",
    "WEDEL PIJALNIA CZEKOLADY": r"^PIJALNIE? CZEKOLADY\b|^WEDEL\b",
    "GRUBY BENEK": r"^GRUBY BENEK\b",
    "PIJANA WISNIA": r"^PIJANA WISNIA\b",
    "MINISTERSTWO SLEDZIA": r"^MINISTERSTWO SLEDZIA\b",
    "FOOD CARGO": r"^FOOD CARGO\b",
    "MAQARON": r"^MAQARON\b",
    "MAKARUN": r"^MAKARUN\b",
    "KARMELLO": r"^KARMELLO\b",
    "DOMINIUM": r"^DOMINIUM\b",
    "TUTTI SANTI": r"^TUTTI SANTI\b",
    "BIKE CAFE": r"^BIKE CAFE\b",
    "THAI WOK": r"^THAI WOK\b",
    "PIZZERIA 105": r"^STOPIATKA\b|^PIZZERIA STOPIATKA\b",
    "PIWIARNIA WARKA": r"^PIWIARNIA WARKA\b",
    "IKEA": r"^IKEA\b",
    "PASIBUS": r"^PASIBUS\b",
    "BOBBY BURGER": r"^BOBBY BURGER\b",
    "BOBOQ": r"^BOBOQ\b",
    "HALLO PIZZA": r"^HALLO PIZZA\b",
    "CYBERMACHINA": r"^CYBERMACHINA\b",
    "KUCHNIA MARCHE": r"^KUCHNI[AE] MARCHE\b|^MARCHE\b",
    "SWIAT PIEROGOW": r"^SWIAT PIEROGOW\b",
    "PIEROGARNIA STARY MLYN": r"^PIEROGARNIA STARY MLYN\b|^STARY MLYN\b",
    "MANEKIN": r"^MANEKIN\b",
    "SODEXO": r"^SODEXO\b",
    "AMREST": r"^AMREST\b",
    "ORLEN": r"^ORLEN\b",
    "AMIC": r"^AMIC\b",
}
OPERATOR_PREFIXES = {"PL KFC": "KFC", "PL PH": "PIZZA HUT", "PL BK": "BURGER KING", "PL SBX": "STARBUCKS"}
# ---------------------------------------------------------------------------

MIN_PREFIX = 5


def generic_vocabulary() -> list[str]:
    """Generic words, first names, and 5+ letter prefixes of the generic words."""
    cut = {word[:size] for word in GENERIC_WORDS for size in range(MIN_PREFIX, len(word) + 1)}
    return sorted(cut | set(GENERIC_WORDS) | set(FIRST_NAMES))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, " +"), lambda t: t != "")


def generic_test(token: Column) -> Column:
    return token.isin(*generic_vocabulary())


def vending_filter(name: Column) -> Column:
    return name.rlike(VENDING_RE)


def clean_base(name: Column, city: Column) -> Column:
    """The part of a name that can tell an owner: no prefixes, numbers, legal forms, codes or city."""
    spaced = F.regexp_replace(name, "([A-Z])([0-9])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([0-9])([A-Z])", "$1 $2")
    led = F.regexp_replace(F.concat(spaced, F.lit(" ")), f"^ *(?:(?:{'|'.join(FACILITATOR_PREFIXES)}) +)+", "")
    words = F.filter(_tokens(led), lambda t: ~t.rlike("^[0-9]+$"))
    legal = F.regexp_replace(F.array_join(words, " "), LEGAL_FORM_RE, " ")
    city_words = F.split(F.coalesce(city, F.lit("")), " +")
    kept = F.filter(
        _tokens(legal),
        lambda t: (F.length(t) > 1) & ~t.isin(*BUSINESS_CODES) & ~F.array_contains(city_words, t),
    )
    return F.array_join(kept, " ")


def operator_prefix(name: Column) -> Column:
    """Chain of an operator code at the head of the raw name, else NULL."""
    found = F.lit(None).cast("string")
    for code, chain in reversed(OPERATOR_PREFIXES.items()):
        found = F.when((name == code) | name.startswith(code + " "), chain).otherwise(found)
    return found


def _chain_of_text(text: Column) -> Column:
    """First chain whose pattern fits.  Most names fit none, which one joint pattern tells."""
    any_chain = "|".join(f"(?:{pattern})" for pattern in CHAINS.values())
    choice = F.when(~text.rlike(any_chain), F.lit(None).cast("string"))
    for chain, pattern in CHAINS.items():
        choice = choice.when(text.rlike(pattern), chain)
    return choice


def chain_match(base: Column) -> Column:
    """First chain of the base, or of what follows its leading generic words."""
    words = _tokens(base)
    n = F.size(words)
    lead = F.aggregate(
        words,
        F.struct(F.lit(0).alias("run"), F.lit(True).alias("open")),
        lambda acc, w: F.struct(
            (acc["run"] + (acc["open"] & generic_test(w)).cast("int")).alias("run"),
            (acc["open"] & generic_test(w)).alias("open"),
        ),
        lambda acc: acc["run"],
    )
    last = F.greatest(F.least(lead, n - 1), F.lit(0))
    tails = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, F.greatest(n, F.lit(1))), " "))
    return F.get(F.filter(F.transform(tails, _chain_of_text), lambda c: c.isNotNull()), 0)


def brand_of(name: Column, city: Column, merchant: Column) -> Column:
    """Brand of one merchant: NULL for vending, a chain, ``#merchant`` or the base."""
    base = clean_base(name, city)
    chain = F.coalesce(operator_prefix(name), chain_match(base))
    vague = F.forall(_tokens(base), generic_test)
    return F.when(~vending_filter(name), F.coalesce(chain, F.when(vague, F.concat(F.lit("#"), merchant)).otherwise(base)))


def assign_brands(merchants: DataFrame) -> DataFrame:
    """Adds brand, vending, generic_name and chain to (store_nm, city, loc_place, merchant) rows.

    One merchant is one row, so the expressions run in place without a shuffle.
    Steps are separate projections so that Spark evaluates each one once.
    """
    city = F.trim(F.concat_ws(" ", F.coalesce("city", F.lit("")), place_norm(F.col("loc_place"))))
    name, base = F.col("store_nm"), F.col("_base")
    brand = F.when(
        ~F.col("vending"),
        F.coalesce("_chain", F.when(F.forall(_tokens(base), generic_test), F.concat(F.lit("#"), "merchant")).otherwise(base)),
    )
    return (
        merchants.withColumn("_base", clean_base(name, city))
        .withColumn("vending", vending_filter(name))
        .withColumn("_chain", F.coalesce(operator_prefix(name), chain_match(base)))
        .withColumn("brand", brand)
        .withColumn("generic_name", F.coalesce(F.col("brand").startswith("#"), F.lit(False)))
        .withColumn("chain", F.coalesce(F.col("brand").isin(*CHAINS), F.lit(False)))
        .drop("_base", "_chain")
    )
