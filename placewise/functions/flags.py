"""Row flags of card transactions and sale notes, and simple ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewise.params import COUNTRY

# Words and codes that mark a card or a sale.
PREMIUM_WORDS = ("GOLD", "PLATIN", "INFINITE", "SIGNATURE", "WORLD", "BLACK")
BUSINESS_CODES = ("CO", "BZ", "GV")
FRACTIONAL_WORDS = ("udział", "udz", "część", "1/2", "1/4", "1/3", "ułamek")
PARKING_WORDS = ("miejsce", "garaż", "parking", "postojow")
BALCONY_WORDS = ("balkon", "loggia", "taras")
STORAGE_WORDS = ("piwnic", "komórk", "pomieszczenie przynależne", "schowek", "pom. przynależne")
GMT_OFFSET_HOURS = 2
DINNER_HOURS = (17, 21)


def is_weekend(date: Column) -> Column:
    return F.dayofweek(date.try_cast("date")).isin(1, 7)


def is_dinner(gmt_time: Column) -> Column:
    """Local hour (GMT + 2, no daylight rule) within the dinner hours."""
    padded = F.lpad(F.regexp_replace(gmt_time.cast("string"), "[^0-9]", ""), 6, "0")
    return _dinner_hour(F.substring(padded, 1, 2).try_cast("int"))


def is_dinner_number(gmt_time: Column) -> Column:
    """The same for whole numbers HHMMSS, which need no text unless out of range."""
    usual = gmt_time.between(0, 999_999)
    return F.when(usual, _dinner_hour(F.floor(gmt_time / 10_000).cast("int"))).otherwise(is_dinner(gmt_time))


def _dinner_hour(gmt_hour: Column) -> Column:
    return ((gmt_hour + GMT_OFFSET_HOURS) % 24).between(*DINNER_HOURS)


def is_foreign(issuer_country: Column, country: int = COUNTRY) -> Column:
    """Issued elsewhere; NULL where the code is not a number."""
    code = issuer_country.cast("string")
    # Plain numbers and texts without a digit are told by pattern: a failing
    # cast costs far more than a match.
    return (
        F.when(code.rlike("^[1-9][0-9]{0,8}$"), code != str(country))
        .when(code.rlike("[0-9]"), code.try_cast("int") != country)
    )


def is_premium(card_type: Column) -> Column:
    return F.upper(F.coalesce(card_type, F.lit(""))).rlike("|".join(PREMIUM_WORDS))


def is_business(product: Column) -> Column:
    return F.upper(F.coalesce(product, F.lit(""))).isin(*BUSINESS_CODES)


def safe_share(part: Column, total: Column) -> Column:
    """part / total where the total is positive, else NULL."""
    return F.when(total > 0, F.try_divide(part, total))


def outside_share(resident: Column, local: Column) -> Column:
    """Share of the residents' spending that leaves their own area."""
    return safe_share(F.greatest(resident - local, F.lit(0.0)), resident)


def has_words(notes: Column, words: tuple[str, ...]) -> Column:
    """1 when the lower-cased notes hold a word; a ``.`` matches any character."""
    return F.lower(F.coalesce(notes, F.lit(""))).rlike("|".join(words)).cast("int")


def amenity_flags(notes: Column) -> dict[str, Column]:
    return {
        "has_parking": has_words(notes, PARKING_WORDS),
        "has_balcony": has_words(notes, BALCONY_WORDS),
        "has_storage": has_words(notes, STORAGE_WORDS),
    }


def price_per_m2(price: Column, area: Column) -> Column:
    return F.try_divide(price.try_cast("double"), area.try_cast("double"))


def doc_year(date: Column) -> Column:
    return F.year(date.try_cast("date"))


def per_shop_features(cards: Column, shops: Column, txns_per_card: Column, ticket: Column) -> dict[str, Column]:
    each = F.try_divide(cards.cast("double"), shops.cast("double"))
    return {"cards_per_shop": each, "spend_per_shop_proxy": each * txns_per_card * ticket}


def location_cost(price_m2: Column, area_m2: Column) -> Column:
    """Monthly share of the price of the floor area asked for."""
    return price_m2 * area_m2 / F.lit(12.0)


def ape(actual: Column, predicted: Column) -> Column:
    return F.try_divide(F.abs(actual - predicted), actual)


def log_target(value: Column, median: Column) -> Column:
    return F.ln(F.try_divide(value, median))


def unlog_target(log_ratio: Column, median: Column) -> Column:
    return F.exp(log_ratio) * median
