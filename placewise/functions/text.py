"""Text cleaning for merchant names, cities and postcodes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: till, terminal and self-checkout suffixes.
TILL_RE = r"(( (K|KASA|POS|TERM|TERMINAL) ?[0-9]{1,3})|( SCO))+$"
TRAILING_NUMBER_RE = r"^(.*?) ([0-9]{1,2})$"


def _accent_pairs() -> tuple[str, str]:
    """Accented capital -> bare letter, for every letter that decomposes to one.

    Combining marks stand last with no partner, so ``translate`` deletes them.
    """
    accented, bare = ["Ł"], ["L"]
    for code in range(0x00C0, 0xFFFF):
        char = chr(code)
        if unicodedata.category(char) not in ("Lu", "Lt"):
            continue
        parts = unicodedata.normalize("NFD", char)
        if parts[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and all(unicodedata.combining(p) for p in parts[1:]):
            if len(parts) > 1 or parts != char:
                accented.append(char)
                bare.append(parts[0])
    marks = [chr(code) for code in range(0x0300, 0x0370) if unicodedata.combining(chr(code))]
    return "".join(accented + marks), "".join(bare)


ACCENTED, BARE = _accent_pairs()


def digits(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), "[^0-9]", "")


def pc5(col: Column) -> Column:
    """The five digits of a postcode, NULL for anything else."""
    code = col.cast("string")
    found = digits(code)
    # The two usual spellings need no rewriting of the text.
    return (
        F.when(code.rlike("^[0-9]{5}$"), code)
        .when(code.rlike("^[0-9]{2}-[0-9]{3}$"), F.concat(F.substring(code, 1, 2), F.substring(code, 4, 3)))
        .when(F.length(found) == 5, found)
    )


def postcode_dash(col: Column) -> Column:
    return F.concat(F.substring(col, 1, 2), F.lit("-"), F.substring(col, F.lit(3), F.length(col)))


def postcode_key(col: Column) -> Column:
    return F.trim(F.replace(col.cast("string"), F.lit("-"), F.lit("")))


def name_norm(col: Column) -> Column:
    """Upper case, no accents, runs of anything else as one space."""
    name = F.coalesce(col, F.lit(""))
    # A lower-case sharp s has no single capital; it counts as a separator.
    bare = F.translate(F.upper(F.translate(name, "ß", " ")), ACCENTED, BARE)
    # As many bytes as letters: plain ASCII, which most names are, needs no look-up.
    plain = F.when(F.octet_length(name) == F.length(name), F.upper(name)).otherwise(bare)
    return F.trim(F.regexp_replace(plain, "[^A-Z0-9]+", " "))


def _compatible_forms() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition without combining marks makes of capitals and other signs.

    Signs that become one letter or digit, with what they become; signs that
    vanish stand last among them, with no partner; and those that become more.
    """
    single, plain, gone, longer = ["Ł"], ["L"], [], {}
    for code in [*range(0x0080, 0xD800), *range(0xE000, 0x10000)]:
        char = chr(code)
        form = "".join(p for p in unicodedata.normalize("NFKD", char) if not unicodedata.combining(p))
        known = [p for p in form if p in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
        if not form:
            gone.append(char)
        elif known and len(form) == 1:
            single.append(char)
            plain.append(form)
        elif known:
            longer[char] = form
    return "".join(single + gone), "".join(plain), longer


_SINGLE, _PLAIN, _LONGER = _compatible_forms()


def place_norm(col: Column) -> Column:
    """As ``name_norm``, for gazetteer places: full upper case and compatibility forms, so sharp s is SS and a ligature its letters."""
    name = F.upper(F.coalesce(col, F.lit("")))
    table = F.create_map(*[F.lit(x) for pair in _LONGER.items() for x in pair])
    each = F.transform(F.split(name, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    longer = F.when(name.rlike("[" + "".join(_LONGER) + "]"), F.array_join(each, "")).otherwise(name)
    form = F.when(F.octet_length(name) == F.length(name), name).otherwise(F.translate(longer, _SINGLE, _PLAIN))
    return F.trim(F.regexp_replace(form, "[^A-Z0-9]+", " "))


def strip_tills(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, TILL_RE, ""))


def split_trailing_number(col: Column) -> tuple[Column, Column]:
    """``BASE 12`` -> (``BASE``, ``12``); without a number -> (name, ``''``)."""
    number = F.regexp_extract(col, TRAILING_NUMBER_RE, 2)
    base = F.when(number == "", F.trim(col)).otherwise(F.trim(F.regexp_extract(col, TRAILING_NUMBER_RE, 1)))
    return base, F.coalesce(number, F.lit(""))


def store_name(base: Column, number: Column) -> Column:
    return F.when(number == "", base).otherwise(F.concat(base, F.lit(" "), number))


def merchant_id(store: Column, place: Column, multi: Column, hub: Column, code: Column) -> Column:
    """Registry key: one per store and place, per postcode too for multi-outlet stores."""
    suffix = (
        F.when(~multi, F.lit(""))
        .when(hub | code.isNull(), F.lit("|HUB"))
        .otherwise(F.concat(F.lit("|"), code))
    )
    return F.concat(store, F.lit("|"), place, suffix)


def href_id(col: Column) -> Column:
    return F.replace(col, F.lit("#"), F.lit(""))
