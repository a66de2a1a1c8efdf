"""The cleaning and distance functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from placewise.functions.geo import EARTH_KM
from placewise.functions.text import ACCENTED, BARE, TILL_RE


def register_functions(spark: SparkSession) -> list[str]:
    """Creates digits, name_norm, strip_tills and hav_km as temporary SQL functions.

    Their bodies are SQL expressions, which Catalyst inlines into the query.
    """
    bodies = {
        "digits(x STRING)": "regexp_replace(coalesce(x, ''), '[^0-9]', '')",
        "name_norm(n STRING)": (
            f"trim(regexp_replace(translate(upper(translate(coalesce(n, ''), 'ß', ' ')), '{ACCENTED}', '{BARE}'), '[^A-Z0-9]+', ' '))"
        ),
        "strip_tills(n STRING)": f"trim(regexp_replace(n, '{TILL_RE}', ''))",
        "hav_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": (
            f"2 * {EARTH_KM}D * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)"
            " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))"
        ),
    }
    for head, body in bodies.items():
        kind = "DOUBLE" if head.startswith("hav") else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in bodies]
