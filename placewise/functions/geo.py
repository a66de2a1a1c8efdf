"""Distances, projections and WKT points as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# The GRS80 ellipsoid and the parameters of the two Polish grids
# (central meridian, scale, false easting, false northing).
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
PL_1992 = (19.0, 0.9993, 500_000.0, -5_300_000.0)
PL_2000_ZONE_7 = (21.0, 0.999923, 7_500_000.0, 0.0)
CENTRE_X_2180 = 566_350.0
CENTRE_Y_2180 = 244_150.0

_N = GRS80_F / (2 - GRS80_F)
ECCENTRICITY = math.sqrt(GRS80_F * (2 - GRS80_F))
RECTIFYING = GRS80_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger series to the fourth order in the third flattening.
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2))
    half_lon = F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    inner = half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(inner))


def _series(coefficients, trig, hyper, xi: Column, eta: Column) -> Column:
    total = F.lit(0.0)
    for j, c in enumerate(coefficients, start=1):
        total = total + F.lit(c) * trig(xi * (2 * j)) * hyper(eta * (2 * j))
    return total


def project(df: DataFrame, lat: str, lon: str, grid, east: str, north: str) -> DataFrame:
    """Adds easting and northing of geographic degrees in a transverse Mercator grid.

    Values used more than once are columns of their own, so each is computed
    once per row and the generated code stays small.
    """
    lon0, k0, false_east, false_north = grid
    scale = F.lit(k0 * RECTIFYING)
    t, xi, eta, d_lon = F.col("_t"), F.col("_xi"), F.col("_eta"), F.col("_dl")
    return (
        df.withColumns({"_s": F.sin(F.radians(lat)), "_dl": F.radians(F.col(lon) - F.lit(lon0))})
        .withColumn("_t", F.sinh(F.atanh("_s") - F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * F.col("_s"))))
        .withColumns({"_xi": F.atan2(t, F.cos(d_lon)), "_eta": F.atanh(F.sin(d_lon) / F.sqrt(F.lit(1.0) + t * t))})
        .withColumns(
            {
                east: F.lit(false_east) + scale * (eta + _series(ALPHA, F.cos, F.sinh, xi, eta)),
                north: F.lit(false_north) + scale * (xi + _series(ALPHA, F.sin, F.cosh, xi, eta)),
            }
        )
        .drop("_s", "_dl", "_t", "_xi", "_eta")
    )


def unproject(df: DataFrame, east: str, north: str, grid, lat: str, lon: str) -> DataFrame:
    """Adds latitude and longitude in degrees of a position in a grid."""
    lon0, k0, false_east, false_north = grid
    scale = F.lit(k0 * RECTIFYING)
    xi, eta, chi = F.col("_xi"), F.col("_eta"), F.col("_chi")
    angle = chi
    for j, d in enumerate(DELTA, start=1):
        angle = angle + F.lit(d) * F.sin(chi * (2 * j))
    return (
        df.withColumns(
            {"_xi": (F.col(north) - F.lit(false_north)) / scale, "_eta": (F.col(east) - F.lit(false_east)) / scale}
        )
        .withColumns(
            {
                "_xc": xi - _series(BETA, F.sin, F.cosh, xi, eta),
                "_ec": eta - _series(BETA, F.cos, F.sinh, xi, eta),
            }
        )
        .withColumn("_chi", F.asin(F.sin("_xc") / F.cosh("_ec")))
        .withColumns({lat: F.degrees(angle), lon: F.lit(lon0) + F.degrees(F.atan2(F.sinh("_ec"), F.cos("_xc")))})
        .drop("_xi", "_eta", "_xc", "_ec", "_chi")
    )


def to_epsg2180(df: DataFrame, lat: str = "latitude", lon: str = "longitude", x: str = "x", y: str = "y") -> DataFrame:
    """Adds metres of the national grid."""
    return project(df, lat, lon, PL_1992, x, y)


def reproject_2178_2180(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Replaces metres of the zone-7 grid by metres of the national grid."""
    return project(unproject(df, x, y, PL_2000_ZONE_7, "_lat", "_lon"), "_lat", "_lon", PL_1992, x, y).drop("_lat", "_lon")


def distance_to_centre(x: Column, y: Column, cx: float = CENTRE_X_2180, cy: float = CENTRE_Y_2180) -> Column:
    dx, dy = x - F.lit(cx), y - F.lit(cy)
    return F.sqrt(dx * dx + dy * dy)


def point_wkt(x: Column, y: Column) -> Column:
    return F.format_string("POINT(%.6f %.6f)", x, y)


_NUMBER = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"


def parse_point(wkt: Column) -> tuple[Column, Column]:
    """x and y of a WKT point, NULL when the text is not one."""
    pattern = rf"(?i)^\s*POINT\s*(?:Z\s*)?\(\s*{_NUMBER}\s+{_NUMBER}"
    return (
        F.regexp_extract(wkt, pattern, 1).try_cast("double"),
        F.regexp_extract(wkt, pattern, 2).try_cast("double"),
    )
