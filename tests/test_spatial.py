from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from placewise.functions import geo
from placewise.operators import spatial


def hav(a, b):
    p = math.radians
    h = math.sin(p(b[0] - a[0]) / 2) ** 2 + math.cos(p(a[0])) * math.cos(p(b[0])) * math.sin(p(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("km", [1.0, 5.0, 20.0])
def test_nearby_equals_all_pairs(spark, km):
    rng = random.Random(1)
    pts = [(f"p{i}", rng.uniform(49.9, 50.2), rng.uniform(19.7, 20.2)) for i in range(120)]
    pts += [("n1", 69.9, 19.0), ("n2", 69.95, 19.05), ("s1", -0.01, 0.01), ("s2", 0.01, -0.01), ("same", *pts[0][1:])]
    got = {(r.shop_pc, r.home_pc5) for r in spatial.nearby_pairs(spark.createDataFrame(pts, "pc5 string, lat double, lon double"), km).collect()}
    box = 0.0462 * km / 5
    want = {
        (a[0], b[0]) for a in pts for b in pts
        if abs(a[1] - b[1]) <= box and abs(a[2] - b[2]) <= box / math.cos(math.radians(a[1])) and hav(a[1:], b[1:]) <= km
    }
    assert got == want
    assert all((p[0], p[0]) in got for p in pts)


def test_nearby_plan_has_no_cross_product(spark):
    df = spark.createDataFrame([("a", 50.0, 20.0)], "pc5 string, lat double, lon double")
    plan = spatial.nearby_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_equals_brute_force(spark):
    rng = random.Random(2)
    codes = [(f"{i:03d}", f"POINT {i}", rng.gauss(560_000, 4000), rng.gauss(240_000, 4000)) for i in range(80)]
    codes += [("900", "twin", codes[0][2], codes[0][3]), ("800", "alone", 900_000.0, 900_000.0)]
    pts = [(i, rng.gauss(560_000, 6000), rng.gauss(240_000, 6000)) for i in range(400)]
    pts += [(1000, 0.0, 0.0), (1001, -3e6, 5e6), (1002, 560_000.0, 240_000.0), (1003, 560_000.0, 240_000.0), (1004, 7e8, -7e8)]
    points = spark.createDataFrame(pts, "id int, x double, y double")
    got = {r.id: r.postal_code for r in spatial.nearest_postcode(
        points, spark.createDataFrame(codes, "postal_code string, point_wkt string, x double, y double")).collect()}
    for i, x, y in pts:
        assert got[i] == min(codes, key=lambda c: ((x - c[2]) ** 2 + (y - c[3]) ** 2, c[0]))[0], i


def test_nearest_keeps_points_without_place(spark):
    points = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 2.0)], "id int, x double, y double")
    codes = spark.createDataFrame([("a", "w", 0.0, 0.0)], "postal_code string, point_wkt string, x double, y double")
    got = {r.id: r.postal_code for r in spatial.nearest_postcode(points, codes).collect()}
    assert got == {1: None, 2: "a"}


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_district_square_and_l_shape(spark):
    polygons = spark.createDataFrame(
        [("square", ring((0, 0), (4000, 0), (4000, 4000), (0, 4000))),
         ("ell", ring((5000, 0), (9000, 0), (9000, 1000), (6000, 1000), (6000, 4000), (5000, 4000))),
         ("over", ring((3000, 3000), (5000, 3000), (5000, 5000), (3000, 5000)))],
        "name string, ring array<struct<x:double,y:double>>",
    )
    points = [(1, 10.0, 10.0), (2, 0.0, 10.0), (3, 4000.0, 4000.0), (4, 3500.0, 3500.0), (5, 5500.0, 3000.0), (6, 7000.0, 2000.0),
              (7, 8000.0, 500.0), (8, 6000.0, 2000.0), (9, -50.0, 9.0), (10, None, 1.0), (11, 5500.0, 1000.0)]
    got = sorted((r.id, r.dzielnica or "") for r in spatial.district_join(
        spark.createDataFrame(points, "id int, x double, y double"), polygons).collect())
    assert got == [(1, "square"), (2, ""), (3, "over"), (4, "over"), (4, "square"), (5, "ell"), (6, ""), (7, "ell"), (8, ""), (9, ""),
                   (10, ""), (11, "ell")]


def test_projection_known_point_and_back(spark):
    df = spark.createDataFrame([(50.0614, 19.9366), (52.2297, 21.0122), (54.0, 14.5)], "latitude double, longitude double")
    first = geo.to_epsg2180(df).first()
    assert (round(first.x), round(first.y)) == (567_017, 244_213)
    there = geo.project(df, "latitude", "longitude", geo.PL_2000_ZONE_7, "x", "y")
    for r in geo.unproject(there, "x", "y", geo.PL_2000_ZONE_7, "lat", "lon").collect():
        assert r.lat == pytest.approx(r.latitude, abs=1e-9) and r.lon == pytest.approx(r.longitude, abs=1e-9)
    direct = {(round(r.x, 4), round(r.y, 4)) for r in geo.to_epsg2180(df).collect()}
    moved = {(round(r.x, 4), round(r.y, 4)) for r in geo.reproject_2178_2180(there).collect()}
    assert direct == moved


def test_parse_point(spark):
    rows = [("POINT(1 2)",), ("POINT (1.5 -2e1)",), ("point z (3 4 5)",), ("POLYGON((1 2))",), (None,)]
    df = spark.createDataFrame(rows, "w string")
    x, y = geo.parse_point(F.col("w"))
    assert [(r.x, r.y) for r in df.select(x.alias("x"), y.alias("y")).collect()] == [
        (1.0, 2.0), (1.5, -20.0), (3.0, 4.0), (None, None), (None, None)]


def test_a_far_point_finds_its_code_from_small_cells(spark):
    codes = spark.createDataFrame([("00-001", 0.0, 0.0, "p")], "postal_code string, x double, y double, point_wkt string")
    points = spark.createDataFrame([(1, 5_000_000.0, 3.0), (2, 0.01, 0.0)], "id int, x double, y double")
    found = {r.id: r.postal_code for r in spatial.nearest_postcode(points, codes, cell_m=0.05).collect()}
    assert found == {1: "00-001", 2: "00-001"}


def strictly_inside(x, y, corners):
    inside = False
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return False
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


@pytest.mark.parametrize("band_m", [None, 37.0, 1e6])
def test_districts_of_any_shape_equal_brute_force(spark, band_m):
    rng = random.Random(9)
    star = [(500 + rng.uniform(80, 400) * math.cos(a / 40 * math.tau), 500 + rng.uniform(80, 400) * math.sin(a / 40 * math.tau)) for a in range(40)]
    closed = [(0.0, 0.0), (300.0, 0.0), (300.0, 300.0), (0.0, 300.0), (0.0, 0.0)]
    shapes = {"star": star, "closed": closed, "thin": [(0.0, -2e5), (1.0, -2e5), (1.0, 2e5), (0.0, 2e5)], "twin": closed}
    polygons = spark.createDataFrame([(n, ring(*c)) for n, c in shapes.items()], "name string, ring array<struct<x:double,y:double>>")
    points = [(i, rng.uniform(-20, 1000), rng.uniform(-20, 1000)) for i in range(500)] + [(900 + i, *c) for i, c in enumerate(closed + star)]
    points += [(1000, 150.0, 0.0), (1001, 0.5, 1e5), (1002, 150.0, 150.0), (1003, 150.0, 150.0)]
    found = spatial.district_join(spark.createDataFrame(points, "id int, x double, y double"), polygons, band_m)
    got = sorted((r.id, r.dzielnica) for r in found.collect() if r.dzielnica)
    assert got == sorted((i, n) for i, x, y in points for n, c in shapes.items() if strictly_inside(x, y, c))
    assert "ring" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_ring_of_ten_thousand_corners(spark):
    corners = [(1000 * math.cos(i / 10_000 * math.tau), 1000 * math.sin(i / 10_000 * math.tau)) for i in range(10_000)]
    polygons = spark.createDataFrame([("round", ring(*corners))], "name string, ring array<struct<x:double,y:double>>")
    rng = random.Random(4)
    points = [(i, rng.uniform(-1100, 1100), rng.uniform(-1100, 1100)) for i in range(3000)]
    got = {r.id: r.dzielnica for r in spatial.district_join(spark.createDataFrame(points, "id int, x double, y double"), polygons).collect()}
    for i, x, y in points:
        if abs(math.hypot(x, y) - 1000) > 0.01:
            assert (got[i] == "round") == (math.hypot(x, y) < 1000)


def test_points_far_off_share_few_units(spark):
    """Points 400 km away climb to coarse units: no more unit-code pairs than for points among the codes."""
    rng = random.Random(11)
    codes = [(f"{i:04d}", f"p{i}", rng.gauss(0, 8000), rng.gauss(0, 8000)) for i in range(600)]
    table = spark.createDataFrame(codes, "postal_code string, point_wkt string, x double, y double")
    near = [(i, rng.gauss(0, 8000), rng.gauss(0, 8000)) for i in range(2000)]
    far = [(i, 400_000 + rng.gauss(0, 8000), rng.gauss(0, 8000)) for i in range(2000)]
    sums = []
    for points in (near, far):
        df = spark.createDataFrame(points, "id int, x double, y double")
        got = {r.id: r.postal_code for r in spatial.nearest_postcode(df, table).collect()}
        for i, x, y in points[::37]:
            assert got[i] == min(codes, key=lambda c: ((x - c[2]) ** 2 + (y - c[3]) ** 2, c[0]))[0]
        sums.append(spatial.unit_pairs(df, table).count())
    assert sums[1] <= sums[0]
