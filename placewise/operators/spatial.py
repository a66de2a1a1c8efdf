"""Distance, nearest and point-in-polygon joins as equi-joins on grid cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.geo import haversine_km
from placewise.operators.common import hot_keys, skew_join
from placewise.params import CATCHMENT_KM
from placewise.session import checkpointed

# Fixed value: degrees of latitude of the box test for five kilometres.
BOX_DEGREES_5KM = 0.0462
_MARGIN = 1.000001
MAX_CODES_PER_CELL = 256


def nearby_pairs(centroids: DataFrame, km: float = CATCHMENT_KM) -> DataFrame:
    """Ordered pairs of postcodes within ``km``, each code with itself included.

    Rows of latitude are cut into bands, each band into cells as wide as the
    widest box of that band.  The far side is entered in the nine cells around
    it, so one equi-join finds every pair; box and distance tests follow.
    """
    box = BOX_DEGREES_5KM * km / 5.0
    step = F.lit(box * _MARGIN)

    def width(band: Column) -> Column:
        edge = F.greatest(F.abs(band * step), F.abs((band + 1) * step))
        return step / F.cos(F.radians(F.least(edge, F.lit(89.9))))

    a = (
        centroids.select(F.col("pc5").alias("shop_pc"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
        .withColumn("band", F.floor(F.col("a_lat") / step))
        .withColumn("cell", F.floor(F.col("a_lon") / width(F.col("band"))))
    )
    b = (
        centroids.select(F.col("pc5").alias("home_pc5"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
        .withColumn("at", F.floor(F.col("b_lat") / step))
        .withColumn("band", F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1)))
        .withColumn("mid", F.floor(F.col("b_lon") / width(F.col("band"))))
        .withColumn("cell", F.explode(F.sequence(F.col("mid") - 1, F.col("mid") + 1)))
        .drop("at", "mid")
    )
    near = (
        (F.abs(F.col("a_lat") - F.col("b_lat")) <= box)
        & (F.abs(F.col("a_lon") - F.col("b_lon")) <= F.lit(box) / F.cos(F.radians("a_lat")))
        & (haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= km)
    )
    return a.join(b, ["band", "cell"]).where(near).select("shop_pc", "home_pc5")


def grid_size(codes: DataFrame, most: int = MAX_CODES_PER_CELL, start_m: float = 1000.0, halvings: int = 14) -> float:
    """Widest of start_m, start_m / 2, ... whose fullest cell has at most ``most`` places."""
    places = codes.select("x", "y").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(halvings))))
    size = F.lit(start_m) / F.pow(F.lit(2.0), F.col("step"))
    fullest = (
        places.groupBy("step", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
        .agg(F.count("*").alias("n"))
        .groupBy("step")
        .agg(F.max("n").alias("n"))
    )
    fits = fullest.where(F.col("n") <= most).agg(F.min("step")).first()[0]
    return start_m / 2 ** (halvings if fits is None else fits)


def _levels(counts: DataFrame, codes: DataFrame, size: float) -> int:
    """Doublings after which a cell of ``size`` spans all cells of ``counts`` and all codes."""
    places = counts.select(F.col("c0x") * size, F.col("c0y") * size).union(codes.select("x", "y")).toDF("x", "y")
    spans = [F.max(c) - F.min(c) for c in ("x", "y")]
    wide = places.agg(F.greatest(*spans).alias("wide")).first()["wide"]
    return max(1, math.ceil(math.log2(max(wide or 0.0, size) / size)) + 2)


#: Levels that a unit of the search is finer than the level on which its cell met a code.
UNIT_FINER = 2


_UNIT = ["met", "unit", "ux", "uy"]


def _units(points: DataFrame, codes: DataFrame, cell_m: float | None, levels: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, float]:
    """Points with their cells, points per cell, the unit of each cell, the codes each unit considers, and the cell size."""
    targets = checkpointed(
        codes.where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy(F.col("x").alias("tx"), F.col("y").alias("ty"))
        .agg(F.min(F.struct("postal_code", F.col("point_wkt").alias("postal_code_point_wkt"))).alias("code"))
    )
    places = targets.select(F.col("tx").alias("x"), F.col("ty").alias("y"))
    size = float(cell_m or grid_size(places))

    def cell(value: Column, level: Column) -> Column:
        return F.floor(value / (F.lit(size) * F.pow(F.lit(2.0), level)))

    def around(value: str) -> Column:
        mid = cell(F.col(value), F.col("level"))
        return F.explode(F.sequence(mid - 1, mid + 1))

    at = {"c0x": cell(F.col("x"), F.lit(0)), "c0y": cell(F.col("y"), F.lit(0))}
    placed = points.withColumns(at)
    known = placed.where(F.col("c0x").isNotNull() & F.col("c0y").isNotNull())
    counts = checkpointed(known.groupBy("c0x", "c0y").agg(F.count("*").alias("n")))
    levels = levels or _levels(counts, places, size)

    def leveled(lowest: int) -> DataFrame:
        every = targets.withColumn("level", F.explode(F.sequence(F.lit(lowest), F.lit(levels + 2))))
        return every.withColumn("cx", around("tx")).withColumn("cy", around("ty"))

    def up(df: DataFrame, level: Column, x: str, y: str) -> DataFrame:
        shrink = F.pow(F.lit(2.0), level)
        return df.withColumns({x: F.floor(F.col("c0x") / shrink), y: F.floor(F.col("c0y") / shrink)})

    on = ["level", "cx", "cy"]
    occupied = leveled(0).select(*on).distinct()
    climbing = counts.select("c0x", "c0y", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    found = up(climbing, F.col("level"), "cx", "cy").join(occupied, on, "left_semi").groupBy("c0x", "c0y").agg(F.min("level").alias("met"))
    found = found.withColumn("unit", F.greatest(F.col("met") - UNIT_FINER, F.lit(0)))
    found = checkpointed(up(found, F.col("unit"), "ux", "uy"))
    steps = F.pow(F.lit(2.0), F.col("level") - F.col("unit"))
    units = found.select(*_UNIT).distinct().withColumn("level", F.col("met") + 2)
    units = units.withColumns({"cx": F.floor(F.col("ux") / steps), "cy": F.floor(F.col("uy") / steps)})
    pairs = units.join(leveled(2), on).select(*_UNIT, "tx", "ty", "code")
    return placed, counts, found, pairs, size


def unit_pairs(points: DataFrame, codes: DataFrame, cell_m: float | None = None, levels: int | None = None) -> DataFrame:
    """The (unit, code) rows that ``nearest_postcode`` compares."""
    return _units(points, codes, cell_m, levels)[3]


def nearest_postcode(
    points: DataFrame, codes: DataFrame, cell_m: float | None = None, levels: int | None = None
) -> DataFrame:
    """Adds the nearest code (the least code on ties) to points in metres.

    The search is done per unit of a pyramid of grids, each level twice as
    coarse, not per point.  Cells with points climb until one of the nine cells
    around has a code; a code found there is at most 2.83 of that level's cells
    away, so the nine cells two levels up hold the nearest code of every point of
    the cell.  The unit searched for is the cell's ancestor two levels below that
    level: the farther points are off, the coarser their unit and the fewer units
    there are, so far points cost no more than near ones.  A unit keeps the codes
    nearer to one of its corners than the code nearest to its middle: no other
    can win inside it.  Points then meet their unit's few codes in one equi-join.
    ``cell_m`` is chosen by ``grid_size`` unless given, which bounds the codes a
    unit keeps.  Unless given, the levels go up until one cell is as wide as all
    points and codes together.
    """
    placed, counts, found, pairs, size = _units(points, codes, cell_m, levels)

    def d2(x: Column, y: Column, tx: str = "tx", ty: str = "ty") -> Column:
        dx, dy = x - F.col(tx), y - F.col(ty)
        return dx * dx + dy * dy

    wide = F.lit(size) * F.pow(F.lit(2.0), F.col("unit"))
    left, low = F.col("ux") * wide, F.col("uy") * wide
    middle = d2(left + wide / 2, low + wide / 2)
    best = pairs.groupBy(*_UNIT).agg(F.min(F.struct(middle.alias("d"), F.col("tx").alias("bx"), F.col("ty").alias("by"))).alias("b"))
    corners = [(left + wide * i, low + wide * j) for i in (0, 1) for j in (0, 1)]
    slack = F.lit(1.0 + 1e-9)
    can_win = reduce(
        lambda a, b: a | b, [d2(x, y) <= d2(x, y, "bx", "by") * slack + F.lit(1e-6) for x, y in corners]
    )
    near = (
        pairs.join(best.select(*_UNIT, "b.bx", "b.by"), _UNIT)
        .where(can_win)
        .groupBy(*_UNIT)
        .agg(F.collect_list(F.struct("tx", "ty", "code")).alias("near"))
    )
    kept = checkpointed(found.join(near, _UNIT).select("c0x", "c0y", "near"))
    ranked = F.transform(
        "near",
        lambda c: F.struct(
            ((F.col("x") - c["tx"]) * (F.col("x") - c["tx"]) + (F.col("y") - c["ty"]) * (F.col("y") - c["ty"])).alias("d2"),
            c["code"].alias("code"),
        ),
    )
    return (
        skew_join(placed, kept, ["c0x", "c0y"], "left", hot=hot_keys(counts, ["c0x", "c0y"]), table=True)
        .withColumn("_code", F.array_min(ranked)["code"])
        .select(*points.columns, "_code.postal_code", "_code.postal_code_point_wkt")
    )


def _edges(polygons: DataFrame, name: str) -> DataFrame:
    """(_shape, name, x1, y1, x2, y2): the sides of every ring, the last vertex joined with the first; written."""
    n = F.size("ring")
    after = lambda i: F.get("ring", F.when(i + 1 == n, F.lit(0)).otherwise(i + 1))
    sides = F.transform("ring", lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), after(i)["x"].alias("x2"), after(i)["y"].alias("y2")))
    shapes = polygons.select(F.monotonically_increasing_id().alias("_shape"), F.col("name").alias(name), sides.alias("sides"))
    return checkpointed(shapes.select("_shape", name, F.explode("sides").alias("e")).select("_shape", name, "e.*"))


def district_join(points: DataFrame, polygons: DataFrame, band_m: float | None = None, name: str = "dzielnica") -> DataFrame:
    """Left join of points (x, y) to the polygons (name, ring) they lie strictly within; an edge is outside.

    Sides, not rings, are joined: a side is entered in every band of rows it
    crosses, a place meets the sides of its band in an equi-join and counts those
    that the ray to its right crosses; an odd count per (place, polygon) is
    inside.  Bands are as high as a side is on average (or ``band_m``), so sides
    are entered about twice each however they are spread.  Places are distinct:
    points that share one are counted once and get its answer by a join that
    spreads places with many points.
    """
    edges = _edges(polygons, name)
    mean = edges.agg(F.avg(F.abs(F.col("y2") - F.col("y1")))).first()[0] if band_m is None else band_m
    step = F.lit(float(mean or 1.0))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.withColumn("_band", F.explode(F.sequence(F.floor(low / step), F.floor(high / step))))
    counts = checkpointed(points.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count("*").alias("n")))
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    at = x1 + F.try_divide((y - y1) * (x2 - x1), y2 - y1)
    crosses = ((y1 > y) != (y2 > y)) & (x < at)
    turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    on_side = (turn == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(low, high)
    places = counts.select("x", "y", F.floor(y / step).alias("_band"))
    met = skew_join(places, banded, ["_band"], table=True, condition=crosses | on_side)
    inside = (
        met.groupBy("x", "y", "_shape", name)
        .agg(F.count_if(crosses).alias("n"), F.max(on_side).alias("edge"))
        .where((F.col("n") % 2 == 1) & ~F.col("edge"))
        .select("x", "y", name)
    )
    return skew_join(points, checkpointed(inside), ["x", "y"], "left", hot=hot_keys(counts, ["x", "y"]), table=True)
