"""Leader clustering of points per key: exact for groups of any size."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstrata.core import stored
from matchstrata.functions import geo
from matchstrata.operators import hull

CELL_DEGREES = 0.0006
METRES_PER_DEGREE = 111_195.0
#: Points of a key that are decided together; the points of a larger one stay apart.
FEW = 256


def _metres(ax, ay, bx, by):
    return geo.great_circle(ax, ay, bx, by, geo.EARTH_M)


def _celled(points: DataFrame) -> DataFrame:
    return points.withColumn("cx", F.floor(F.col("x") / CELL_DEGREES)).withColumn("cy", F.floor(F.col("y") / CELL_DEGREES))


def _reached(cells: DataFrame, radius: float) -> DataFrame:
    """Rows of cells copied to every cell that their radius may reach."""
    deg = radius / METRES_PER_DEGREE
    ry = math.ceil(deg / CELL_DEGREES)
    # Degrees of longitude are shortest at the end of the reach that is nearest to a pole.
    edge = F.least(F.abs(F.col("cy")) + ry + 1, F.lit(89.9 / CELL_DEGREES)) * CELL_DEGREES
    rx = F.ceil(F.lit(deg / CELL_DEGREES) / F.cos(F.radians(edge))).cast("int")
    wide = cells.withColumn("__i", F.explode(F.sequence(-rx, rx))).withColumn("__j", F.explode(F.sequence(F.lit(-ry), F.lit(ry))))
    return wide.withColumn("cx", F.col("cx") + F.col("__i")).withColumn("cy", F.col("cy") + F.col("__j")).drop("__i", "__j")


def _beyond(left: DataFrame, found: DataFrame, key: str, radius: float) -> DataFrame:
    cell = [key, "cx", "cy"]
    cover = _reached(found.select(*cell, F.col("x").alias("lx"), F.col("y").alias("ly")), radius)
    near = [left[c] == cover[c] for c in cell] + [_metres(left["x"], left["y"], cover["lx"], cover["ly"]) <= radius]
    return left.join(cover, reduce(lambda a, b: a & b, near), "left_anti")


def uncovered(points: DataFrame, found: DataFrame, key: str, lon: str, lat: str, radius: float = 100.0) -> DataFrame:
    """Points that lie within ``radius`` of no leader (``found`` by ``leaders``) of their key; those without key or place stay."""
    placed = _celled(points.withColumn("x", F.col(lon)).withColumn("y", F.col(lat)))
    return _beyond(placed, _celled(found), key, radius).select(*points.columns)


def rim(found: DataFrame, key: str) -> DataFrame:
    """(key, x, y) of those leaders of each key that can be farthest from any point: the hull's; all, where hulls don't hold."""
    placed = hull.projected(found, key, "x", "y", keep=True)
    scattered = placed.where("px IS NULL").select(F.col(key).alias("__k")).distinct()
    apart = F.col(key).eqNullSafe(F.col("__k"))
    some = hull.rims(placed.join(scattered, apart, "left_anti"), key).select(key, "x", "y")
    return some.unionByName(placed.join(scattered, apart, "left_semi").select(key, "x", "y"))


def _led(placed: DataFrame, key: str, radius: float) -> DataFrame:
    """The leaders of keys of few points, by one fold over a key's points in order."""
    point = F.struct("ord", "x", "y", "cx", "cy")
    lists = placed.groupBy(key).agg(F.sort_array(F.collect_list(point)).alias("all"))
    none = F.array().cast(lists.schema["all"].dataType)

    def step(led, p):
        def covers(a):
            # Of points equal in order, the first of a cell leads.
            earlier = (a["ord"] < p["ord"]) | ((a["cx"] == p["cx"]) & (a["cy"] == p["cy"]))
            return earlier & (_metres(a["x"], a["y"], p["x"], p["y"]) <= radius)

        return F.when(F.exists(led, covers), led).otherwise(F.concat(led, F.array(p)))

    return lists.select(key, F.explode(F.aggregate("all", none, step)).alias("f")).select(key, "f.ord", "f.x", "f.y")


def leaders(points: DataFrame, key: str, order: str, lon: str, lat: str, radius: float = 100.0, few: int = FEW) -> DataFrame:
    """Leaders of each key (A24): in ``order``, a point within ``radius`` of no earlier leader leads.

    The points of a key of at most ``few`` are gone through in order as one row. Rounds over grid cells, for groups of any size, that never gather a group, decide the others: a cell is smaller than the radius, so it has at
    most one leader, and its first undecided point leads once no neighbouring cell holds an earlier undecided point. How many
    cells the radius spans follows from each cell's own latitude. Points without coordinates are left out.
    """
    if radius < CELL_DEGREES * METRES_PER_DEGREE * math.sqrt(2):
        raise ValueError("radius must cover the diagonal of a cell")
    cell = [key, "cx", "cy"]
    left = points.select(key, F.col(order).alias("ord"), F.col(lon).alias("x"), F.col(lat).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    placed = _celled(left)
    many = stored(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select(F.col(key).alias("__k")))
    large = F.col(key).eqNullSafe(F.col("__k"))
    if many.isEmpty():
        return _led(placed, key, radius)
    found = [_led(placed.join(many, large, "left_anti"), key, radius)]
    left = stored(placed.join(many, large, "left_semi"))
    while True:
        first = left.groupBy(*cell).agg(F.min(F.struct("ord", "x", "y")).alias("f"))
        earliest = _reached(first, radius).groupBy(*cell).agg(F.min("f.ord").alias("e"))
        new = stored(first.join(earliest, cell).filter("f.ord = e").select(*cell, "f.*"))
        found.append(new.select(key, "ord", "x", "y"))
        left = stored(_beyond(left, new, key, radius))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def separation(found: DataFrame, key: str) -> DataFrame:
    """Number of leaders and the largest distance between two of them, per key.

    Decided on the convex hulls of the keys' leaders. Only a key that reaches beyond 44 degrees around its centre, where hulls don't hold,
    has its leaders compared in pairs.
    """
    many = found.groupBy(key).agg(F.count(F.lit(1)).alias("clusters"))
    placed = hull.projected(found, key, "x", "y")
    scattered = placed.where("px IS NULL").select(F.col(key).alias("__k")).distinct()
    apart = F.col(key).eqNullSafe(F.col("__k"))
    far = hull.farthest(placed.join(scattered, apart, "left_anti"), key, geo.EARTH_M).unionByName(_compared(found.join(scattered, apart, "left_semi"), key))
    far = far.withColumnRenamed(key, "__k")
    return many.join(far, apart, "left").select(key, "clusters", F.coalesce("far", F.lit(0.0)).alias("max_separation_m"))


def _compared(found: DataFrame, key: str, cell: float = 2.0) -> DataFrame:
    """(key, far) from the points of those pairs of cells that may hold the longest distance, for keys spread over the globe."""
    half = _metres(F.lit(0.0), F.lit(0.0), F.lit(cell / 2), F.lit(cell / 2))  # no cell's corner is farther from its middle
    placed = found.select(F.col(key).alias("k"), "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    cells = placed.select("k", "cx", "cy").distinct()
    other = cells.select(F.col("k").alias("k2"), F.col("cx").alias("dx"), F.col("cy").alias("dy"))
    pairs = cells.join(other, F.col("k").eqNullSafe(F.col("k2")) & (F.struct("cx", "cy") <= F.struct("dx", "dy")))
    middle = [(F.col(c) + 0.5) * cell for c in ("cx", "cy", "dx", "dy")]
    pairs = pairs.withColumn("apart", _metres(*middle))
    known = pairs.groupBy("k").agg(F.max("apart").alias("known")).withColumnRenamed("k", "k3")
    # The cells that are farthest apart hold points at least their middles' distance less both halves apart.
    pairs = pairs.join(known, F.col("k").eqNullSafe(F.col("k3"))).where(F.col("apart") + 2 * half >= F.col("known") - 2 * half).select("k", "cx", "cy", "dx", "dy")
    right = placed.select(F.col("k").alias("k2"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cx").alias("ex"), F.col("cy").alias("ey"))
    left = placed.select(F.col("k").alias("k4"), "x", "y", F.col("cx").alias("fx"), F.col("cy").alias("fy"))
    met = pairs.join(left, F.col("k").eqNullSafe(F.col("k4")) & (F.col("cx") == F.col("fx")) & (F.col("cy") == F.col("fy")))
    met = met.join(right, F.col("k").eqNullSafe(F.col("k2")) & (F.col("dx") == F.col("ex")) & (F.col("dy") == F.col("ey")))
    return met.groupBy(F.col("k").alias(key)).agg(F.max(_metres(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))).alias("far"))
