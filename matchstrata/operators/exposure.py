"""Referent dates, grid assignment, lag histories and exposure assembly."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchstrata.core import stable
from matchstrata.functions import geo
from matchstrata.functions.text import rounded

POLLUTANTS = ["PM25", "PM10", "O3"]
FILL, SCALE = 65535, 0.1
# Exposure windows and the lags they average.
WINDOWS = {
    "lag01": (0, 1),
    "lag0": (0,),
    "lag1": (1,),
    "lag2": (2,),
    "lag3": (3,),
    "lag02": (0, 1, 2),
    "lag03": (0, 1, 2, 3),
    "lag12": (1, 2),
}
EXTRA_WINDOWS = {"lag4": (4,), "lag04": (0, 1, 2, 3, 4)}
MAX_AXIS = 10_000


def referent_dates(onset: Column) -> Column:
    """All dates of the onset's month with its weekday."""
    first = F.trunc(onset, "MM")
    start = F.date_add(first, F.pmod(F.datediff(onset, first), F.lit(7)))
    return F.sequence(start, F.last_day(onset), F.expr("interval 7 days"))


def matched_strata(events: DataFrame, onset: str = "onset", keep: list[str] = ("event_id",)) -> DataFrame:
    """One row per event and referent date with the 0/1 ``case`` flag (J01); no shuffle."""
    rows = events.select(*keep, onset, F.explode(referent_dates(F.col(onset))).alias("date"))
    return rows.withColumn("case", (F.col("date") == F.col(onset)).cast("int")).drop(onset)


def decode(raw: Column, fill: int = FILL, scale: float = SCALE, offset: float = 0.0) -> Column:
    """Packed value to number, fill to null."""
    return F.when(raw != fill, raw * scale + offset)


def crop(cells: DataFrame, box: tuple = (112.5, 114.7, 22.0, 24.8)) -> DataFrame:
    """Bounding-box filter, bounds included (P03); pushed down to the scan."""
    west, east, south, north = box
    return cells.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def _nearest_index(v: Column, axis: list[float]) -> Column:
    points = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(i).alias("i")) for i, a in enumerate(axis)])
    best = F.array_min(F.transform(points, lambda p: F.struct(F.abs(p["a"] - v).alias("d"), p["i"].alias("i"))))
    return best["i"]


def nearest_cell(locations: DataFrame, lat_axis: list[float], lon_axis: list[float], prefix: str = "") -> DataFrame:
    """Nearest raster cell on rectilinear axes, null outside their extent.

    Axes are grid metadata of bounded length; run this on unique locations.
    """
    if max(len(lat_axis), len(lon_axis)) > MAX_AXIS:
        raise ValueError(f"axis longer than {MAX_AXIS}")
    x, y = F.col("longitude"), F.col("latitude")
    inside = x.between(min(lon_axis), max(lon_axis)) & y.between(min(lat_axis), max(lat_axis))
    return locations.select(
        "*",
        F.when(inside, _nearest_index(y, lat_axis)).alias(f"{prefix}lat_idx"),
        F.when(inside, _nearest_index(x, lon_axis)).alias(f"{prefix}lon_idx"),
        inside.cast("int").alias(f"{prefix}in_extent"),
    )


def nearest_grid(locations: DataFrame, grids: DataFrame, grid_id: str) -> DataFrame:
    """Nearest grid point by great-circle distance, lowest id among ties; null for a location without coordinates.

    Locations look for points in widening rings of cells, by equality joins only. A ring begins at the cell of the lattice's box that is
    nearest to the location and never leaves the box, so a location far off costs a look at each cell at most. Points outside
    ``ring`` cells are at least ring x step degrees away along one axis, so a location is settled once its best distance
    is below the least distance of such points; the others widen the ring. Run this on unique locations.
    """
    points = grids.filter("longitude IS NOT NULL AND latitude IS NOT NULL").groupBy(grid_id).agg(
        F.first("longitude").alias("gx"), F.first("latitude").alias("gy")
    )
    # Copies on either side, for locations on the other side of the date line.
    points = points.select(grid_id, "gy", F.explode(F.array(*[F.col("gx") + d for d in (-360.0, 0.0, 360.0)])).alias("gx"))
    box = points.agg(
        F.count(F.lit(1)).alias("n"), F.min("gx").alias("x0"), F.max("gx").alias("x1"),
        F.min("gy").alias("y0"), F.max("gy").alias("y1"),
    ).first()
    none = [F.lit(None).cast(grids.schema[grid_id].dataType).alias(grid_id), F.lit(None).cast("double").alias("weather_distance_km")]
    if not box["n"]:
        return locations.select("*", *none)
    # About a point per cell within one copy of the lattice.
    width = box["x1"] - box["x0"] - 720
    step = max(((width or 1e-6) * ((box["y1"] - box["y0"]) or 1e-6) / (box["n"] / 3)) ** 0.5, 1e-6)
    celled = points.select(
        grid_id, "gx", "gy", F.floor(F.col("gx") / step).alias("cx"), F.floor(F.col("gy") / step).alias("cy")
    )
    celled = stable(celled)
    x, y = F.col("longitude"), F.col("latitude")

    def clamped(v: Column, low: float, high: float) -> Column:
        return F.floor(F.greatest(F.lit(low), F.least(F.lit(high), v)) / step)

    def cells(at: Column, low: float, high: float) -> Column:
        return F.sequence(F.greatest(at - ring, F.lit(math.floor(low / step))), F.least(at + ring, F.lit(math.floor(high / step))))

    known = locations.filter(x.isNotNull() & y.isNotNull()).select("location_id", "longitude", "latitude").distinct()
    left = stable(known.select("*", clamped(x, box["x0"], box["x1"]).alias("ax"), clamped(y, box["y0"], box["y1"]).alias("ay")))
    settled, ring = [], 1
    while not left.isEmpty():
        reach = left.select("*", F.explode(cells(F.col("ax"), box["x0"], box["x1"])).alias("cx"))
        reach = reach.select("*", F.explode(cells(F.col("ay"), box["y0"], box["y1"])).alias("cy"))
        km = geo.great_circle(x, y, F.col("gx"), F.col("gy"))
        best = reach.join(celled, ["cx", "cy"]).groupBy("location_id", "longitude", "latitude").agg(
            F.min(F.struct(km.alias("km"), F.col(grid_id).alias("id"))).alias("b")
        )
        sure = F.asin(F.cos(F.radians(y)) * math.sin(math.radians(min(ring * step, 90.0)))) * geo.EARTH_KM
        judged = stable(left.join(best, ["location_id", "longitude", "latitude"], "left"))
        everything = ring * step > box["x1"] - box["x0"] + box["y1"] - box["y0"] + 2 * step
        ok = F.col("b").isNotNull() & (F.lit(everything) | (F.col("b.km") <= sure))
        settled.append(judged.filter(ok).select("location_id", "longitude", "latitude", "b"))
        left = judged.filter(~F.coalesce(ok, F.lit(False))).drop("b")
        ring *= 2
    if not settled:
        return locations.select("*", *none)
    found = reduce(DataFrame.unionByName, settled)
    return locations.join(found, ["location_id", "longitude", "latitude"], "left").select(
        *locations.columns, F.col("b.id").alias(grid_id), F.col("b.km").alias("weather_distance_km")
    )


def lattice(spark, south: float = 22.25, west: float = 112.5, step: float = 0.25, n: int = 10) -> DataFrame:
    """Regular n x n lattice."""
    i = F.floor(F.col("id") / n)
    j = F.col("id") % n
    lat, lon = F.lit(south) + i * step, F.lit(west) + j * step
    return spark.range(n * n).select(
        F.format_string("ERA5_%.2f_%.2f", lat, lon).alias("weather_grid_id"),
        lat.alias("latitude"),
        lon.alias("longitude"),
    )


def dense_series(values: DataFrame, keys: list[str], date: str, start: str, end: str) -> DataFrame:
    """Every key on every day of the range; days without a value hold null."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    grid = values.select(*keys).distinct().withColumn(date, F.explode(days))
    return grid.join(values, [*keys, date], "left")


def lag_history(series: DataFrame, keys: list[str], date: str, values: list[str], max_lag: int = 7) -> DataFrame:
    """Columns ``{value}_l0..l{max_lag}`` per cell-day of a dense series.

    Built once per cell-day, not per event, so each event date is one equi-join away.
    Row distance is day distance as the series is dense; a cell's rows are bounded by days.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    lags = [F.lag(v, k).over(w).alias(f"{v}_l{k}") for v in values for k in range(max_lag + 1)]
    return series.select(*keys, date, *lags)


def window_mean(value: str, lags: tuple) -> Column:
    """Mean over lags that is null when any part is null."""
    total = F.col(f"{value}_l{lags[0]}")
    for k in lags[1:]:
        total = total + F.col(f"{value}_l{k}")
    return total / len(lags)


def with_windows(rows: DataFrame, values: list[str], windows: dict[str, tuple] = WINDOWS) -> DataFrame:
    """Add ``{value}_{window}`` for each averaging window."""
    return rows.select("*", *[window_mean(v, lags).alias(f"{v}_{w}") for v in values for w, lags in windows.items()])


def attach_exposure(
    strata: DataFrame, assignments: DataFrame, histories: DataFrame, cell: list[str], location: str = "location_id"
) -> DataFrame:
    """Exposure history of each event date through its location's cell."""
    placed = strata.join(assignments.select(location, *cell), location, "left")
    return placed.join(histories, [*cell, "date"], "left")


def rounded_history(rows: DataFrame, values: list[str], max_lag: int = 7) -> DataFrame:
    """Exposure values to 4 decimals, non-finite to null (F32)."""
    names = {f"{v}_l{k}" for v in values for k in range(max_lag + 1)}
    return rows.select(*[rounded(F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])


def missing_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Null count per column, one pass."""
    sums = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns]
    return sums.select(F.inline(F.array(*pairs)))


def complete_strata(rows: DataFrame, needed: list[str], event_id: str = "event_id") -> DataFrame:
    """Drop every stratum with a null in a needed column (P10).

    An event has at most five rows, so the window never sees a large group, and the event-keyed
    shuffle serves later event-level steps.
    """
    ok = F.lit(True)
    for c in needed:
        ok = ok & F.col(c).isNotNull()
    w = Window.partitionBy(event_id)
    return rows.withColumn("__ok", F.min(ok.cast("int")).over(w)).filter("__ok = 1").drop("__ok")


def trim_strata(rows: DataFrame, value: str, low: float, high: float, event_id: str = "event_id", parts: int | None = None) -> DataFrame:
    """Drop every stratum with a date outside [low, high] (P11); by ``parts`` tasks, if given, whose number can grow with the rows."""
    if parts:
        rows = rows.repartition(parts, event_id)
    inside = F.coalesce(F.col(value).between(low, high), F.lit(False))
    w = Window.partitionBy(event_id)
    return rows.withColumn("__ok", F.min(inside.cast("int")).over(w)).filter("__ok = 1").drop("__ok")


def stratum_variation(rows: DataFrame, value: str, event_id: str = "event_id") -> DataFrame:
    """Strata, and strata whose exposure varies."""
    per = rows.groupBy(event_id).agg((F.max(value) > F.min(value)).cast("long").alias("varies"))
    return per.agg(F.count(F.lit(1)).alias("n_events"), F.sum("varies").alias("variable_exposure_events"))


def crop_statistics(cells: DataFrame) -> DataFrame:
    """Valid and missing cells, range, axis sizes per pollutant and day."""
    v = decode(F.col("raw"))
    return cells.groupBy("pollutant", "date").agg(
        F.count_distinct("lat_idx").alias("lat_cells"),
        F.count_distinct("lon_idx").alias("lon_cells"),
        F.count(v).alias("valid_cells"),
        F.count_if(v.isNull()).alias("missing_cells"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )


def axis_steps(cells: DataFrame, axis: str, idx: str) -> DataFrame:
    """Median absolute step of an axis (A26); an axis is bounded metadata."""
    points = cells.groupBy("pollutant", idx).agg(F.min(axis).alias("v"))
    w = Window.partitionBy("pollutant").orderBy(idx)
    steps = points.withColumn("step", F.abs(F.col("v") - F.lag("v").over(w)))
    return steps.groupBy("pollutant").agg(F.median("step").alias(f"{axis}_step"))


def residence_days(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per location and date (A31, J23, U03); values agree within the key."""
    return rows.groupBy("location_id", "date").agg(*[F.max(c).alias(c) for c in columns])
