"""Coordinates: parsing, distances, datum shift."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Study box (west, east, south, north), bounds excluded.
STUDY_BOX = (112.5, 114.7, 22.0, 24.8)
EARTH_KM = 6371.0
EARTH_M = 6371008.8
# Ellipsoid of the GCJ-02 datum shift (public, Krasovsky 1940).
GCJ_AXIS = 6378245.0
GCJ_ECC2 = 0.006693421622965823


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    """Haversine distance in the unit of ``radius``, null if a coordinate is null."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    # Least and greatest skip nulls, so the null must be kept apart.
    return F.when(a.isNotNull(), F.lit(2.0 * radius) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a)))))


def parse_point(c: Column, box: tuple | None = None) -> Column:
    """'lng,lat' text to struct(lon, lat); null when malformed, infinite or outside the box."""
    parts = F.split(c, ",")
    lon, lat = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    # NaN and infinities fail the range test, as NaN sorts above every number.
    ok = (F.size(parts) == 2) & lon.between(-1e300, 1e300) & lat.between(-1e300, 1e300)
    if box:
        ok = ok & in_box(lon, lat, box)
    return F.when(ok, F.struct(lon.alias("lon"), lat.alias("lat")))


def in_box(lon: Column, lat: Column, box: tuple = STUDY_BOX) -> Column:
    west, east, south, north = box
    return (lon > west) & (lon < east) & (lat > south) & (lat < north)


def _gcj_offset(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lon - 105.0, lat - 35.0
    pi = math.pi

    def wave(amplitudes, v):
        total = F.lit(0.0)
        for amp, freq in amplitudes:
            total = total + F.sin(v * (freq * pi)) * amp
        return total * (2.0 / 3.0)

    root = F.sqrt(F.abs(x))
    shared = wave([(20.0, 6.0), (20.0, 2.0)], x)
    dlat = x * 2.0 - 100.0 + y * 3.0 + y * y * 0.2 + x * y * 0.1 + root * 0.2
    dlat = dlat + shared + wave([(20.0, 1.0), (40.0, 1 / 3.0)], y) + wave([(160.0, 1 / 12.0), (320.0, 1 / 30.0)], y)
    dlon = x + 300.0 + y * 2.0 + x * x * 0.1 + x * y * 0.1 + root * 0.1
    dlon = dlon + shared + wave([(20.0, 1.0), (40.0, 1 / 3.0)], x) + wave([(150.0, 1 / 12.0), (300.0, 1 / 30.0)], x)
    rad = F.radians(lat)
    m = F.lit(1.0) - F.pow(F.sin(rad), 2) * GCJ_ECC2
    dlat = dlat * 180.0 / ((F.lit(GCJ_AXIS * (1 - GCJ_ECC2)) / (m * F.sqrt(m))) * pi)
    dlon = dlon * 180.0 / (F.lit(GCJ_AXIS) / F.sqrt(m) * F.cos(rad) * pi)
    return dlon, dlat


def wgs_to_gcj(lon: Column, lat: Column) -> tuple[Column, Column]:
    dlon, dlat = _gcj_offset(lon, lat)
    return lon + dlon, lat + dlat


def datum_shift(df, lon: str, lat: str, out_lon: str = "longitude", out_lat: str = "latitude", rounds: int = 6):
    """Add WGS84 coordinates for GCJ-02 ones and the round-trip error ``shift_error``.

    The inverse is a fixed-point iteration: wgs = gcj - offset(wgs). One ``withColumn`` step
    per round keeps each expression small.
    """
    cur = df.withColumn("__x", F.col(lon)).withColumn("__y", F.col(lat))
    for _ in range(rounds):
        dlon, dlat = _gcj_offset(F.col("__x"), F.col("__y"))
        cur = cur.select(*df.columns, (F.col(lon) - dlon).alias("__x"), (F.col(lat) - dlat).alias("__y"))
    bx, by = wgs_to_gcj(F.col("__x"), F.col("__y"))
    error = F.greatest(F.abs(bx - F.col(lon)), F.abs(by - F.col(lat)))
    return cur.select(
        *[c for c in df.columns if c not in (out_lon, out_lat)],
        F.col("__x").alias(out_lon),
        F.col("__y").alias(out_lat),
        error.alias("shift_error"),
    )
