"""Farthest pair of points on the sphere, per key: mergeable convex hulls, and the farthest vertex of every vertex in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points fewer than which a batch sends as they are.
FEW = 16
#: Cosine of the reach around a key's centre within which hulls decide: any two points are then less than a quarter turn apart.
REACH = float(np.cos(np.radians(44)))


def hull(px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Positions of the vertices of the convex hull, counter-clockwise; points within rounding of an edge are kept as well."""
    order = np.lexsort((py, px))
    if len(order) <= 3:
        return order
    spare = 1e-13 * max(np.ptp(px), np.ptp(py), 1e-300) ** 2
    x, y = px.tolist(), py.tolist()

    def chain(order: list[int]) -> list[int]:
        out: list[int] = []
        for k in order:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[k] - y[a]) - (y[b] - y[a]) * (x[k] - x[a]) >= -spare:
                    break
                out.pop()
            out.append(k)
        return out

    inner = _inside(px, py, order)
    order = order[~inner[order]].tolist()
    low, high = chain(order)[:-1], chain(order[::-1])[:-1]
    seen = set(low)  # rounding may keep a point on both sides of a tip
    return np.asarray([*low, *(k for k in high if k not in seen)], dtype=np.int64)


def _inside(px: np.ndarray, py: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Points well inside the polygon of the extremes in sixteen directions; no vertex is."""
    turn = np.arange(16) * np.pi / 8
    ends = np.asarray([int((px * np.cos(t) + py * np.sin(t)).argmax()) for t in turn])
    spare = 1e-12 * max(np.ptp(px), np.ptp(py)) ** 2
    inner = np.ones(len(px), dtype=bool)
    for a, b in zip(ends, np.roll(ends, -1)):
        if a != b:
            inner &= (px[b] - px[a]) * (py - py[a]) - (py[b] - py[a]) * (px - px[a]) > spare
    inner[ends] = False
    return inner


def widest(unit: np.ndarray) -> float:
    """Largest squared chord between two of the points, the vertices of a convex polygon in order.

    In a convex quadrilateral the diagonals together are longer than two opposite sides, so going round the polygon the farthest
    vertex never moves back. Rows are halved level by level, each between the answers of its neighbours: all levels together
    look at n log n pairs.
    """
    n = len(unit)
    if n < 2:
        return 0.0

    def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = unit[i] - unit[j % n]
        return np.einsum("ij,ij->i", d, d)

    best = apart(np.zeros(n - 1, dtype=np.int64), np.arange(1, n))
    far = np.zeros(n, dtype=np.int64)
    far[0], widest = 1 + int(best.argmax()), float(best.max())
    step = 1 << max(0, (n - 1).bit_length() - 1)
    while step:
        rows = np.arange(step, n, 2 * step)
        after = rows + step
        low = np.maximum(far[rows - step], rows + 1)
        high = np.minimum(np.where(after < n, far[np.minimum(after, n - 1)], far[0] + n), rows + n - 1)
        # Equal distances may be answered out of order.
        high = np.maximum(low, high)
        size = high - low + 1
        begin = np.cumsum(size) - size
        i, j = np.repeat(rows, size), np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(low, size)
        d = apart(i, j)
        most = np.maximum.reduceat(d, begin)
        first = np.minimum.reduceat(np.where(d == np.repeat(most, size), j, 2 * n), begin)
        far[rows], widest = first, max(widest, float(most.max()))
        step //= 2
    return widest


def metres(square: float, radius: float) -> float:
    """Great-circle distance of a squared chord of the unit sphere."""
    return 2 * radius * float(np.arcsin(min(1.0, np.sqrt(square) / 2)))


COLUMNS = ["ux", "uy", "uz", "px", "py"]


def projected(points: DataFrame, key: str, lon: str, lat: str, keep: bool = False) -> DataFrame:
    """key, unit vector, and place on the plane that touches the sphere at the key's centre, where great circles are straight; null beyond REACH.

    With ``keep`` the columns ``lon`` and ``lat`` as well.
    """
    x, y, kept = F.radians(lon), F.radians(lat), [lon, lat] if keep else []
    unit = points.select(key, *kept, (F.cos(y) * F.cos(x)).alias("ux"), (F.cos(y) * F.sin(x)).alias("uy"), F.sin(y).alias("uz"))
    sums = unit.groupBy(key).agg(*(F.sum(c).alias(f"s{c}") for c in ("ux", "uy", "uz")))
    norm = F.sqrt(sum((F.col(f"s{c}") * F.col(f"s{c}") for c in ("ux", "uy", "uz")), F.lit(0.0)))
    centre = sums.select(F.col(key).alias("__key"), *((F.col(f"s{c}") / F.greatest(norm, F.lit(1e-9))).alias(f"c{c[1]}") for c in ("ux", "uy", "uz")))
    # Two directions across the centre: one level with the equator (any, at a pole), one perpendicular to both.
    level = F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2)
    ax, ay = F.when(level > 1e-6, -F.col("cy") / level).otherwise(1.0), F.when(level > 1e-6, F.col("cx") / level).otherwise(0.0)
    centre = centre.withColumn("ax", ax).withColumn("ay", ay)
    centre = centre.withColumn("bx", -F.col("cz") * F.col("ay")).withColumn("by", F.col("cz") * F.col("ax")).withColumn("bz", F.col("cx") * F.col("ay") - F.col("cy") * F.col("ax"))
    near = F.col("ux") * F.col("cx") + F.col("uy") * F.col("cy") + F.col("uz") * F.col("cz")
    across = F.col("ux") * F.col("ax") + F.col("uy") * F.col("ay")
    up = F.col("ux") * F.col("bx") + F.col("uy") * F.col("by") + F.col("uz") * F.col("bz")
    joined = unit.join(centre, F.col(key).eqNullSafe(F.col("__key")))
    return joined.select(key, *kept, "ux", "uy", "uz", F.when(near > REACH, across / near).alias("px"), F.when(near > REACH, up / near).alias("py"))


def _reduced(points: DataFrame, key: str) -> DataFrame:
    """The hull of each key's points in each batch."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), len(order)]
            px, py = (batch.column(c).to_numpy() for c in ("px", "py"))
            kept = [mine if len(mine) < FEW else mine[hull(px[mine], py[mine])] for a, b in zip(cuts, cuts[1:]) for mine in [order[a:b]]]
            yield batch.take(pa.array(np.concatenate(kept)))

    return points.mapInArrow(reduce, points.schema)


def rims(points: DataFrame, key: str) -> DataFrame:
    """The ``projected`` rows that are on the hull of their key; some inside a large key's, or of a key of few, stay as well."""
    return _reduced(_reduced(points, key).repartition(F.col(key)).sortWithinPartitions(key), key)


def farthest(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, far): the largest distance between two points of each key, of ``projected`` rows that all have a place.

    A task sends the hull of each key's points in a batch; the hulls of one key meet in one task, key by key. Points that
    are at least some distance apart bound what meets there by the length of a hull around half the globe.
    """
    kind = points.schema[key].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def ends() -> tuple:
            rows = np.concatenate(held)
            return now, metres(widest(rows[hull(rows[:, 3], rows[:, 4])][:, :3]), radius)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], schema.field(key).type), pa.array([r[1] for r in rows], pa.float64())], names=[key, "far"])

        schema = None
        for batch in batches:
            schema = batch.schema
            keys = batch.column(key).to_pylist()
            rows = np.stack([batch.column(c).to_numpy() for c in COLUMNS], axis=1)
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and keys[a] != now:
                        done.append(ends())
                        held = []
                    now = keys[a]
                    held.append(rows[a:b])
            if done:
                yield told(done)
        if held:
            yield told([ends()])

    reduced = _reduced(points, key)
    return reduced.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(finish, f"`{key}` {kind}, far double")
