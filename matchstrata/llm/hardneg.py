"""Hard-negative mining by angular triangle filtering.

Every vector is stored with its angles to a few reference directions. The angle between two vectors then lies between the largest
difference and the smallest sum of their angles to one direction; its cosine times both norms bounds their inner product from below and
above. Bounds are widened by what doubles and stored single-precision angles may be off, and rounded outward. Only rows whose bounds
overlap what is looked for get their integer score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from matchstrata.core import partitions, stored
from matchstrata.llm.base import query, table
from matchstrata.llm.vectors import as_long, by_length, integers, packed, product, sound, unpacked, weights, wide

POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score between which a negative's score lies.
LEAST, MOST = 50, 95
#: Reference directions of one vector length, and rows they are picked from; they steer the work, not the result.
REFERENCES, POOL = 16, 2048
#: Candidates of a shard, rows of a stored block, anchors of a travelling block, rows under one shared bound; all at most, or about.
ROOM, ROWS, ANCHORS, RUN = 32768, 2048, 512, 256
#: What a difference of two stored angles may be off, apart from the error of the product that the angle came from.
SLACK = 2e-6


def references(rows: list[tuple[int, list[float]]]) -> dict[int, np.ndarray]:
    """Up to REFERENCES directions for each vector length, picked farthest first from the rows (length, vector)."""
    out = {}
    for d in sorted({d for d, _ in rows if d}):
        w = weights(np.asarray([v for n, v in rows if n == d]))
        w = w[~wide(w) & w.any(axis=1)]
        if len(w):
            unit = w / np.sqrt(np.einsum("ij,ij->i", w, w))[:, None]
            chosen, nearest = [0], unit @ unit[0]
            while len(chosen) < min(REFERENCES, len(unit)) and nearest.min() < 1 - 1e-6:
                chosen.append(int(nearest.argmin()))
                nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
            out[d] = unit[chosen]
    return out


class Bounds:
    """Angles and norms of some vectors of one length, and what they say about an inner product with another vector."""

    def __init__(self, angles: np.ndarray, norms: np.ndarray, dim: int):
        self.angles, self.norms = angles, norms
        self.slack = SLACK + 4 * math.sqrt((dim + 8) * 2.0**-52)
        self.runs = np.arange(0, len(norms), RUN)
        if len(norms):
            self.low, self.high = (f.reduceat(angles, self.runs, axis=0) for f in (np.minimum, np.maximum))
            self.most = np.maximum.reduceat(norms, self.runs)

    def _score(self, size: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product for a product of norms and a range of angles, rounded outward."""
        near, far = np.maximum(nearest - self.slack, 0), np.minimum(farthest + self.slack, np.pi)
        spare = 1 + 1e-9 * size
        return np.floor(size * np.cos(far) - spare), np.ceil(size * np.cos(near) + spare)

    def reachable(self, angle: np.ndarray, norm: float, least: float, most: float) -> np.ndarray:
        """Positions of the rows in runs that may hold a score in [least, most]."""
        if not len(self.runs):
            return np.empty(0, dtype=np.int64)
        if not len(angle):
            return np.arange(len(self.norms))
        nearest = np.maximum(np.maximum(angle - self.high, self.low - angle), 0).max(axis=1)
        farthest = np.minimum(self.high + angle, 2 * np.pi - self.low - angle).min(axis=1)
        # A run's norms reach down to nothing as far as its bound goes, so 0 lies inside.
        low, high = self._score(norm * self.most, nearest, np.maximum(farthest, nearest))
        some = np.flatnonzero((np.minimum(low, 0) <= most) & (np.maximum(high, 0) >= least))
        rows = (self.runs[some][:, None] + np.arange(RUN)).reshape(-1)
        return rows[rows < len(self.norms)]

    def of(self, rows: np.ndarray, angle: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each row."""
        size = norm * self.norms[rows]
        if not len(angle):
            return self._score(size, np.zeros(len(rows)), np.full(len(rows), np.pi))
        mine = self.angles[rows]
        nearest = np.abs(mine - angle).max(axis=1)
        both = mine + angle
        return self._score(size, nearest, np.maximum(np.minimum(both, 2 * np.pi - both).min(axis=1), nearest))


class Held:
    """Candidates of one shard, of one length: ids, labels, vectors, angles and norms."""

    def __init__(self, parts: list[dict]):
        self.ids, self.labels, self.raw, angles, norms = (np.concatenate([p[k] for p in parts]) for k in ("ids", "labels", "raw", "angles", "norms"))
        self.wide = bool(parts[0]["wide"][0])
        self.w = None if self.wide else weights(self.raw)
        self.whole = None
        self.bounds = Bounds(angles.astype(np.float64), norms, self.raw.shape[1])

    def exact(self, anchor: list[int], rows: np.ndarray) -> list[int]:
        """Inner products in whole numbers of any size."""
        if self.whole is None:
            self.whole = [integers(r) for r in self.raw]
        return [product(anchor, self.whole[r]) for r in rows.tolist()]


class Anchor:
    """One row that asks, with what its bounds need."""

    def __init__(self, block: dict, k: int):
        self.uid, self.id, self.label, self.norm = int(block["uid"][k]), int(block["ids"][k]), int(block["labels"][k]), float(block["norms"][k])
        self.raw, self.angle = block["raw"][k], block["angles"][k].astype(np.float64)
        self.wide = bool(block["wide"][0])
        self.w = weights(self.raw[None])[0]
        #: Positives, if they are known: their number and score.
        self.windows = [(n, s) for n, s in zip(block["number"][k].tolist(), block["told"][k].tolist()) if n >= 0] if "told" in block else []


def positives(anchor: Anchor, held: Held, k: int) -> list[tuple[int, int, int]]:
    """(0, vec_id, score) of the k best other rows of the anchor's label."""
    mine = np.flatnonzero((held.labels == anchor.label) & (held.ids != anchor.id))
    if anchor.wide or held.wide:
        scores = held.exact(integers(anchor.raw), mine)
        return [(0, i, as_long(s)) for s, i in sorted(zip(scores, held.ids[mine].tolist()), key=lambda x: (-x[0], x[1]))[:k]]
    _, high = held.bounds.of(mine, anchor.angle, anchor.norm)
    order = np.argsort(-high, kind="stable")
    mine, high = mine[order], high[order]
    best_i, best_s, at, step = np.empty(0, dtype=np.int64), np.empty(0), 0, 128
    while at < len(mine) and not (len(best_s) == k and high[at] < best_s[-1]):
        some = mine[at : at + step]
        at, step = at + step, 4 * step
        ids, scores = np.concatenate((best_i, held.ids[some])), np.concatenate((best_s, held.w[some] @ anchor.w))
        first = np.lexsort((ids, -scores))[:k]
        best_i, best_s = ids[first], scores[first]
    return [(0, i, int(s)) for i, s in zip(best_i.tolist(), best_s.tolist())]


def window(score: int, least: int, most: int) -> tuple[int, int]:
    """Scores n with least * score <= 100 * n <= most * score."""
    return -(-least * score // 100), most * score // 100


def negatives(anchor: Anchor, held: Held, k: int, least: int, most: int) -> list[tuple[int, int, int]]:
    """(number of the positive, vec_id, score) of the k best rows of other labels in the window of each of the anchor's positives."""
    ranges = [(n, *window(s, least, most)) for n, s in anchor.windows]
    ranges = [r for r in ranges if r[1] <= r[2]]
    if not ranges:
        return []
    if anchor.wide or held.wide:
        mine = np.flatnonzero(held.labels != anchor.label)
        ranked = sorted(zip(held.exact(integers(anchor.raw), mine), held.ids[mine].tolist()), key=lambda x: (-x[0], x[1]))
        return [(n, i, as_long(s)) for n, a, b in ranges for s, i in [x for x in ranked if a <= x[0] <= b][:k]]
    mine = held.bounds.reachable(anchor.angle, anchor.norm, min(r[1] for r in ranges), max(r[2] for r in ranges))
    mine = mine[held.labels[mine] != anchor.label]
    low, high = held.bounds.of(mine, anchor.angle, anchor.norm)
    near = np.zeros(len(mine), dtype=bool)
    for _, a, b in ranges:
        near |= (low <= b) & (high >= a)
    mine, high = mine[near], high[near]
    order = np.argsort(-high, kind="stable")
    mine, high = mine[order], high[order]
    best = {n: (np.empty(0, dtype=np.int64), np.empty(0)) for n, _, _ in ranges}
    at, step, floor = 0, 512, min(r[1] for r in ranges)
    while at < len(mine) and high[at] >= floor:
        some = mine[at : at + step]
        at, step = at + step, 4 * step
        ids, scores = held.ids[some], held.w[some] @ anchor.w
        floor = math.inf
        for n, a, b in ranges:
            hit = (scores >= a) & (scores <= b)
            i, s = np.concatenate((best[n][0], ids[hit])), np.concatenate((best[n][1], scores[hit]))
            first = np.lexsort((i, -s))[:k]
            best[n] = i[first], s[first]
            floor = min(floor, s[first[-1]] if len(first) == k else a)
    return [(n, i, int(s)) for n, (ids, scores) in best.items() for i, s in zip(ids.tolist(), scores.tolist())]


def _placed(vectors: DataFrame, anchor: Column, room: int) -> tuple[DataFrame, int]:
    """Stored blocks (shard, anchors, block) of candidates, each shard near one reference direction, and of the anchors among them."""
    spark = vectors.sparkSession
    double = vectors.schema["embedding"].dataType.elementType.simpleString() != "float"
    dtype = "<f8" if double else "<f4"
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(POOL).select(F.size("embedding").alias("dim"), "embedding").collect()
    shared = spark.sparkContext.broadcast(references([(r.dim, r.embedding) for r in sample]))  # REFERENCES rows of at most POOL
    n = vectors.count()
    shards = max(1, -(-n // room), min(partitions(spark), n // ROWS))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dim, big, cell, own, norm, data, told = np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), [b""] * n, [b""] * n
            for d, (rows, raw) in by_length(batch.column("embedding"), dtype).items():
                w = weights(raw)
                dim[rows], big[rows] = d, wide(w)
                plain = np.where(big[rows][:, None], 0.0, w)
                size = np.sqrt(np.einsum("ij,ij->i", plain, plain))
                refs = shared.value.get(d, np.empty((0, d)))
                angles = np.arccos(np.clip(plain / np.maximum(size, 1)[:, None] @ refs.T, -1, 1))
                norm[rows] = size
                if len(refs):
                    cell[rows], own[rows] = angles.argmin(axis=1), angles.min(axis=1)
                for r, x, a in zip(rows.tolist(), raw, angles.astype("<f4")):
                    data[r], told[r] = x.tobytes(), a.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("asks"), pa.array(dim), pa.array(big), pa.array(cell), pa.array(own), pa.array(norm), pa.array(data, pa.binary()), pa.array(told, pa.binary())],
                names=["vec_id", "label", "asks", "dim", "big", "cell", "own", "norm", "data", "angles"],
            )

    def block(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        """The rows, all of one length and kind, as one block of candidates, and the anchors among them as another."""
        d = rows.column("dim")[0].as_py()
        n = rows.num_rows
        held = {
            "ids": rows.column("vec_id").to_numpy(), "labels": rows.column("label").to_numpy(), "uid": rows.column("uid").to_numpy(), "norms": rows.column("norm").to_numpy(),
            "raw": np.frombuffer(b"".join(rows.column("data").to_pylist()), dtype).reshape(n, d), "angles": np.frombuffer(b"".join(rows.column("angles").to_pylist()), "<f4").reshape(n, -1 if d in shared.value else 0),
        }
        kind = {"wide": rows.column("big").to_numpy()[:1]}
        yield 0, packed(**held, **kind)
        asks = np.flatnonzero(rows.column("asks").to_numpy())
        for at in range(0, len(asks), ANCHORS):
            yield 1, packed(**{k: v[asks[at : at + ANCHORS]] for k, v in held.items()}, **kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            dim, big = batch.column("dim").to_numpy(), batch.column("big").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((dim[1:] != dim[:-1]) | (big[1:] != big[:-1])) + 1).tolist(), len(dim)]
            for a, b in zip(cuts, cuts[1:]):
                step = max(1, min(ROWS, (1 << 20) // max(1, int(dim[a]) * 8))) if b > a else 1
                for at in range(a, b, step):
                    some = pa.Table.from_batches([batch.slice(at, min(step, b - at))])
                    some = some.append_column("uid", pa.array((shard << 40) + upto + np.arange(some.num_rows)))
                    upto += some.num_rows
                    for kind, data in block(some):
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["shard", "anchors", "block"])

    measured = vectors.withColumn("asks", F.coalesce(anchor, F.lit(False))).mapInArrow(measure, "vec_id long, label long, asks boolean, dim int, big boolean, cell int, own double, norm double, data binary, angles binary")
    near = ["dim", "big", "cell", "own", "vec_id"]
    return stored(measured.repartitionByRange(shards, *near).sortWithinPartitions(*near).mapInArrow(pack, "shard int, anchors int, block binary")), shards


def _answered(placed: DataFrame, asked: DataFrame, shards: int, answer: Callable) -> DataFrame:
    """(uid, number, vec_id, score) of ``answer`` for every anchor of ``asked`` (block) in every shard; a task holds one shard and one block of anchors at a time."""
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("anchors"), "block")
    together = placed.where("anchors = 0").unionByName(every).repartition(shards, "shard").sortWithinPartitions("shard", "anchors")

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, {}, None
        for batch in batches:
            for shard, kind, data in zip(*(batch.column(c) for c in ("shard", "anchors", "block"))):
                shard, block = shard.as_py(), unpacked(data.as_py())
                dim = block["raw"].shape[1]
                if shard != now:
                    now, parts, held = shard, {}, None
                if not kind.as_py():
                    parts.setdefault((dim, bool(block["wide"][0])), []).append(block)
                    continue
                if held is None:  # candidates sort before anchors
                    held, parts = {k: Held(p) for k, p in parts.items()}, {}
                mine = [h for k, h in held.items() if k[0] == dim]
                out = [(a.uid, *row) for k in range(len(block["ids"])) for a in [Anchor(block, k)] for h in mine for row in answer(a, h)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["uid", "number", "vec_id", "score"])

    return together.mapInArrow(serve, "uid long, number long, vec_id long, score long")


def _told(placed: DataFrame, found: DataFrame) -> DataFrame:
    """The blocks of anchors with the numbers and scores of their positives; a block and its anchors' positives meet in one task."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("block"):
                data = data.as_py()
                uid = unpacked(data)["uid"]
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array([int(uid[0])] * len(uid), pa.int64()), pa.array([data] + [None] * (len(uid) - 1), pa.binary())], names=["uid", "home", "block"])

    def write(blocks: pa.Table, rows: pa.Table) -> pa.Table:
        data = [b for b in blocks.column("block").to_pylist() if b is not None]
        if not data or not rows.num_rows:  # no anchor of the block has a positive
            return pa.table({"block": pa.array([], pa.binary())})
        block = unpacked(data[0])
        at = {u: i for i, u in enumerate(block["uid"].tolist())}
        most = int(max(rows.column("number").to_pylist())) + 1
        numbers, told = np.full((len(at), most), -1, dtype=np.int64), np.zeros((len(at), most), dtype=np.int64)
        for u, n, s in zip(*(rows.column(c).to_pylist() for c in ("uid", "number", "score"))):
            numbers[at[u], n], told[at[u], n] = n, s
        return pa.table({"block": pa.array([packed(**block, number=numbers, told=told)], pa.binary())})

    homes = placed.where("anchors = 1").mapInArrow(number, "uid long, home long, block binary")
    rows = found.join(homes.select("uid", "home"), "uid").select("home", "uid", "number", "score")
    blocks = homes.where("block is not null").select(F.col("home").alias("place"), "block")
    return blocks.groupBy("place").cogroup(rows.groupBy("home")).applyInArrow(write, "block binary")


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives_k: int = POSITIVES, negatives_k: int = NEGATIVES, least: int = LEAST, most: int = MOST, room: int = ROOM
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the rows of ``vectors`` (vec_id, label, embedding) where ``anchor`` holds.

    Scores are inner products of floor(256 * x), exact for components of any size; a score that a long can't hold counts as the long's
    limit. An anchor's positives are its ``positives_k`` best other rows of its label; for each the ``negatives_k`` best rows of other labels
    with least percent <= negative score / positive score <= most percent are returned, ties by smaller vec_id. Rows without
    vec_id, label or vector, or with a null or non-finite component, take no part; vectors of another length are no candidates, all-zero
    ones are. Rows of the anchor's vec_id are never its positives; other repeated rows count each. Fewer candidates give fewer rows, no
    rows give none. Other columns are left alone.
    """
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("embedding")))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    placed, shards = _placed(kept, anchor, room)
    asked = placed.where("anchors = 1").select("block")
    found = _answered(placed, asked, shards, lambda a, h: positives(a, h, positives_k))
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("number", F.row_number().over(best) - 1).where(F.col("number") < positives_k)
    found = stored(found.select("uid", F.col("number").cast("long").alias("number"), "vec_id", "score"))
    mined = _answered(placed, _told(placed, found), shards, lambda a, h: negatives(a, h, negatives_k, least, most))
    best = Window.partitionBy("uid", "number").orderBy(F.desc("score"), "vec_id")
    mined = mined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives_k)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("block"):
                block = unpacked(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block["uid"]), pa.array(block["ids"])], names=["uid", "anchor_id"])

    names = asked.mapInArrow(named, "uid long, anchor_id long")
    pairs = found.select("uid", "number", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        mined.select("uid", "number", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, ["uid", "number"])
        .join(names, "uid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


@query(
    "op11_angular_hard_negatives",
    f"""
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_dot_product(a.w, c.w) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.w) = len(c.w)
    ), p AS (
      SELECT a, c, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= {POSITIVES}
    ), n AS (
      SELECT p.a, p.c AS p, p.score AS ps, s.c, s.score, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS k
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score
    )
    SELECT a AS anchor_id, p AS positive_id, CAST(k AS INT) AS rank, c AS negative_id, ps AS positive_score, score AS negative_score
    FROM n WHERE k <= {NEGATIVES}
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)
