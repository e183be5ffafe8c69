"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the inverted files of the first of them; a query looks into
the files of more of its own. Within a file candidates are ranked by the footrule distance between their order and the query's, and the
first ones are reranked by their inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchstrata.core import partitions, stored
from matchstrata.llm.base import query, table
from matchstrata.llm.vectors import by_length, sound

TOP = 20
#: Pivots of one vector length, the rows (of smallest hash of vec_id) that they are taken from, and how many of these each stands for at least.
PIVOTS, SAMPLE, EACH = 128, 4096, 16
#: Nearest pivots that an order keeps, files that a vector is posted in, and files that a query looks into.
ORDER, POSTED, SEARCHED = 64, 4, 48
#: Candidates of a file's shard that are reranked: a share of them, and so many at least.
SHARE, LEAST = 0.16, 256
#: Candidates of a shard, about: longer files are cut by a hash.
ROOM = 8192
#: The file of vectors whose length no sampled row had; there everything is compared.
REST = -1


def directions(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their size."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def pivots_of(rows: list[list[float]]) -> dict[int, tuple[int, np.ndarray]]:
    """For each vector length the number of its first file, and up to PIVOTS different directions, the first ones of ``rows``; few rows give few pivots."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r), []).append(r)
    out, upto = {}, 0
    for d in sorted(by):
        unit = directions(np.asarray(by[d]))
        _, first = np.unique(unit.round(9), axis=0, return_index=True)
        out[d] = upto, unit[np.sort(first)[: max(1, min(PIVOTS, len(unit) // EACH))]]
        upto += len(out[d][1])
    return out


def products(raw: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; a pair's product doesn't depend on the rows around it."""
    return (raw.astype(np.float64) * query.astype(np.float64)).sum(axis=1)


class File:
    """A shard of the inverted file of one pivot: vec_ids in rising order, vectors, and the place of every pivot in their orders."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, orders: np.ndarray, pivots: int):
        self.ids, self.raw, self.length = ids, raw, orders.shape[1]
        self.place = np.full((pivots, len(ids)), self.length, dtype=np.int16)
        for j in range(self.length):
            self.place[orders[:, j], np.arange(len(ids))] = j
        self.norm = np.sqrt(np.einsum("ij,ij->i", raw, raw, dtype=np.float64))

    def search(self, own: int, raw: np.ndarray, order: np.ndarray, turn: int, posted: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_id and score of the k best of the reranked candidates; those in a file that the query looks into before (``turn``) are met there."""
        new = self.ids != own
        if turn > 0:
            new &= (self.place[order[:turn]] >= posted).all(axis=0)
        some = np.flatnonzero(new)
        room = max(LEAST, int(np.ceil(SHARE * len(self.ids))))
        if len(some) > room:
            place = self.place[order]
            # Pivots that only the candidate's order has stand at its end in the query's.
            apart = np.abs(place - np.arange(self.length, dtype=np.int16)[:, None]).sum(axis=0, dtype=np.int32) + place.sum(axis=0, dtype=np.int32)
            most = self.length * (2 * self.length)
            closeness = (most - apart[some]) * self.norm[some]
            some = some[np.argsort(-closeness, kind="stable")[:room]]
        scores = products(self.raw[some], raw)
        best = np.lexsort((self.ids[some], -scores))[:k]
        return self.ids[some[best]], scores[best]


def nearest(vectors: DataFrame, asks: Column, k: int = TOP, room: int = ROOM) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found of every row of ``vectors`` (vec_id, embedding) where ``asks`` holds.

    Nearest is the largest inner product, ties go to the smaller vec_id; rows of the query's vec_id are no candidates of it. The search is
    approximate, and its recall is a matter of the constants above: measured on the given tables against brute force, 0.97 and more.
    Orders go by angle, so lengths that differ by orders of magnitude lower the recall. Rows without vec_id, null, empty and zero vectors,
    and those with a null or non-finite component take no part; vectors of another length are no candidates. Repeated rows count
    each, and each repeated query row gets its results. Fewer candidates give fewer rows, no rows give none.
    """
    spark = vectors.sparkSession
    kept = vectors.where(F.col("vec_id").isNotNull() & sound(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    dtype = "<f4" if kept.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    shared = spark.sparkContext.broadcast(pivots_of([r.embedding for r in sample]))  # rows of the sample

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            orders, files, data = [b""] * n, [[REST]] * n, [b""] * n
            for d, (rows, raw) in by_length(batch.column("embedding"), dtype).items():
                for r, x in zip(rows.tolist(), raw):
                    data[r] = x.tobytes()
                if d in shared.value:
                    base, pivots = shared.value[d]
                    order = np.argsort(-(directions(raw) @ pivots.T), axis=1, kind="stable")[:, :ORDER].astype("<i2")
                    for r, o in zip(rows.tolist(), order):
                        orders[r], files[r] = o.tobytes(), (base + o[:SEARCHED].astype(np.int32)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("asks"), pa.array(files, pa.list_(pa.int32())), pa.array(orders, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "asks", "files", "orders", "data"])

    represented = kept.withColumn("asks", F.coalesce(asks, F.lit(False))).mapInArrow(represent, "vec_id long, asks boolean, files array<int>, orders binary, data binary")
    represented = stored(represented.withColumn("uid", F.monotonically_increasing_id()))
    posted = represented.select(F.explode(F.slice("files", 1, POSTED)).alias("file"), "vec_id", "orders", "data")
    cuts = {r.file: -(-r.n // room) for r in posted.groupBy("file").agg(F.count("*").alias("n")).collect()}  # a row per pivot
    if not cuts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cut = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])[F.col("file")]
    layout = ["file", "cut", "turn", "uid", "vec_id", "orders", "data"]
    held = posted.withColumn("cut", F.pmod(F.xxhash64("vec_id"), cut).cast("int")).withColumn("turn", F.lit(-1)).withColumn("uid", F.lit(0).cast("long")).select(layout)
    looked = represented.where("asks").select(F.posexplode("files").alias("turn", "file"), "uid", "vec_id", "orders", "data")
    asked = looked.where(cut.isNotNull()).withColumn("cut", F.explode(F.sequence(F.lit(0), cut - 1))).select(layout)
    parts = max(partitions(spark), 1)
    together = held.unionByName(asked).repartition(parts, "file", "cut").sortWithinPartitions("file", "cut", "turn", "vec_id")

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        now, waiting, ready = None, {}, {}
        for batch in batches:
            found: list[tuple] = []
            for file, cut, turn, uid, own, order, data in zip(*(batch.column(c).to_pylist() for c in layout)):
                if (file, cut) != now:
                    now, waiting, ready = (file, cut), {}, {}
                d = len(data) // width
                if turn < 0:
                    waiting.setdefault(d, []).append((own, order, data))
                    continue
                if d in waiting:  # candidates sort before queries
                    rows = waiting.pop(d)
                    raw = np.frombuffer(b"".join(x for _, _, x in rows), dtype).reshape(len(rows), d)
                    orders = np.frombuffer(b"".join(o for _, o, _ in rows), "<i2").reshape(len(rows), -1)
                    pivots = len(shared.value[d][1]) if d in shared.value else 0
                    ready[d] = File(np.asarray([i for i, _, _ in rows], dtype=np.int64), raw, orders, pivots)
                if d in ready:
                    ids, scores = ready[d].search(own, np.frombuffer(data, dtype), np.frombuffer(order, "<i2"), turn, POSTED, k) if order else _all(ready[d], own, np.frombuffer(data, dtype), k)
                    found.append((uid, own, ids, scores))
            if found:
                sizes = [len(f[2]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[i] for f in found], sizes).astype(np.int64)) for i in (0, 1)] + [pa.array(np.concatenate([f[2] for f in found])), pa.array(np.concatenate([f[3] for f in found]).astype(np.float64))],
                    names=["uid", "query_id", "vec_id", "score"],
                )

    found = together.mapInArrow(serve, "uid long, query_id long, vec_id long, score double")
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _all(file: File, own: int, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of all candidates, for lengths without pivots."""
    some = np.flatnonzero(file.ids != own)
    scores = products(file.raw[some], raw)
    best = np.lexsort((file.ids[some], -scores))[:k]
    return file.ids[some[best]], scores[best]


@query("op13_permutation_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
