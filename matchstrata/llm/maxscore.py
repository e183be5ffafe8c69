"""Exact top-k search by inner product with MaxScore over sharded postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchstrata.llm.base import query, table
from matchstrata.llm.vectors import as_long, product, sound, wide

TOP = 5
#: Candidates of a shard and queries of a block at most (about, as both are dealt by a hash).
SHARD, QUERIES = 8192, 512


class Postings:
    """A shard: for each term (dimension) and sign the candidates with a weight of that sign, and the largest weight's size.

    Only weights of the query's sign raise a score, so a term's bound is the query's weight times the largest weight of that sign.
    """

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.weights = ids[order], np.ascontiguousarray(weights[order])
        self.columns = np.ascontiguousarray(self.weights.T).astype(np.float64)
        self.most = {True: np.maximum(self.weights.max(axis=0), 0), False: np.maximum(-self.weights.min(axis=0), 0)}
        self.lists = {(t, up): np.flatnonzero(col > 0 if up else col < 0) for t, col in enumerate(self.weights.T) for up in (True, False)}

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best other candidates, ties to the smaller id; terms with the highest bounds come first.

        With a threshold (the k-th best so far), terms split in two: the non-essential ones, whose bounds together stay below it, and the
        essential ones. A candidate in no essential list can't reach it. Candidates of the essential lists are scored term by term,
        and dropped once their score and the bounds of the terms to come fall below the threshold.
        """
        bound = np.where(query > 0, query * self.most[True], -query * self.most[False])
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0]))
        # A first threshold: full scores of the candidates with the largest weights in the first term.
        head = int(order[0]) if len(order) else 0
        first = self.lists[head, bool(query[head] > 0)] if len(order) else np.empty(0, dtype=np.int64)
        if len(first) > 8 * k:
            first = first[np.argpartition(-np.abs(self.weights[first, head]), 8 * k)[: 8 * k]]
        scores = self.weights[first] @ query
        scores = np.sort(scores[self.ids[first] != own])[::-1]
        least = int(scores[k - 1]) if len(scores) >= k else None
        if floor is not None and (least is None or floor > least):
            least = floor
        if least is None:
            live, score, done = np.arange(len(self.ids)), np.zeros(len(self.ids)), 0
        else:
            essential = int(np.count_nonzero(rest[:-1] >= least))
            seen = np.zeros(len(self.ids), dtype=bool)
            if rest[-1] >= least:  # even a score of nothing competes
                seen[:] = True
            for t in order[:essential].tolist():
                seen[self.lists[t, bool(query[t] > 0)]] = True
                if seen.all():
                    break
            live, score, done = np.flatnonzero(seen), None, 0
            score = np.zeros(len(live))
        # Steps of eight terms: exact whole numbers, as sums stay below 2**53.
        while done < len(order):
            some = order[done : done + 8]
            score = score + query[some].astype(np.float64) @ self.columns[some][:, live]
            done += len(some)
            if least is not None and done < len(order):
                keep = score + rest[done] >= least
                if keep.sum() < 0.8 * len(live):
                    live, score = live[keep], score[keep]
        other = self.ids[live] != own
        live, score = live[other], score[other].astype(np.int64)
        best = np.lexsort((self.ids[live], -score))[:k]
        return list(zip(self.ids[live[best]].tolist(), score[best].tolist()))


class Exact:
    """Candidates whose scores may pass what doubles hold exactly, in whole numbers of any size."""

    def __init__(self, ids: list[int], weights: np.ndarray):
        self.ids, self.weights = ids, [[int(x) for x in w] for w in weights.tolist()]

    def search(self, query: list[int], own: int) -> list[tuple[int, int]]:
        return [(i, as_long(product(query, w))) for i, w in zip(self.ids, self.weights) if i != own]


class Shard:
    """Candidates of one length: postings of those that doubles score exactly, and the others."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        large = wide(weights)
        self.plain = Postings(ids[~large], weights[~large].astype(np.int64)) if not large.all() else None
        self.large = Exact(ids[large].tolist(), weights[large])
        self.every: Exact | None = None

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best other candidates, ties to the smaller id."""
        if wide(query[None])[0]:
            if self.every is None and self.plain:
                self.every = Exact(self.plain.ids.tolist(), self.plain.weights)
            whole = [int(x) for x in query.tolist()]
            found = (self.every.search(whole, own) if self.every else []) + self.large.search(whole, own)
        else:
            found = self.plain.search(query.astype(np.int64), own, k) if self.plain else []
            if self.large.ids:
                found = found + self.large.search([int(x) for x in query.tolist()], own)
        return sorted(found, key=lambda f: (-f[1], f[0]))[:k]


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and weights (array of double): floor(scale * x) of each component, a whole number; unusable vectors are left out."""
    kept = vectors.where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))
    # Beyond 2**53 a double is whole already; Spark's floor gives longs.
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * scale) >= 2.0**53, x.cast("double") * scale).otherwise(F.floor(x.cast("double") * scale).cast("double")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("weights"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = TOP, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query, its own row apart.

    Both have vec_id and weights (whole numbers of any size). Scores are integer inner products, exact, and a long's limit where they pass it; ties go to the smaller vec_id; fewer candidates give fewer rows. Vectors of
    another length than the query's are no candidates; repeated rows count each. Candidates are dealt to shards by a hash; queries
    travel in packed blocks, each to every shard, and a task holds one shard and one block at a time. Empty tables give no rows.
    """
    n = candidates.count()
    shards = max(1, -(-n // shard))
    blocks = max(1, -(-queries.count() // block))

    def pack(group: pa.Table) -> pa.Table:
        sizes = group.column("weights").combine_chunks().value_lengths().to_numpy()
        return pa.table({"block": group.column("block").slice(0, 1), "ids": pa.array([group.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "sizes": pa.array([sizes.astype("<i8").tobytes()], pa.binary()), "data": pa.array([group.column("weights").combine_chunks().flatten().to_numpy().astype("<f8").tobytes()], pa.binary())})

    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "weights"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, ids binary, sizes binary, data binary")
    asked = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("block").alias("turn"), "ids", "sizes", "data")

    def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("weights")
            sizes = lists.value_lengths().to_numpy()
            flat, at = lists.flatten().to_numpy().astype("<f8"), np.concatenate(([0], np.cumsum(sizes)))
            data = [flat[a:b].tobytes() for a, b in zip(at, at[1:])]
            ids = [x.to_bytes(8, "little", signed=True) for x in batch.column("vec_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(np.full(len(ids), -1, dtype=np.int32)), pa.array(ids, pa.binary()), pa.array([int(x).to_bytes(8, "little") for x in sizes], pa.binary()), pa.array(data, pa.binary())], names=["shard", "turn", "ids", "sizes", "data"])

    held = candidates.withColumn("shard", F.pmod(F.xxhash64("vec_id", "weights"), F.lit(shards)).cast("int")).mapInArrow(shard_rows, "shard int, turn int, ids binary, sizes binary, data binary")
    placed = held.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "turn")

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_now, waiting, ready = None, [], None
        for batch in batches:
            out = []
            for s, turn, ids, sizes, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if s != shard_now:
                    shard_now, waiting, ready = s, [], None
                if turn < 0:
                    waiting.append((ids, data))
                    continue
                if ready is None:  # the shard is complete: its candidates sort before the queries
                    ready, by_size = {}, {}
                    for i, d in waiting:
                        by_size.setdefault(len(d) // 8, []).append((i, d))
                    for size, rows in by_size.items():
                        weights = np.frombuffer(b"".join(d for _, d in rows), dtype="<f8").reshape(len(rows), size)
                        ready[size] = Shard(np.frombuffer(b"".join(i for i, _ in rows), dtype="<i8"), weights)
                    waiting = []
                at = 0
                flat = np.frombuffer(data, dtype="<f8")
                for q, size in zip(np.frombuffer(ids, dtype="<i8").tolist(), np.frombuffer(sizes, dtype="<i8").tolist()):
                    w = flat[at : at + size]
                    at += size
                    if size in ready:
                        out += [(q, v, x) for v, x in ready[size].search(w, q, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    found = placed.mapInArrow(serve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query(
    "op7_maxscore_top5",
    f"""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
      WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.w) = len(q.w)
    )
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {TOP}
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))
