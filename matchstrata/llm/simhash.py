"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstrata.core import stored
from matchstrata.llm.base import query, sliced, table, texts
from matchstrata.llm.components import components, forest
from matchstrata.llm.resemblance import near_copies

BITS = 64
SEED = 42
DISTANCE = 4
#: Fingerprints of one bucket that a task compares with each other at once; larger buckets are cut into blocks, and blocks are paired.
BLOCK = 4096


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each shingle: its XXH64 for 0, else a bit mix of it."""
    if not k:
        return h
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def fingerprint(text: str, shingle: int, views: int = 1) -> list[int]:
    """``views`` fingerprints. A bit is 1 if set in over half the shingle hashes.

    Words are runs of anything but ASCII white space, A-Z as a-z. Fewer words than a shingle are one shingle; no word gives 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * views
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros((views, BITS), dtype=np.int64)
    for at in range(0, n, 50_000):
        some = range(at, min(n, at + 50_000))
        last = np.minimum(np.arange(some.start, some.stop) + shingle - 1, len(words) - 1)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[some.start : some.stop].tolist(), ends[last].tolist())], dtype="<u8")
        for k in range(views):
            counts[k] += np.unpackbits(_mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(counts * 2 > n, axis=1, bitorder="little")]


def fingerprints(docs: DataFrame, shingle: int, views: int = 1) -> DataFrame:
    """doc_id and fingerprints fp0, fp1, ... (as longs) of every row; a null text is an empty one."""
    names = ["doc_id", *(f"fp{k}" for k in range(views))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(t, shingle, views) for t in batch.column("text").to_pylist()], dtype=np.uint64).reshape(-1, views)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(views))], names=names)

    return texts(docs).mapInArrow(each, ", ".join(f"{n} long" for n in names))


class Ring:
    """The bits of a fingerprint as a ring of ``distance + 1`` segments.

    If two fingerprints differ in at most ``distance`` bits, some segment starts a chain of which each prefix of l segments differs
    in at most l * distance / segments bits. So the first segment is equal, the first two differ in at most one bit, and so on.
    """

    def __init__(self, distance: int = DISTANCE):
        self.distance, self.m = distance, distance + 1
        cuts = [BITS * i // self.m for i in range(self.m + 1)]
        self.low, self.width = cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:])]

    def part(self, fp: np.ndarray, i: int) -> np.ndarray:
        i %= self.m
        return (fp >> np.uint64(self.low[i])) & np.uint64((1 << self.width[i]) - 1)

    def budget(self, length: int) -> int:
        return length * self.distance // self.m

    def keys(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """Keys of chains of two: the own one (true), and those of second segments one bit away (false)."""
        for i in range(self.m):
            wide = np.uint64(self.width[(i + 1) % self.m])
            own = (np.uint64(i) << np.uint64(60)) | (self.part(fp, i) << wide)
            second = self.part(fp, i + 1)
            yield own | second, True
            if self.budget(2):
                for j in range(int(wide)):
                    yield own | (second ^ np.uint64(1 << j)), False

    def flips(self, key: int) -> list[int]:
        """What turns a key into itself and into the keys one bit of the second segment away."""
        return [0, *(1 << j for j in range(self.width[((key >> 60 & 15) + 1) % self.m]))]

    def linked(self, x: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
        """Which pairs (of arrays that broadcast) pass the chain that begins at ``start``, and then the whole distance."""
        differ = x ^ y
        total = np.zeros(differ.shape, dtype=np.uint8)
        good = np.ones(differ.shape, dtype=bool)
        for length in range(1, self.m + 1):
            total += np.bitwise_count(self.part(differ, start + length - 1)).astype(np.uint8)
            good &= total <= self.budget(length)
        return good & (np.bitwise_count(differ) <= self.distance)


def _edges(ring: Ring, start: int, own: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in own and in (own, near) of links that join what all their links join.

    A fingerprint takes everything that links to it out of the rest, so a dense bucket costs little more than its size.
    """
    both = np.concatenate((own, near))
    rest = np.arange(len(both))
    a, b, todo = [], [], []
    while len(rest):
        if todo:
            k = todo.pop()
        else:  # a new part begins at an own fingerprint that is not reached yet
            fresh = rest[rest < len(own)]
            if not len(fresh):
                break
            k = int(fresh[0])
            rest = rest[rest != k]
        # Pairs of two near ones belong to other buckets.
        side = rest if k < len(own) else rest[rest < len(own)]
        hit = side[ring.linked(both[side], both[k], start)]
        if len(hit):
            a.append(np.full(len(hit), k))
            b.append(hit)
            todo += hit.tolist()
            rest = np.setdiff1d(rest, hit, assume_unique=True)
    if not a:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(a), np.concatenate(b)


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (fp, node) that join all pairs within ``distance`` bits.

    Only links that join something new inside a bucket come out, never all pairs of a group. Buckets over ``block`` rows are cut
    into blocks by a hash, each pair of blocks being a bucket of its own.
    """
    ring = Ring(distance)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            node = batch.column("node")
            for key, own in ring.keys(fp):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column("fp"), node, pa.array(np.full(len(fp), own))], names=["key", "fp", "node", "own"]
                )

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            keys = [k for k, own in ring.keys(fp) if own]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], names=["key"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k ^ flip, n) for k, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist()) for flip in ring.flips(k)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["key", "n"])

    probes = nodes.mapInArrow(expand, "key long, fp long, node long, own boolean")
    # A bucket's rows are the own rows of its key and of keys one bit away; only keys with many own rows can make a bucket large.
    many = nodes.mapInArrow(owned, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block // 14)
    sizes = many.mapInArrow(around, "key long, n long").groupBy("key").agg((F.ceil(F.sum("n") / block) + 1).cast("int").alias("cuts"))
    sizes = stored(sizes)
    cut = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    if sizes.isEmpty():
        keyed = probes.withColumns({"i": F.lit(0), "j": F.lit(0), "mine": F.lit(0)})
    else:
        keyed = (
            probes.join(sizes, "key", "left")
            .withColumn("cuts", F.coalesce("cuts", F.lit(1)))
            .withColumn("mine", cut)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            .select("key", "fp", "node", "own", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
        )
    placed = keyed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            held = pa.Table.from_batches(kept)
            cols = [held.column(c).to_numpy() for c in ("key", "i", "j")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            if len(change):
                yield from buckets(held.slice(0, int(change[-1])))
                kept = held.slice(int(change[-1])).combine_chunks().to_batches()
        if kept:
            yield from buckets(pa.Table.from_batches(kept))

    def buckets(held: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
        fp, node, own = held.column("fp").to_numpy().view(np.uint64), held.column("node").to_numpy(), held.column("own").to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        sizes = np.diff(np.append(first, len(key)))
        owns = np.add.reduceat(own.astype(np.int64), first)
        out = [], []
        for at, n in zip(first[(sizes > 1) & (owns > 0)].tolist(), sizes[(sizes > 1) & (owns > 0)].tolist()):
            rows = np.arange(at, at + n)
            is_own = own[rows]
            mine, near = rows[is_own], rows[~is_own]
            a, b = _edges(ring, int(key[at]) >> 60 & 15, fp[mine], fp[near])
            if len(a):
                order = np.concatenate((mine, near))
                out[0].append(node[order[a]])
                out[1].append(node[order[b]])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["a", "b"])

    return placed.mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = DISTANCE, views: int = 1) -> DataFrame:
    """doc_id, fingerprints fp0, ... and component_id (smallest doc_id that links reach) of every row.

    Two texts link if in one of ``views`` independent fingerprints they differ in at most ``distance`` bits. Rows with equal
    fingerprints are one node, so copies cost nothing further. Texts without words share fingerprint 0 and link like any other.
    A null doc_id keeps its row and is never a component's id unless all its rows lack one; then that is null. No documents give no rows.
    """
    names = [f"fp{k}" for k in range(views)]
    fps = stored(fingerprints(docs, shingle, views))
    nodes = stored(fps.groupBy(*names).agg(F.min("doc_id").alias("node")))
    edges = None
    for name in names:
        first = nodes.where("node is not null").groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("node"))
        some = links(stored(first) if views > 1 else first, distance)
        if views > 1:  # nodes that agree in this fingerprint hang on one of them
            some = some.unionByName(nodes.select(F.col("node").alias("a"), F.col(name).alias("fp")).join(first, "fp").where("a <> node").select("a", F.col("node").alias("b")))
            some = stored(some)  # each view by itself: one plan of all of them is slow to re-plan after each of its many stages
        edges = some if edges is None else edges.unionByName(some)
    joined = components(edges)
    of = nodes.join(joined, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    return fps.join(of, names).select("doc_id", *names, "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """The documents that stay: of each component the row with the smallest doc_id; rows without
    doc_id, and repeated rows of one that stays, stay, too.

    Components are those of the pairs whose shingle sets overlap by ``least`` or more. Groups of near fingerprints are candidates,
    and the sets themselves decide. Fingerprints alone don't: four at five bits link 0.27 of the pairs at 0.80 to 0.85 and 0.09 of
    those at 0.70 to 0.80, and pigeonring filtering selects nothing at the some fifteen bits that reach all of the former. So
    MinHash bands add candidates.
    """
    alike = stored(near_duplicates(docs, shingle).select("doc_id", "component_id"))
    found = near_copies(docs, alike, shingle, least)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


@query("op9_simhash_pigeonring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")
