"""Near copies by the exact overlap of word shingles: fingerprint groups and MinHash bands bring candidates together, each pair's own sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstrata.core import stored
from matchstrata.llm.base import sliced, texts
from matchstrata.llm.components import components

SEED = 42
#: A pair of similarity s shares no band with probability (1 - s**ROWS)**BANDS: 1.3e-7 at 0.8, 2e-10 at 0.85.
BANDS, ROWS = 40, 5
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_MASKS = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of a text.

    Words are runs of anything but ASCII white space, A-Z as a-z. Fewer words than a shingle, or none, are one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())), dtype=np.uint64, count=len(starts)))


def bands(hashes: np.ndarray) -> list[int]:
    """A key (a signed 64-bit number) of each band of the set's MinHash signature."""
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    half = len(least) // 2
    for at in range(0, len(hashes), 1024):
        for some, part in ((slice(0, half), low), (slice(half, None), high)):
            made = (part[None, at : at + 1024] ^ _MASKS[some, None]) * _FACTORS[some, None]
            least[some] = np.minimum(least[some], made.min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, the set's 128-bit hash (s0, s1), its size and its band keys, of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            s = [np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for x in sets], dtype=np.uint64).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s[0]), pa.array(s[1]), pa.array([len(x) for x in sets], pa.int64()), pa.array([bands(x) for x in sets], pa.list_(pa.int64()))],
                names=["doc_id", "s0", "s1", "n", "bands"],
            )

    return texts(docs).mapInArrow(each, "doc_id long, s0 long, s1 long, n long, bands array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node and its set of every row, the set as an array of longs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])

    return texts(docs).mapInArrow(each, "node long, items array<long>")


def similar(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose sets overlap (intersection by union) by ``least`` or more, decided in whole numbers."""
    p, q = least.numerator, least.denominator
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    total = F.size("x").cast("long") + F.size("y")
    shorter, longer = F.least(F.size("x"), F.size("y")).cast("long"), F.greatest(F.size("x"), F.size("y")).cast("long")
    # i / (total - i) >= p / q
    return both.where(shorter * q >= longer * p).where(F.size(F.array_intersect("x", "y")).cast("long") * (p + q) >= total * p).select("a", "b").distinct()


def _rare_first(sets: DataFrame, least: Fraction) -> DataFrame:
    """Of each set (node, part, items) the items one of which it shares with any set that overlaps it by ``least``: its rarest, with
    their places k in that order and its size n. Items that no other set holds keep their places, but aren't returned."""
    p, q = least.numerator, least.denominator
    long = sets.select("node", "part", F.xxhash64("items").alias("s"), F.size("items").cast("long").alias("n"), F.explode("items").alias("item"))
    shared = long.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    ordered = (
        long.join(shared, "item", "left")
        .groupBy("node", "part", "s", "n")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "item"))).alias("all"))
    )
    taken = F.col("n") - F.floor((F.col("n") * p + (q - 1)) / q) + 1
    return ordered.select("node", "part", "n", F.posexplode(F.slice("all", F.lit(1), taken.cast("int"))).alias("k", "e")).where("e.f > 1").select("node", "part", "n", "k", "e.item")


def across(sets: DataFrame, least: Fraction) -> DataFrame:
    """All pairs (a, b) of nodes of different parts whose sets (node, part, items) may overlap by ``least`` or more, and few others.

    The first item that two such sets share, rare ones first, lies so early in both that what follows it can still be overlap enough. Sets that differ
    in rare items and share frequent ones don't meet, however many of them there are.
    """
    p, q = least.numerator, least.denominator
    early = stored(_rare_first(sets, least))
    left, right = (early.select(*[F.col(c).alias(f"{c}_{side}") for c in early.columns]) for side in "xy")
    enough = (F.least(F.col("n_x") - F.col("k_x"), F.col("n_y") - F.col("k_y")) * (p + q)) >= (F.col("n_x") + F.col("n_y")) * p
    sizes = F.least("n_x", "n_y") * q >= F.greatest("n_x", "n_y") * p
    met = left.join(right, (F.col("item_x") == F.col("item_y")) & (F.col("node_x") < F.col("node_y")) & (F.col("part_x") != F.col("part_y")) & sizes & enough)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def near_copies(docs: DataFrame, alike: DataFrame, shingle: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, s0, s1 (the hash of the set of shingles) and component_id (smallest doc_id that links reach) of every row.

    Two texts link if their sets of shingles overlap by ``least`` or more. Rows with equal sets are one node. Buckets are the groups of ``alike``
    (doc_id, component_id), and those of each MinHash band. All nodes of a bucket are held against the smallest first; then the nodes of all
    buckets that are in more than one component still are, by ``across``. A null doc_id keeps its row.
    """
    rows = stored(_signed(docs, shingle))
    nodes = stored(rows.groupBy("s0", "s1").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    known = nodes.where("node is not null")
    grouped = alike.select(F.col("doc_id").alias("node"), F.xxhash64(F.lit("alike"), "component_id").alias("key")).join(known.select("node"), "node", "left_semi")
    placed = known.select("node", F.explode("bands").alias("key")).unionByName(grouped).distinct()
    buckets = placed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").select("key", "lead")
    placed = stored(placed.join(buckets, "key"))
    known = placed.select("node").distinct()
    wanted = docs.join(known, docs["doc_id"].cast("long") == known["node"], "left_semi")
    sets = stored(_sets(wanted, shingle).distinct())
    star = stored(placed.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    edges = stored(similar(star, sets, least))
    member = stored(placed.select("key", "node").join(components(edges), "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")))
    open_ = member.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    left = member.join(open_, "key", "left_semi").select("node", "part").distinct()
    rest = across(sets.join(left, "node"), least).join(star, ["a", "b"], "left_anti")
    joined = components(edges.unionByName(stored(similar(stored(rest), sets, least))))
    of = nodes.join(joined, "node", "left").select("s0", "s1", F.coalesce("component", "node").alias("component_id"))
    return rows.select("doc_id", "s0", "s1").join(of, ["s0", "s1"]).select("doc_id", "s0", "s1", "component_id")
