"""Packs token pieces into few sequences of a fixed length by linear grouping.

Lengths are whole numbers up to the capacity, so the plan works on how many pieces have each length, a table of at most
``capacity`` rows whatever the corpus. Large lengths are cut into groups of equal cardinality and rounded up to the group's largest;
the best mix of configurations of these few sizes is found by column generation; real lengths take the places of
the rounded ones; what is left over and the small lengths follow by best fit. Pieces then take their places by rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from matchstrata.core import stored
from matchstrata.llm.base import query, sliced, table, texts
from matchstrata.llm.vocabulary import encoder

CAPACITY = 4096
#: Sizes that large lengths are rounded to.
GROUPS = 32
#: Lengths above this part of the capacity are large.
LARGE = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, forget: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity``; part and nth number the pieces of a length.

    A null or empty text is the end id alone. Null and repeated doc_id are kept, row by row. With ``forget`` a task leaves no encoder
    and no remembered chunks in its Python worker, which other stages go on with.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        encode, end = encoder(path).encode, np.uint32(end_id).astype("<u4").tobytes()
        for batch in sliced(batches):
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    some = ids[at : at + 4 * capacity]
                    n = len(some) // 4
                    out.append((doc, k, at // 4, n, zlib.crc32(some), part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )
        if forget:
            encoder.cache_clear()

    return texts(docs).mapInArrow(cut, PIECES)


class Bins:
    """Kinds of sequences: what lengths one holds, how many there are, and the kinds by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, held: dict[int, int], count: int) -> None:
        room = self.capacity - sum(n * m for n, m in held.items())
        if room not in self.by_room or not self.by_room[room]:
            bisect.insort(self.rooms, room)
        self.by_room[room].append((held, count))

    def take(self, room: int) -> tuple[dict[int, int], int]:
        kind = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms.remove(room)
        return kind

    def best_fit(self, length: int, count: int) -> None:
        """Put ``count`` pieces of a length where the least room is left; a sequence takes them while they fit."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            held, bins = self.take(self.rooms[at]) if at < len(self.rooms) else ({}, count)
            each = (self.capacity - sum(n * m for n, m in held.items())) // length
            full = min(bins, count // each)
            if full:
                self.add(held | {length: held.get(length, 0) + each}, full)
            count -= full * each
            last = min(count, each) if full < bins else 0
            if last:
                self.add(held | {length: held.get(length, 0) + last}, 1)
                count -= last
            if held and (rest := bins - full - bool(last)):
                self.add(held, rest)

    def kinds(self) -> Iterator[tuple[dict[int, int], int]]:
        for kinds in self.by_room.values():
            yield from kinds


def groups_of(lengths: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """(length, count) in falling order, cut into runs of equal cardinality."""
    each = -(-sum(c for _, c in lengths) // groups)
    out, room = [], 0
    for length, count in lengths:
        while count:
            if not room:
                out.append([])
                room = each
            n = min(room, count)
            out[-1].append([length, n])
            room -= n
            count -= n
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """How many sequences of which mix of sizes cover the counts with the fewest sequences, fractions allowed."""
    g = len(sizes)
    want = np.asarray(counts, dtype=float)
    basis = np.diag([float(capacity // s) for s in sizes])
    x = want / np.diag(basis)
    most = capacity // min(sizes)
    for _ in range(200 * g):
        price = np.linalg.solve(basis.T, np.ones(g))
        # The mix of at most ``most`` sizes with the highest price, by the room it takes.
        best = np.zeros(capacity + 1)
        picks = []
        for _ in range(most):
            step, pick = best.copy(), np.full(capacity + 1, -1)
            for i, s in enumerate(sizes):
                value = best[: capacity + 1 - s] + price[i]
                better = value > step[s:] + 1e-12
                step[s:][better] = value[better]
                pick[s:][better] = i
            picks.append(pick)
            best = step
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(g), capacity
        for pick in reversed(picks):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        move = np.linalg.solve(basis, column)
        up = move > 1e-9
        ratio = np.where(up, x / np.where(up, move, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * move, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, i].astype(int), float(x[i])) for i in range(g)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[dict[int, int], int]]:
    """Kinds of sequences, as (length -> pieces of it in one sequence, number of sequences), that hold all pieces."""
    bins = Bins(capacity)
    if whole := counts.get(capacity, 0):
        bins.add({capacity: 1}, whole)
    large = sorted(((n, c) for n, c in counts.items() if capacity // LARGE < n < capacity and c), reverse=True)
    if large:
        runs = groups_of(large, groups)
        sizes, merged = [], []
        for run in runs:  # a length that fills whole groups is one size
            if sizes and sizes[-1] == run[0][0]:
                merged[-1] += run
            else:
                sizes.append(run[0][0])
                merged.append(run)
        for column, x in configurations(sizes, [sum(n for _, n in run) for run in merged], capacity):
            places = [i for i, m in enumerate(column) for _ in range(m)]
            left = int(x + 1e-6)
            for i, m in enumerate(column):
                if m:
                    left = min(left, sum(n for _, n in merged[i]) // m)
            while left:
                # Real lengths of each group take the places, as many sequences at a time as hold the same lengths.
                heads = {i: merged[i][-1] for i in set(places)}
                n = min([left, *(run[1] // places.count(i) for i, run in heads.items())])
                held: dict[int, int] = defaultdict(int)
                if n:
                    for i in places:
                        held[merged[i][-1][0]] += 1
                        merged[i][-1][1] -= n
                else:  # one sequence across the border of two lengths
                    n = 1
                    for i in places:
                        held[merged[i][-1][0]] += 1
                        merged[i][-1][1] -= 1
                        if not merged[i][-1][1]:
                            merged[i].pop()
                for i in set(places):
                    if merged[i] and not merged[i][-1][1]:
                        merged[i].pop()
                bins.add(dict(held), n)
                left -= n
        rest: dict[int, int] = defaultdict(int)
        for run in merged:
            for length, n in run:
                rest[length] += n
        for length in sorted(rest, reverse=True):
            bins.best_fit(length, rest[length])
    for length in sorted((n for n, c in counts.items() if n <= capacity // LARGE and c), reverse=True):
        bins.best_fit(length, counts[length])
    return list(bins.kinds())


def places(kinds: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rising rank: the first rank, first sequence, pieces of it in a sequence, and offset of each kind that holds it."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    upto: dict[int, int] = defaultdict(int)
    sequence = 0
    for held, count in kinds:
        offset = 0
        for length in sorted(held, reverse=True):
            rows[length].append((upto[length], sequence, held[length], offset))
            upto[length] += held[length] * count
            offset += length * held[length]
        sequence += count
    return {n: tuple(np.asarray(c, dtype=np.int64) for c in zip(*r)) for n, r in rows.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """sequence_id and offset of every piece of a stored ``pieces`` table; no piece gives no row."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    where = spark.sparkContext.broadcast(places(plan(counts, capacity, groups)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy("part", "length").agg(F.count("*").alias("n")).select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(length), np.empty_like(length)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                n = int(length[rows[0]])
                begin, base, each, at = where.value[n]
                k = np.searchsorted(begin, rank[rows], side="right") - 1
                inside = rank[rows] - begin[k]
                sequence[rows] = base[k] + inside // each[k]
                offset[rows] = at[k] + inside % each[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, forget: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Empty and null texts are one piece of the end id; a text longer than ``capacity`` is cut; no documents give no rows.
    Repeated rows are packed each; further columns of ``docs`` are left out.
    """
    return pack(stored(pieces(docs, path, end_id, capacity, forget)), capacity)


@query("op1_linear_grouping_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
