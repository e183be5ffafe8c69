"""Phrase collocations: frequent n-grams from mergeable Misra-Gries summaries, counted exactly in a second pass.

Texts are stored once as blocks of word numbers. Each block tells every hash partition which n-grams it holds and how often; a partition merges
these into one Misra-Gries summary, whose capacity exceeds its mass divided by the threshold, so every frequent n-gram
survives; it answers each block with the survivors among its n-grams. First words and pairs go round, then the three to five word n-grams
all of whose pairs survived. The second pass reads the blocks again and counts the survivors exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchstrata.core import partitions, stored
from matchstrata.llm.base import query, sliced, table
from matchstrata.llm.ngrams import _narrow, _rising, _risen, _wide, gathered

LONGEST, THRESHOLD, SHARE, TOP = 5, 100, 100, 2000
#: Text bytes of a block, about; a longer text is one block.
BLOCK_BYTES = 2 << 20
UNKNOWN = "und"
#: How many times mass divided by threshold a summary's capacity is: more counters leave fewer n-grams that are not frequent.
SPARE = 4
#: Occurrences of n-grams that a hash partition gets at most, about, and what one should have at least. A task holds one partition's messages.
MASS, FEW = 4 << 20, 1 << 20
#: Keys that a partition sorts into its summary at once.
HELD = 1 << 20
#: Blocks in a row group: Spark's reader and writer hold one, and would else let a hundred rows come together before they look at the size.
GROUP = 8
#: Bytes that end a piece become one byte that no UTF-8 text holds; only it, spaces and tabs end words.
BREAK = b"\xff"
CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)


class Summary:
    """A Misra-Gries summary over 32-bit keys: at most ``capacity`` counters, each too low by at most ``lost`` <= mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Adds another summary, or counts of its own; keys in any order, repeats allowed."""
        keys, counts = np.concatenate((self.keys, keys.astype(np.uint32))), np.concatenate((self.counts, counts))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts[order], first) if len(first) else counts
        self.lost += lost
        if len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            keep = self.counts > cut
            self.keys, self.counts, self.lost = self.keys[keep], self.counts[keep] - cut, self.lost + cut

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys, rising, that may occur ``threshold`` times."""
        return self.keys[self.counts + self.lost >= threshold]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b >> np.uint64(32) | b << np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Block:
    """Texts as numbers of words; 0 stands for the end of a piece. A word has a number of its own in each language."""

    def __init__(self, langs: list[str], words: list[bytes], lang: np.ndarray, token: np.ndarray):
        self.langs, self.words, self.lang, self.token = langs, words, lang, token.astype(np.int64)

    @classmethod
    def of(cls, texts: list[bytes], langs: list[str]) -> Block:
        names: dict[str, dict[bytes, int]] = {}
        number: dict[str, int] = {}
        words, lang, tokens = [BREAK], [0], []
        for text, name in zip(texts, langs):
            ids = names.setdefault(name, {BREAK: 0})
            number.setdefault(name, len(number))
            found = text.lower().translate(CUT).replace(BREAK, b" \xff ").split()
            for w in set(found).difference(ids):
                ids[w] = len(words)
                words.append(w)
                lang.append(number[name])
            tokens.append(np.fromiter(map(ids.__getitem__, found), dtype=np.uint32, count=len(found)))
            tokens.append(np.zeros(1, dtype=np.uint32))
        return cls(list(names), words, np.asarray(lang, dtype=np.int64), np.concatenate(tokens) if tokens else np.empty(0, dtype=np.uint32))

    def counts(self) -> np.ndarray:
        """Words of each language."""
        return np.bincount(self.lang[self.token[self.token > 0]], minlength=len(self.langs))

    def levels(self) -> Iterator[Level]:
        """The distinct words, then those n-grams of one, two, ... words that the caller's marks of the last level let through."""
        hashes = np.asarray([0, *(xxhash.xxh64_intdigest(w, k) for w, k in zip(self.words[1:], self._seeds()))], dtype=np.uint64)
        at = np.flatnonzero(self.token)
        count = np.bincount(self.token[at], minlength=len(self.words))[1:]
        level = Level(1, at, self.token[at] - 1, np.arange(1, len(self.words))[:, None], hashes[1:], count)
        yield level
        for n in range(2, LONGEST + 1):
            # An n-gram stands where two of n - 1 words that may be frequent follow each other.
            alive = np.full(len(self.token) + 1, -1, dtype=np.int64)
            where = level.may[level.which]
            alive[level.at[where]] = level.which[where]
            at = np.flatnonzero((alive[:-1] >= 0) & (alive[1:] >= 0))
            last = self.token[at + n - 1] if len(at) else at
            key, first, which, count = np.unique(alive[at] << 32 | last, return_index=True, return_inverse=True, return_counts=True)
            spelled = self.token[at[first][:, None] + np.arange(n)] if len(at) else np.empty((0, n), dtype=np.int64)
            level = Level(n, at, which, spelled, _mix(level.hashes[key >> 32], hashes[key & 0xFFFFFFFF]), count)
            yield level

    def _seeds(self) -> list[int]:
        seeds = [xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), 11) for name in self.langs]
        return [seeds[k] for k in self.lang[1:].tolist()]

    def row(self, number: int) -> dict:
        n = self.counts()
        return {"block": number, "langs": self.langs, "n": n.tolist(), "words": b" ".join(self.words[1:]), "lang": _narrow(self.lang), "token": _narrow(self.token)}

    @classmethod
    def read(cls, row: dict) -> Block:
        return cls(row["langs"], [BREAK, *row["words"].split()], _wide(row["lang"]), _wide(row["token"]))


class Level:
    """Distinct n-grams of a block: where they stand, their words, hashes, counts, and whether they may be frequent."""

    def __init__(self, n: int, at: np.ndarray, which: np.ndarray, spelled: np.ndarray, hashes: np.ndarray, count: np.ndarray):
        self.n, self.at, self.which, self.spelled, self.hashes, self.count = n, at, which, spelled, hashes, count
        self.may = np.ones(len(count), dtype=bool)


class Sent:
    """The keys that a block sends for some levels: their order, by partition and key, and where each partition's keys begin."""

    def __init__(self, levels: list[Level], parts: int):
        self.levels = levels
        h = np.concatenate([lv.hashes for lv in levels])
        self.count = np.concatenate([lv.count for lv in levels])
        key = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.begin = np.searchsorted(self.key, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))

    def messages(self) -> Iterator[tuple[int, bytes, bytes, int]]:
        """(partition, keys, counts, mass); keys rise, and repeat only where two n-grams collide."""
        for p in np.flatnonzero(np.diff(self.begin)).tolist():
            some = slice(self.begin[p], self.begin[p + 1])
            count = self.count[self.order[some]]
            yield p, _rising(self.key[some] & np.uint64(0xFFFFFFFF)), _narrow(count), int(count.sum())

    def told(self, answers: list[tuple[int, bytes]]) -> None:
        """Marks the n-grams that may be frequent, from the places that partitions answered with."""
        may = np.zeros(len(self.order), dtype=bool)
        for p, places in answers:
            may[self.order[self.begin[p] + _risen(places).astype(np.int64)]] = True
        upto = 0
        for lv in self.levels:
            lv.may = may[upto : upto + len(lv.count)]
            upto += len(lv.count)


MESSAGE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("mass", pa.int64())])
ANSWER = pa.schema([("block", pa.int64()), ("round", pa.int32()), ("part", pa.int32()), ("places", pa.binary())])
SPELLED = pa.schema([("part", pa.int32()), ("langs", pa.list_(pa.string())), ("lang", pa.binary()), ("phrases", pa.binary()), ("counts", pa.binary())])
PHRASE = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])
BLOCK = "block long, langs array<string>, n array<long>, words binary, lang binary, token binary"


def _sql(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long", "list<item: string>": "array<string>"}
    return ", ".join(f"{f.name} {names.get(str(f.type), str(f.type))}" for f in schema)


def _messages(number: int, sent: Sent) -> pa.Table:
    return pa.Table.from_pylist([{"part": p, "block": number, "keys": k, "counts": c, "mass": m} for p, k, c, m in sent.messages()], schema=MESSAGE)


def blocks(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` (text, lang) as stored blocks, a row each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.taskcontext import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(sliced(gathered(batches), limit=BLOCK_BYTES)):
            block = Block.of(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            row = block.row(first + k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]], pa.int64()), pa.array([row["langs"]], pa.list_(pa.string())), pa.array([row["n"]], pa.list_(pa.int64())), *(pa.array([row[c]], pa.binary()) for c in ("words", "lang", "token"))],
                names=["block", "langs", "n", "words", "lang", "token"],
            )

    some = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    return stored(some.mapInArrow(build, BLOCK), {"parquet.block.row.count.limit": str(GROUP)})


def shards(mass: int, tasks: int) -> int:
    """Hash partitions for ``mass`` occurrences: none gets more than about ``MASS`` of them, however few tasks are asked for."""
    return max(1, -(-mass // MASS), min(tasks, -(-mass // FEW)))


def survivors(messages: DataFrame, turn: int, threshold: int) -> DataFrame:
    """The answers of every hash partition: for each message the places of those keys that may occur ``threshold`` times over all blocks."""

    def summarise(group: pa.Table) -> pa.Table:
        sent = list(zip(*(group.column(c).to_pylist() for c in ("block", "keys", "counts"))))
        mass = sum(group.column("mass").to_pylist())
        summary, held, waiting = Summary(SPARE * (mass // threshold) + 1), 0, []
        for i, (_, keys, counts) in enumerate(sent):
            waiting.append((_risen(keys), _wide(counts)))
            held += len(waiting[-1][1])
            if held >= HELD or i + 1 == len(sent):
                summary.merge(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
                held, waiting = 0, []
        alive = summary.survivors(threshold)
        out = []
        for block, keys, _ in sent:
            mine = _risen(keys).astype(np.uint32)
            place = np.searchsorted(alive, mine)
            hit = np.flatnonzero(alive[np.minimum(place, max(0, len(alive) - 1))] == mine) if len(alive) else place[:0]
            if len(hit):
                out.append({"block": block, "round": turn, "part": group.column("part")[0].as_py(), "places": _rising(hit.astype(np.uint64))})
        return pa.Table.from_pylist(out, schema=ANSWER)

    return messages.groupBy("part").applyInArrow(summarise, _sql(ANSWER))


def _answered(answers: pa.Table, turn: int) -> list[tuple[int, bytes]]:
    return [(p, places) for r, p, places in zip(*(answers.column(c).to_pylist() for c in ("round", "part", "places"))) if r == turn]


def frequent(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every phrase of one to five words with f >= threshold, stored, and (lang, n) of every language."""
    spark = docs.sparkSession
    cut = blocks(docs)
    totals = cut.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n").alias("n"))
    words = cut.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0

    pairs, longer, home = (shards(k * words, partitions(spark)) for k in (2, LONGEST - 2, 1))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                levels = Block.read(row).levels()
                yield from _messages(row["block"], Sent([next(levels), next(levels)], pairs)).to_batches()

    def replay(row: dict, answers: pa.Table) -> tuple[Block, list[Level], Iterator[Level]]:
        """The first two levels as they were sent, with their marks, and the longer ones to come."""
        block = Block.read(row)
        levels = block.levels()
        short = [next(levels), next(levels)]
        Sent(short, pairs).told(_answered(answers, 1))
        return block, short, levels

    def second(left: pa.Table, answers: pa.Table) -> pa.Table:
        made = [MESSAGE.empty_table()]
        for row in left.to_pylist():
            _, _, longest = replay(row, answers)
            made.append(_messages(row["block"], Sent(list(longest), longer)))
        return pa.concat_tables(made)

    def spell(left: pa.Table, answers: pa.Table) -> pa.Table:
        """The survivors of a block in words, with its counts, packed for each partition by hash; no phrase holds a line end."""
        made = []
        for row in left.to_pylist():
            block, short, longest = replay(row, answers)
            longest = list(longest)
            Sent(longest, longer).told(_answered(answers, 2))
            some = [(lv, np.flatnonzero(lv.may)) for lv in [*short, *longest]]
            phrases = [b" ".join(map(block.words.__getitem__, w)) for lv, mine in some for w in lv.spelled[mine].tolist()]
            lang = np.concatenate([block.lang[lv.spelled[mine, 0]] for lv, mine in some])
            count = np.concatenate([lv.count[mine] for lv, mine in some])
            part = (np.concatenate([lv.hashes[mine] for lv, mine in some]) >> np.uint64(32)) * np.uint64(home) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            begin = np.searchsorted(part[order], np.arange(home + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(begin)).tolist():
                mine = order[begin[p] : begin[p + 1]]
                made.append({"part": p, "langs": block.langs, "lang": _narrow(lang[mine]), "phrases": b"\n".join([phrases[k] for k in mine.tolist()]), "counts": _narrow(count[mine])})
        return pa.Table.from_pylist(made, schema=SPELLED)

    def add(group: pa.Table) -> pa.Table:
        """Exact counts of the phrases of a partition, of those that are frequent."""
        total = PHRASE.empty_table().select(["lang", "phrase", "f"])
        for batch in group.to_batches(max_chunksize=64):
            told = [total]
            for langs, lang, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("langs", "lang", "phrases", "counts"))):
                names = pa.array(langs, pa.string()).take(pa.array(_wide(lang)))
                told.append(pa.table({"lang": names, "phrase": pa.array(phrases.split(b"\n"), pa.binary()).cast(pa.string()), "f": pa.array(_wide(counts))}))
            total = pa.concat_tables(told).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])
        total = total.filter(pc.greater_equal(total.column("f"), threshold))
        size = pc.add(pc.count_substring(total.column("phrase"), " "), 1)
        return pa.table([total.column("lang"), total.column("phrase"), size.cast(pa.int32()), total.column("f")], schema=PHRASE)

    def met(by: DataFrame, fn, schema: pa.Schema) -> DataFrame:
        place = by.select(F.col("block").alias("place"), "round", "part", "places")
        return cut.groupBy("block").cogroup(place.groupBy("place")).applyInArrow(fn, _sql(schema))

    short = stored(survivors(cut.mapInArrow(first, _sql(MESSAGE)), 1, threshold))
    long = survivors(met(short, second, MESSAGE), 2, threshold)
    both = stored(short.unionByName(long))
    return stored(met(both, spell, SPELLED).groupBy("part").applyInArrow(add, _sql(PHRASE))), totals


def quotient(a: Column, n: Column, left: Column, right: Column, scale: int = 1000) -> Column:
    """floor(scale * a * n / (left * right)) in exact decimals."""
    above = a.cast("decimal(16,0)") * n.cast("decimal(17,0)") * F.lit(scale).cast("decimal(4,0)")
    return F.call_function("div", above, left.cast("decimal(18,0)") * right.cast("decimal(18,0)"))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of two to five words of every language.

    Texts are taken whole, A-Z as a-z, cut into pieces at ``.,;:!?`` and line ends and these into words at spaces and tabs. A
    phrase is a candidate from ``threshold`` occurrences (overlapping ones count); its score is that of its lowest-scoring cut in two,
    floor(1000 * a * n / (l * r)), ties to the shortest first part. A candidate inside a longer one that has ``share`` percent of its occurrences
    or more is dropped. Null and empty texts hold nothing, a null lang is ``und``; doc_id and other columns are not read; repeated rows count
    each; no rows give none. Ties go by more occurrences, then by the phrase's bytes.
    """
    counts, totals = frequent(docs, threshold)
    several = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    word = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    halves = several.withColumn("k", k).select("lang", "phrase", "a", "k", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(word, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    scored = (
        halves.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .join(totals, "lang")
        .withColumn("score", quotient(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # Contiguous parts of two words or more of the longer candidates.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(word, i, n), " "))))
    inner = several.where("size > 2").select("lang", "a", F.explode(spans).alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
        .withColumn("rank", F.row_number().over(best).cast("long"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


@query(
    "op12_misra_gries_collocations",
    rf"""
    WITH p AS (
      SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents
    ), w AS (
      SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
    ), g AS (
      SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) t(k)
    ), f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {THRESHOLD}),
    h AS (
      SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS "left", array_to_string(w[k + 1:], ' ') AS "right" FROM c, range(1, {LONGEST}) t(k) WHERE k < size
    ), s AS (
      SELECT h.lang, h.phrase, h.a, h.k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * h.a * n.n) // (x.f::HUGEINT * y.f) AS score
      FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h."left" JOIN f y ON y.lang = h.lang AND y.phrase = h."right" JOIN n ON n.lang = h.lang
    ), lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
      SELECT lang, a, unnest(flatten(list_transform(range(2, size), lambda m: list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase
      FROM c
    ), longer AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM (
      SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * a
    ) WHERE rank <= {TOP}
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))
