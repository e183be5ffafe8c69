"""Scores of texts by a weighted backoff automaton over smoothed word n-grams (unigrams and bigrams).

The automaton's states are the word that was read last, and a root that stands for no word. A state has an arc for each word that
followed it in training, and a failure arc to the root, which has an arc for every word. A text is read once, left to right: at
each token the state's arc is taken, or the failure arc and then the root's, and their log-probabilities add up.

The counts are exact over all training documents. Tasks count the n-grams of blocks of documents; the keys travel to shards
by hash, packed; a shard adds up the counts of its keys over all blocks and sends each block the totals of the keys it holds.
A block's own part of the automaton is then all that its texts can touch. Nothing of the corpus meets in one place but a few sums.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from matchstrata.core import _ensure_checkpoint_dir
from matchstrata.llm.base import query, sliced, table, texts

#: Text bytes of a block: what a task turns into an automaton at once.
BLOCK_BYTES = 8 << 20
#: Added to every count of the base model, and of the root's arcs.
ADDED = 0.1
#: How the pseudo-counts of a state grow with its count: as a rule the kinds of words that follow do.
GROWTH = 0.7
#: The end of a text as a word's hash; no word hashes to it but by a collision of 64 bits.
END = 0x9E3779B97F4A7C15
WORDS, PAIRS = 0, 1
ANSWER = "block long, kind int, shard int, counts binary, kinds long, total long, grown double"


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training: crc32 of its id as text, mod 10, is 0. A document without id is trained on."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Block:
    """The tokens of some texts: distinct words with their hashes, distinct adjacent pairs, and where in these each token is.

    Tokens are runs of anything but ASCII white space with A-Z as a-z, and one end per text.
    """

    def __init__(self, texts: list[str]):
        words: dict[bytes, int] = {b" ": 0}  # no word holds a space: the end
        ids, sizes = [], []
        for text in texts:
            some = text.encode("utf-8", "surrogatepass").lower().split()
            for w in some:
                if w not in words:
                    words[w] = len(words)
            ids.append(np.fromiter(map(words.__getitem__, some), dtype=np.int64, count=len(some)))
            sizes.append(len(some) + 1)
        self.sizes = np.asarray(sizes, dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.ends = self.begin + self.sizes - 1
        self.token = np.zeros(self.sizes.sum(), dtype=np.int64)
        inner = np.ones(len(self.token), dtype=bool)
        inner[self.ends] = False
        self.token[inner] = np.concatenate(ids) if ids else []
        self.words = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in words), dtype=np.uint64, count=len(words))
        self.words[0] = END
        # A text begins in the state of the end.
        state = np.empty_like(self.token)
        state[1:] = self.token[:-1]
        state[self.begin] = 0
        self.state = state
        pair, self.arc = np.unique(state << 32 | self.token, return_inverse=True)
        self.pair_state, self.pair_word = pair >> 32, pair & 0xFFFFFFFF
        a, b = self.words[self.pair_state], self.words[self.pair_word]
        h = (a ^ (b >> np.uint64(32) | b << np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + b
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.pairs = h ^ (h >> np.uint64(32))

    def keys(self, kind: int, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """For every shard the positions of its keys, in rising order of the keys; a key's shard is its place in the range of hashes."""
        key = self.words if kind == WORDS else self.pairs
        order = np.argsort(key)
        shard = (key[order] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
        for s in range(shards):
            yield s, order[cuts[s] : cuts[s + 1]]

    def trained(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and each pair stands in the texts that are trained on."""
        use = np.repeat(train, self.sizes)
        return np.bincount(self.token[use], minlength=len(self.words)), np.bincount(self.arc[use], minlength=len(self.pairs))


class Automaton:
    """The part of the model that a block's texts can touch: counts of its words (of the root's arcs) and of its pairs (of its states' arcs)."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, total: int, kinds: int, scale: float):
        self.root = np.log10((words + ADDED) / (total + ADDED * (kinds + 1)))
        mass = scale * np.power(words.astype(float), GROWTH)
        below = words + mass
        with np.errstate(divide="ignore", invalid="ignore"):
            # A state that training never saw has no arcs but the failure arc.
            self.failure = np.where(words > 0, np.log10(mass / below), 0.0)
            seen = (pairs + mass[block.pair_state] * np.power(10, self.root[block.pair_word])) / below[block.pair_state]
            self.arcs = np.where(pairs > 0, np.log10(seen), np.nan)

    def score(self, block: Block) -> np.ndarray:
        """Log10 probability of every text, its end included."""
        arc = self.arcs[block.arc]
        step = np.where(np.isnan(arc), self.failure[block.state] + self.root[block.token], arc)
        return np.add.reduceat(step, block.begin)

    def base(self, block: Block) -> np.ndarray:
        return np.add.reduceat(self.root[block.token], block.begin)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, Block]]:
    """Blocks of a task's rows with an id that another run of the same task gives again."""
    for k, batch in enumerate(sliced(gathered(batches), limit=BLOCK_BYTES)):
        yield TaskContext.get().partitionId() << 32 | k, batch.column("doc_id").to_pylist(), Block(batch.column("text").to_pylist())


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Larger batches of about a block from small ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest takes; the first byte tells how many."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def _rising(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys as their first one and the steps, in as few whole bytes each as the largest step takes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _risen(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=np.uint64)
    width = data[0]
    steps = np.zeros(((len(data) - 9) // width, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate((np.frombuffer(data, "<u8", 1, 1), steps.reshape(-1).view("<u8"))), dtype=np.uint64)


def count(docs: DataFrame, shards: int) -> DataFrame:
    """The answer of every shard to every block: the training counts of the block's keys, in the order it sent them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, block in blocks(batches):
            counts = block.trained(np.asarray([not held_out(d) for d in ids]))
            for kind, key in ((WORDS, block.words), (PAIRS, block.pairs)):
                rows = [(s, _rising(key[at]), _narrow(counts[kind][at])) for s, at in block.keys(kind, shards) if len(at)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([number] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))],
                    names=["shard", "kind", "block", "keys", "counts"],
                )

    def add(group: pa.Table) -> pa.Table:
        sent = [_risen(k) for k in group.column("keys").to_pylist()]
        counts = np.concatenate([_wide(c) for c in group.column("counts").to_pylist()])
        keys, back = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)
        upto, answers = 0, []
        for s in sent:
            answers.append(_narrow(total[back[upto : upto + len(s)]]))
            upto += len(s)
        n = len(sent)
        # The sums of a shard come with its first answer.
        only = [1] + [0] * (n - 1)
        seen = total[total > 0]
        return pa.table(
            {
                "block": group.column("block"), "kind": group.column("kind"), "shard": group.column("shard"), "counts": pa.array(answers, pa.binary()),
                "kinds": pa.array([x * len(seen) for x in only], pa.int64()), "total": pa.array([x * int(seen.sum()) for x in only], pa.int64()), "grown": pa.array([x * float(np.power(seen.astype(float), GROWTH).sum()) for x in only]),
            }
        )

    sent = texts(docs).mapInArrow(send, "shard int, kind int, block long, keys binary, counts binary")
    return sent.groupBy("kind", "shard").applyInArrow(add, ANSWER)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; a null text is empty, its one token the end.

    Without a training document all counts are 0 and every token has the base's share. Repeated rows are kept, and each counts.
    ``docs`` is read twice and must come in the same partitions both times, as a scan of a table does; a task that finds other rows than
    it counted stops the run. The model is a distribution: in each state the arcs and what the failure arc lets through add up to one.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{_ensure_checkpoint_dir(spark)}/counts-{uuid.uuid4().hex}"
    answers = count(docs, shards)
    answers.withColumn("task", (F.col("block") / F.lit(1 << 32)).cast("long")).repartition("task").sortWithinPartitions("task", "block", "kind", "shard").write.partitionBy("task").parquet(folder)
    sums = {r.kind: r for r in spark.read.schema("kind int, kinds long, total long, grown double").parquet(folder).groupBy("kind").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total"), F.sum("grown").alias("grown")).collect()}
    total = sums[WORDS].total if sums else 0
    kinds = sums[WORDS].kinds if sums else 0
    # The pseudo-counts of all states together are the number of kinds of pairs.
    scale = sums[PAIRS].kinds / sums[WORDS].grown if sums and sums[WORDS].grown else 1.0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        mine = None
        for number, ids, block in blocks(batches):
            if mine is None:
                mine = pads.dataset(f"{root}/task={TaskContext.get().partitionId()}", filesystem=fs, format="parquet")
            told = mine.to_table(columns=["kind", "shard", "counts"], filter=pads.field("block") == number)
            by = {(k, s): c for k, s, c in zip(*(told.column(c).to_pylist() for c in ("kind", "shard", "counts")))}
            counts = []
            for kind, n in ((WORDS, len(block.words)), (PAIRS, len(block.pairs))):
                out = np.zeros(n, dtype=np.int64)
                for s, at in block.keys(kind, shards):
                    if len(at):
                        got = _wide(by[kind, s])
                        if len(got) != len(at):
                            raise RuntimeError("a block was read in another way than it was counted")
                        out[at] = got
                counts.append(out)
            model = Automaton(block, *counts, total, kinds, scale)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([held_out(d) for d in ids]), pa.array(block.sizes), pa.array(np.add.reduceat((counts[WORDS] > 0)[block.token].astype(np.int64), block.begin)),
                    pa.array(np.full(n, total, dtype=np.int64)), pa.array(model.base(block)), pa.array(model.score(block)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return texts(docs).mapInArrow(read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@query("op4_backoff_automaton")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
