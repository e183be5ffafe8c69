"""Language identification of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchstrata.llm.base import query, sliced, table

#: Documents of each language that the field is trained on (chosen by a hash), the bound on what the driver holds.
SAMPLE_DOCS = 250
#: Words of each sampled document that enter training, in spans spread over the whole text.
SAMPLE_WORDS = 240
#: Languages that can be learned; a label set over this is an error, not a cut.
MAX_LANGS = 200
#: Words of a training document's span; spans of different languages are put in one sequence, so that switches are learned.
SPAN = 20
#: Words of each language's lexicon.
LEXICON = 2000
EPOCHS, RATE, DECAY = 3, 0.2, 1e-6
#: Steps of a chain that are taken one after another; chains are cut into lanes of this length that advance side by side.
LANE = 128
#: Words whose scores a task remembers, and text bytes that the pipeline's stage labels at once.
REMEMBERED, LABELLED_BYTES = 300_000, 1 << 20
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs between white space in lower case; longer ones in parts of 40."""
    words = text.lower().split()
    if words and max(map(len, words)) > 40:
        return [w[i : i + 40] for w in words for i in range(0, len(w), 40)]
    return words


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(word: str) -> set[str]:
    """Affixes of up to four letters and n-grams of two and three, with word borders, and the whole word for the lexicon."""
    w = f"^{word}$"
    n = len(w)
    out = {w[i : i + 2] for i in range(n - 1)}
    out.update([w[i : i + 3] for i in range(n - 2)])
    out.update((w[:4], w[:5], w[-4:], w[-5:], f"={word}"))
    return out


def marginals(emit: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray, lane: int = LANE, pairs: bool = False):
    """Posterior of every label at every word, by forward-backward; with ``pairs`` the expected transitions, too.

    emit (n, L) and move (L, L), start (L) are logarithms; first marks the words that begin a text. All texts are one chain, in
    which the step into a first word goes from any label to the start scores. The chain is cut into lanes: products of the steps of
    all lanes advance together and give each lane its entry and exit messages, with which all lanes are then walked together.
    """
    n, size = emit.shape
    lane = max(1, min(lane, n))
    lanes = -(-n // lane)
    e = np.zeros((lanes * lane, size))
    e[:n] = emit
    flag = np.ones(lanes * lane, dtype=bool)
    flag[:n] = first
    e = np.exp(e - e.max(axis=1, keepdims=True)).reshape(lanes, lane, size)
    flag = flag.reshape(lanes, lane)
    m, s = np.exp(move - move.max()), np.exp(start - start.max())

    def step(alpha: np.ndarray, t: int) -> np.ndarray:
        """Rows of messages (lanes, ..., L) through step t of every lane."""
        f = flag[:, t].reshape(-1, *[1] * (alpha.ndim - 1))
        alpha = np.where(f, alpha.sum(axis=-1, keepdims=True) * s, alpha @ m) * e[:, t].reshape(lanes, *[1] * (alpha.ndim - 2), size)
        return alpha / alpha.sum(axis=tuple(range(1, alpha.ndim)), keepdims=True)

    whole = np.repeat(np.eye(size)[None] / size, lanes, axis=0)
    for t in range(lane):
        whole = step(whole, t)
    into, out = np.empty((lanes, size)), np.empty((lanes, size))
    message = np.full(size, 1 / size)
    for k in range(lanes):
        into[k] = message
        message = message @ whole[k]
        message /= message.sum()
    message = np.ones(size)
    for k in range(lanes - 1, -1, -1):
        out[k] = message
        message = whole[k] @ message
        message /= message.sum()
    forward = np.empty((lanes, lane, size))
    alpha = into
    for t in range(lane):
        forward[:, t] = alpha = step(alpha, t)
    post = np.empty_like(forward)
    expected = np.zeros((size, size))
    beta = out
    for t in range(lane - 1, -1, -1):
        post[:, t] = forward[:, t] * beta
        ahead = e[:, t] * beta
        if pairs:
            before = forward[:, t - 1] if t else into
            joint = before[:, :, None] * m * ahead[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += joint[~flag[:, t]].sum(axis=0)
        beta = np.where(flag[:, t][:, None], (ahead * s).sum(axis=1, keepdims=True), ahead @ m.T)
        beta /= beta.sum(axis=1, keepdims=True)
    post = post.reshape(-1, size)[:n]
    post /= post.sum(axis=1, keepdims=True)
    return (post, expected) if pairs else post


@dataclass
class Field:
    """Weights of a trained field; ``weights`` has a row for each feature of ``index``."""

    langs: list[str]
    index: dict[str, int]
    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scores": None}

    def emission(self, texts: list[list[str]]) -> np.ndarray:
        """Scores of every word of every text, from a bounded memory of words."""
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known, self.scores = {}, None
            new = set().union(*texts)
        if new:
            row, flat, sizes = self.index.get, [], []
            for w in new:
                found = [0, *filter(None, map(row, features(w)))]
                flat += found
                sizes.append(len(found))
            sums = np.add.reduceat(self.weights[flat], np.cumsum([0, *sizes[:-1]]), axis=0)
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new))))
            self.scores = sums if self.scores is None else np.concatenate((self.scores, sums))
        get = self.known.__getitem__
        return self.scores[np.fromiter((get(w) for t in texts for w in t), dtype=np.int64, count=sum(map(len, texts)))]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The label with the most words' posterior, and its share; ``und`` and 0 without a letter. Whole texts, whatever their length."""
        split = [words_of(t) if t and has_letter(t) else [] for t in texts]
        some = [w for w in split if w]
        if not some:
            return [(UNKNOWN, 0.0)] * len(texts)
        counts = np.asarray([len(w) for w in some])
        first = np.zeros(counts.sum(), dtype=bool)
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        first[begin] = True
        shares = np.add.reduceat(marginals(self.emission(some), first, self.move, self.start), begin, axis=0) / counts[:, None]
        best = iter(zip(shares.argmax(axis=1).tolist(), np.minimum(shares.max(axis=1), 1.0).tolist()))
        return [(self.langs[(b := next(best))[0]], b[1]) if w else (UNKNOWN, 0.0) for w in split]


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Field:
    """A field from (text, language) rows, by stochastic gradients of the chain's log-likelihood.

    Training sequences are spans of the texts in mixed order, so both staying and switching are seen.
    """
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    number = {g: i for i, g in enumerate(langs)}
    spans, counts = [], [Counter() for _ in langs]
    for text, lang in rows:
        words = words_of(text)
        counts[number[lang]].update(words)
        cuts = [words[i : i + SPAN] for i in range(0, len(words), SPAN)]
        if len(cuts) * SPAN > SAMPLE_WORDS:
            cuts = [cuts[i] for i in sorted(rng.choice(len(cuts), SAMPLE_WORDS // SPAN, replace=False))]
        # Some short spans, for switches after a few words.
        spans += [(c[a : a + k], number[lang]) for c in cuts for k in [int(rng.choice([3, SPAN, SPAN]))] for a in range(0, len(c), k)]
    lexicon = {w for c in counts for w, n in c.most_common(LEXICON) if n > 1}
    vocab = sorted({w for s, _ in spans for w in s})
    made = [sorted(f for f in features(w) if f[0] != "=" or w in lexicon) for w in vocab]
    # Row 0 stands for any word; the others are the features of the sampled words.
    index = {f: i for i, f in enumerate(sorted({f for fs in made for f in fs}), 1)}
    model = Field(langs, index, np.zeros((1 + len(index), len(langs))), np.zeros((len(langs), len(langs))), np.zeros(len(langs)))
    if len(langs) < 2:
        return model
    at = {w: i for i, w in enumerate(vocab)}
    rows_of = [np.asarray([0, *(index[f] for f in fs)]) for fs in made]
    size_w, size_m, size_s = np.full(model.weights.shape, 1e-3), np.full(model.move.shape, 1e-3), np.full(model.start.shape, 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(spans))
        for k in range(0, len(order), 128):
            some = [spans[i] for i in order[k : k + 128]]
            ids = np.asarray([at[w] for s, _ in some for w in s])
            gold = np.repeat([g for _, g in some], [len(s) for s, _ in some])
            first = np.zeros(len(ids), dtype=bool)
            first[np.concatenate(([0], np.cumsum([len(s) for s, _ in some])[:-1]))[::4]] = True
            unique, back = np.unique(ids, return_inverse=True)
            feats = [rows_of[i] for i in unique]
            lengths = np.asarray([len(f) for f in feats])
            flat = np.concatenate(feats)
            emit = np.add.reduceat(model.weights[flat], np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0)[back]
            post, expected = marginals(emit, first, model.move, model.start, lane=24, pairs=True)
            wrong = -post
            wrong[np.arange(len(ids)), gold] += 1
            per_word = np.zeros((len(unique), len(langs)))
            np.add.at(per_word, back, wrong)
            grad = np.repeat(per_word, lengths, axis=0)
            touched, where = np.unique(flat, return_inverse=True)
            g = np.zeros((len(touched), len(langs)))
            np.add.at(g, where, grad)
            g -= DECAY * model.weights[touched]
            size_w[touched] += g * g
            model.weights[touched] += RATE * g / np.sqrt(size_w[touched])
            seen = np.zeros_like(expected)
            inner = np.flatnonzero(~first)
            np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
            g = seen - expected
            size_m += g * g
            model.move += RATE * g / np.sqrt(size_m)
            g = np.bincount(gold[first], minlength=len(langs)) - post[first].sum(axis=0)
            size_s += g * g
            model.start += RATE * g / np.sqrt(size_s)
    model.weights = model.weights.astype(np.float32)
    return model


def train(labelled: DataFrame, docs_per_lang: int = SAMPLE_DOCS) -> Field | None:
    """A field from the labelled rows (doc_id, text, lang); null if none has a text and a language.

    The ``docs_per_lang`` different rows of each language with the smallest hash of doc_id (then of text) are taken, whatever rows repeat an id;
    they are chosen by hashes in the executors, in one pass, and fetched in another.
    """
    usable = labelled.where("lang is not null and text is not null and doc_id is not null")
    key = ["lang", "doc_id", "t"]
    hashed = usable.select("lang", "doc_id", F.xxhash64("text").alias("t"), F.xxhash64("doc_id").alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    # Repeated rows are one before they are ranked, so they don't take others' places.
    chosen = hashed.groupBy(*key, "h").agg(F.lit(1).alias("one")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_lang).select(key)
    wanted = chosen.collect()
    langs = sorted({r.lang for r in wanted})
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return None
    told = labelled.sparkSession.createDataFrame([tuple(r) for r in wanted], chosen.schema)
    rows = usable.withColumn("t", F.xxhash64("text")).join(F.broadcast(told), key).dropDuplicates(key).select("lang", "doc_id", "text").collect()  # at most docs_per_lang of each
    return fit([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text)) if has_letter(r.text)] or [("", langs[0])])


def identify(docs: DataFrame, model: Field | None, keep: list[str] = ()) -> DataFrame:
    """lang_pred and score of each row from its text alone, with the columns of ``keep``.

    ``und`` with score 0 for a null text, one without a letter, and every text if nothing could be learned. Repeated rows are kept, an
    empty table gives no rows, and only text and the columns of ``keep`` are read, so others can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(*keep, "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            found = shared.value.predict(texts) if shared.value else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=[*keep, "lang_pred", "score"]
            )

    return picked.mapInArrow(each, ", ".join([*(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"]))


def known_language(docs: DataFrame, model: Field | None) -> DataFrame:
    """The rows in which a language is found, with the columns of ``docs``; a null lang becomes the one that was found.

    Null texts and those without a letter go. Without a model (no labelled row to learn from) only they go, and lang stays. Repeated rows are
    kept; an empty table gives none. Only the text goes through Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: pd.Series) -> pd.Series:
        part = np.cumsum([len(t or "") for t in texts]) // LABELLED_BYTES
        out: list = []
        for _, some in texts.groupby(part):
            some = some.tolist()
            out += [f[0] for f in shared.value.predict(some)] if shared.value else [None if t and has_letter(t) else UNKNOWN for t in some]
        return pd.Series(out, dtype=object)

    found = F.pandas_udf(label, "string").asNondeterministic()  # asked once a row
    name = "__" + "_".join(sorted(docs.columns))  # no column of docs
    kept = docs.withColumn(name, found(F.coalesce("text", F.lit("")))).where(F.coalesce(name, F.lit("")) != UNKNOWN)
    if "lang" in docs.columns:
        kept = kept.withColumn("lang", F.coalesce("lang", name))
    return kept.select(docs.columns)


def third() -> F.Column:
    """Remainder by three of the crc32 of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


@query("op8_crf_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(third() != 1))
    return identify(docs.withColumn("held_out", third() == 1), model, ["doc_id", "held_out"])
