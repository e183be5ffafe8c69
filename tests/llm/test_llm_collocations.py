"""Collocations against brute force, and the guarantee of the summaries."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchstrata.llm import collocations

CLASH = "doc_id long, text string, lang string, phrase string, part int, block int, f int, size int, a int, n int, rank int"


def brute(rows, threshold, top=2000, share=100):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            for n in range(1, 6):
                f["und" if lang is None else lang].update(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        total = sum(v for k, v in c.items() if b" " not in k)
        several = {k: v for k, v in c.items() if v >= threshold and b" " in k}
        ranked = []
        for k, a in several.items():
            padded = b" " + k + b" "
            if any(len(o) > len(k) and padded in b" " + o + b" " and 100 * v >= share * a for o, v in several.items()):
                continue
            w = k.split(b" ")
            cuts = [(1000 * a * total // (c[b" ".join(w[:j])] * c[b" ".join(w[j:])]), j) for j in range(1, len(w))]
            score, j = min(cuts)
            ranked.append((-score, -a, k, c[b" ".join(w[:j])], c[b" ".join(w[j:])]))
        out += [(lang, i, k.decode(), -a, x, y, total, -s) for i, (s, a, k, x, y) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def awkward():
    rng = random.Random(4)
    words = ["the", "cat", "Sat", "on", "É", "mat", "a\x0bb", "new\xa0york", "x" * 300, "İ"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice([".", "\t", "\r\n", "; and  then\tsome"]), rng.choice(["en", "de", None, "und"])) for _ in range(400)]
    rows += [(None, "en"), ("", "fr"), (" \t\n", None), ("the cat " * 20_000, "en"), ("hot phrase here now and here", "en")] + [("hot phrase here now and here", "en")] * 300
    return rows


@pytest.mark.parametrize("threshold", [5, 100])
def test_collocations(spark, monkeypatch, threshold):
    # Small blocks and partitions, so that summaries merge and lose counts.
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(collocations, "FEW", 20_000)
    monkeypatch.setattr(collocations, "SPARE", 1)
    rows = awkward()
    docs = spark.createDataFrame([(i, t, g, *["x"], *[1] * 7) for i, (t, g) in enumerate(rows)], CLASH)
    got = collocations.collocations(docs, threshold)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, threshold)


def test_top_share_and_empty(spark):
    rows = awkward()
    docs = spark.createDataFrame([(i, t, g, *["x"], *[1] * 7) for i, (t, g) in enumerate(rows)], CLASH)
    assert sorted(map(tuple, collocations.collocations(docs, 5, 60, 7).collect())) == brute(rows, 5, 7, 60)
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.where("text is null")).collect() == []


def test_exact_quotients(spark):
    """Products past 64 bits."""
    rows = [(10**12, 10**16 + 7, 10**13 + 9, 10**14 + 3), (100, 10**15, 100, 100), (7, 9, 7, 7)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(collocations.quotient(*map(F.col, "anlr"))).collect()
    assert [r[0] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=8), st.integers(1, 30))
def test_summaries_never_lose_what_is_frequent(streams, capacity):
    every = collections.Counter(x for s in streams for x in s)
    mass = sum(every.values())
    whole = collocations.Summary(capacity)
    for s in streams:
        part = collocations.Summary(capacity)
        part.merge(np.asarray(s, dtype=np.uint32), np.ones(len(s), dtype=np.int64))
        whole.merge(part.keys, part.counts, part.lost)
    assert len(whole.keys) <= capacity and whole.lost <= mass / (capacity + 1)
    told = dict(zip(whole.keys.tolist(), whole.counts.tolist()))
    for x, n in every.items():
        assert told.get(x, 0) <= n <= told.get(x, 0) + whole.lost
    for threshold in (1, 3, 10):
        if capacity > mass / threshold:
            assert {x for x, n in every.items() if n >= threshold} <= set(whole.survivors(threshold).tolist())


def test_what_a_task_holds_does_not_grow_with_the_input(spark, tmp_path):
    """Few shuffle partitions make no larger hash partitions; a stored row group holds few blocks."""
    assert all(mass / collocations.shards(mass, 16) <= 1 << 22 for mass in (10**7, 10**8, 10**9, 10**10))
    assert collocations.shards(0, 200) == 1 and collocations.shards(3 << 20, 200) == 3
    import pyarrow.parquet as pq

    docs = spark.range(30).select(F.format_string("word%s ", "id").alias("w"), F.lit("en").alias("lang")).select(F.repeat("w", 320_000).alias("text"), "lang").coalesce(1)
    files = [f.removeprefix("file:").replace("///", "/") for f in collocations.blocks(docs).inputFiles()]
    held = [pq.ParquetFile(f).metadata.row_group(k).num_rows for f in files for k in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(held) >= 30 and max(held) <= collocations.GROUP
