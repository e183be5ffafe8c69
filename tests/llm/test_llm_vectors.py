"""Operators on vectors against brute force: nulls, repeats, ties, huge components, mixed lengths, empty tables, clashing columns."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchstrata.llm import hardneg, permindex

#: Columns that operators add themselves, or use inside.
CLASH = "vec_id long, label long, embedding array<double>, uid int, score int, number int, shard int, asks int, block int, dim int, rank int"


def frame(spark, rows, schema=CLASH):
    return spark.createDataFrame([(*r, *[1] * 8) for r in rows], schema)


def awkward(seed=0, n=160, d=6):
    """Clustered vectors with copies and opposite ones, then rows that can't take part, short ones and huge components."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    rows = [(i, int(rng.integers(3)), (centres[i % 5] + rng.normal(size=d) * rng.choice([0, 0.05, 0.6])).tolist()) for i in range(n)]
    rows += [(n, 1, None), (n + 1, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (n + 2, 2, [math.nan] * d), (n + 3, 0, [math.inf] * d), (n + 4, None, [1.0] * d), (None, 1, [1.0] * d)]
    rows += [(n + 5, 0, [0.0] * d), (n + 6, 1, []), (n + 7, 1, [0.5, 0.5]), (n + 8, 1, [0.6, 0.5]), (n + 9, 2, [0.4, 0.5]), (20, 1, [0.1] * d), (30, 0, centres[0].tolist()), (30, 0, centres[0].tolist())]
    rows += [(n + 10, 0, [4e6] * d), (n + 11, 0, [4e6] * d), (n + 12, 1, [2.8e6] * d), (n + 13, 2, [-1.1e6] * d)]
    return rows


def ints(v):
    return [math.floor(256 * x) for x in v]


def takes_part(r):
    return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])


def brute_negatives(rows, anchor):
    good = [(i, label, ints(v)) for i, label, v in rows if takes_part((i, label, v))]
    out = []
    for a, la, va in good:
        if anchor(a):
            scored = [(sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in good if len(v) == len(va)]
            ranked = sorted(scored, key=lambda s: (-s[0], s[1]))
            for ps, p, _ in [s for s in ranked if s[2] == la and s[1] != a][:5]:
                mined = [s for s in ranked if s[2] != la and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
                out += [(a, p, k, i, ps, s) for k, (s, i, _) in enumerate(mined, 1)]
    return out


@pytest.mark.parametrize("room", [1 << 15, 20])
def test_hard_negatives(spark, room):
    rows = awkward()
    got = hardneg.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, room=room).collect()
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)
    assert any(r[0] >= 160 for r in want) and len({r[0] for r in want}) > 20
    assert hardneg.hard_negatives(frame(spark, rows).limit(0), F.col("vec_id") % 5 == 0).collect() == []


def test_bounds_hold_the_score():
    rng = np.random.default_rng(1)
    for d in (2, 8, 64):
        base = rng.normal(size=(300, d))
        w = np.floor(256 * np.concatenate((base, base[:50] * 1.001, -base[:50], np.zeros((1, d)))))
        refs = hardneg.references([(d, (r / 256).tolist()) for r in w])[d]
        norm = np.sqrt((w * w).sum(axis=1))
        angles = np.arccos(np.clip(w / np.maximum(norm, 1)[:, None] @ refs.T, -1, 1)).astype("<f4")
        bounds = hardneg.Bounds(angles.astype(float), norm, d)
        for q in range(0, len(w), 7):
            score = w @ w[q]
            low, high = bounds.of(np.arange(len(w)), angles[q].astype(float), norm[q])
            assert (low <= score).all() and (score <= high).all()
            least = np.sort(score)[-5]
            assert set(np.flatnonzero(score >= least)) <= set(bounds.reachable(angles[q].astype(float), norm[q], least, math.inf).tolist())


def brute_nearest(rows, asks, k=20):
    good = [(i, np.asarray(v)) for i, _, v in rows if takes_part((i, 0, v)) and any(v)]
    out = {}
    for n, (q, v) in enumerate(good):
        if asks(q):
            scored = sorted(((-float((v * w).sum()), i) for i, w in good if i != q and len(w) == len(v)))
            out[n, q] = scored[:k]
    return out


def recall(got, want):
    """Share of the wanted neighbours that were found, by queries; scores tell copies apart from worse rows."""
    found = collections.defaultdict(list)
    for r in got:
        found[r.query_id].append((-r.score, r.vec_id))
    hits = sum(len({i for _, i in found[q]} & {i for _, i in w}) for (_, q), w in want.items())
    return hits / sum(len({i for _, i in w}) for w in want.values())


def test_nearest_on_an_awkward_table(spark, monkeypatch):
    rows = awkward(d=6)
    want = brute_nearest(rows, lambda i: i % 5 == 0)
    got = permindex.nearest(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()
    # So few rows have so few pivots that a query looks into all files, and these are reranked whole.
    assert recall(got, want) == 1
    by_query = collections.Counter(r.query_id for r in got)
    assert by_query == collections.Counter({q: sum(len(w) for (_, p), w in want.items() if p == q) for q in {q for _, q in want} if any(w for (_, p), w in want.items() if p == q)})
    vectors = {i: np.asarray(v) for i, _, v in rows if i is not None and v is not None and i not in (20, 30)}
    for r in got:
        if r.query_id in vectors and r.vec_id in vectors:
            assert r.score == pytest.approx(float(np.dot(vectors[r.query_id], vectors[r.vec_id])), rel=1e-12, abs=1e-12)
    few = permindex.nearest(frame(spark, rows), F.col("vec_id") % 5 == 0, room=16).collect()
    assert recall(few, want) == 1
    # Lengths that no sampled row has are compared whole.
    monkeypatch.setattr(permindex, "SAMPLE", 1)
    alone = permindex.nearest(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert recall(alone, want) == 1
    assert permindex.nearest(frame(spark, rows).limit(0), F.col("vec_id") % 5 == 0).collect() == []


def test_nearest_recall_and_ties(spark):
    """Spread-out directions, the worst case, and a hot group of copies: the smallest vec_ids of the copies come first."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:2000] = x[1000]
    rows = [(i, 1, v.tolist()) for i, v in enumerate(x)]
    got = permindex.nearest(frame(spark, rows, CLASH.replace("array<double>", "array<float>")), F.col("vec_id") % 50 == 0).collect()
    want = {}
    for q in range(0, 3000, 50):
        s = x.astype(float) @ x[q].astype(float)
        s[1000:2000] = s[1000]
        s[q] = -9
        want[q, q] = [(-s[i], i) for i in np.lexsort((np.arange(3000), -s))[:20].tolist()]
    assert recall(got, want) >= 0.95
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 1500), key=lambda r: r["rank"])] == list(range(1000, 1020))
