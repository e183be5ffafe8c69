"""Operators' inner parts against brute force, without Spark."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchstrata.llm import bytepair, covertree, langid, maxscore, packing, simhash
from matchstrata.llm.components import forest
from matchstrata.llm.eliasfano import EliasFano
from matchstrata.llm.vocabulary import encoder

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
AWKWARD = ["", " ", "\n\n", "a\x1cb c\x85d", "it's don't ’s ΣΑΣ ﬁ", "x" * 5000, "Á éx 12a34 ...!? <|endoftext|> İI", "日本語 テスト", "-" * 777, "ab" * 1000, "bbbb bbbbb"]


def pair():
    return bytepair.coder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pair().ranks, special_tokens={})


def test_byte_pairs_equal_the_library(library):
    rng = random.Random(2)
    parts = ["a", "b", "e", "t", "h", "er", "in", "  ", "1", "é", "日", "-", "=", "_", "\n", " ", "'s", "ing", "tion", "th"]
    texts = AWKWARD + ["".join(rng.choice(parts[: rng.choice([3, 8, 20])]) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    for text, got in zip(texts, pair().encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text)
        assert pair().decode(got) == text.encode()


def test_byte_pair_appends_and_edits_equal_a_new_encoding():
    rng, p = random.Random(3), pair()
    parts = ["a", "b", "th", "er", "tion", "é", "-", "1"]
    for _ in range(100):
        data = "".join(rng.choice(parts) for _ in range(rng.randint(1, 200))).encode()
        last = p.extend(data, [])
        start = rng.randint(0, len(data))
        stop = min(len(data), start + rng.randint(0, 5))
        new = rng.choice(parts).encode()
        out, found = p.edit(data, last, start, stop, new)
        assert out == data[:start] + new + data[stop:] and found == p.extend(out, [])
        assert p.append(data, last, new)[1] == p.extend(data + new, [])


def test_chunks_equal_the_library():
    e = encoder(WORDS)
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in e.tokenizer.encode_batch(AWKWARD, add_special_tokens=False)]
    assert e.encode(AWKWARD) == want and e.encode(AWKWARD) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=700))
def test_elias_fano_round_trip(values):
    v = np.sort(np.asarray(values, dtype=np.uint64))
    e = EliasFano.from_bytes(EliasFano.of(v).to_bytes())
    assert (e.select(np.arange(len(v))) == v).all()
    with pytest.raises(IndexError):
        e.select(np.asarray([len(v)]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_packing_plan_holds_every_length_and_fits(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    back: dict[int, int] = {}
    for held, n in packing.plan(counts, 64):
        assert n > 0 and sum(a * b for a, b in held.items()) <= 64
        for a, b in held.items():
            back[a] = back.get(a, 0) + b * n
    assert back == counts


def test_packing_is_near_the_least_number():
    rng = random.Random(1)
    for spread in (3, 5, 7):
        lengths = [min(4096, max(1, int(rng.lognormvariate(spread, 1.2)))) for _ in range(5000)]
        kinds = packing.plan({n: lengths.count(n) for n in set(lengths)})
        assert sum(n for _, n in kinds) <= -(-sum(lengths) // 4096) * 1.01 + 1


@pytest.mark.parametrize("distance", [3, 4, 5])
def test_ring_loses_no_pair(distance):
    """Every pair within the distance has a start from which the chain passes, and meets in a key."""
    rng, ring = random.Random(4), simhash.Ring(distance)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, distance)):
            y ^= 1 << bit
        a, b = np.asarray([x], dtype=np.uint64), np.asarray([y], dtype=np.uint64)
        assert any(ring.linked(a, b, i)[0] for i in range(ring.m))
        own = {int(k[0]) for k, mine in ring.keys(a) if mine}
        near = {int(k[0]) for k, _ in ring.keys(b)}
        assert any(ring.linked(a, b, k >> 60 & 15)[0] for k in own & near)


def test_cover_trees_find_all_pairs():
    rng = np.random.default_rng(5)
    for d, k, noise in ((2, 3, 0.1), (8, 40, 0.12), (64, 5, 0.2), (64, 40, 0.0), (4, 1, 0.1)):
        x = covertree.units(np.repeat(rng.normal(size=(30, d)), k, 0) + rng.normal(size=(30 * k, d)) * noise)
        hit = x @ x.T >= 0.95
        np.fill_diagonal(hit, False)
        tree = covertree.CoverTree(x)
        assert sorted(tree.order.tolist()) == list(range(len(x)))
        one = covertree.Joined(x, x, 0.95, True)
        one.traverse(tree, tree)
        assert (one.n == hit.sum(axis=1)).all() and (one.roots() == forest(len(x), *np.nonzero(hit))).all()
        y, z = x[: len(x) // 2], x[len(x) // 2 :]
        two = covertree.Joined(y, z, 0.95, False)
        two.traverse(covertree.CoverTree(y), covertree.CoverTree(z))
        assert (two.n == (y @ z.T >= 0.95).sum(axis=1)).all() and (two.m == (y @ z.T >= 0.95).sum(axis=0)).all()


def test_max_score_equals_a_full_scan():
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, d = int(rng.choice([1, 3, 40, 900])), int(rng.choice([1, 4, 20, 64]))
        w = rng.integers(-6, 7, (n, d)) if trial % 2 else rng.integers(-100, 100, (n, d))
        ids = rng.permutation(n)
        held = maxscore.Postings(ids, w)
        for _ in range(4):
            q = w[rng.integers(n)]
            own = int(rng.integers(n))
            want = sorted((-int(x), int(v)) for v, x in zip(ids, w @ q) if v != own)[:5]
            assert [(-b, a) for a, b in held.search(q, own, 5)] == want


@pytest.mark.parametrize("n,lane", [(1, 128), (7, 3), (50, 8), (9, 128)])
def test_marginals_equal_plain_forward_backward(n, lane):
    rng = np.random.default_rng(n)
    emit, move, start = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = rng.random(n) < 0.3
    first[0] = True
    post, pairs = langid.marginals(emit, first, move, start, lane, pairs=True)
    want, expected = np.zeros((n, 3)), np.zeros((3, 3))
    cuts = [*np.flatnonzero(first), n]
    for a, c in zip(cuts, cuts[1:]):
        alpha, beta = [np.exp(start + emit[a])], [np.ones(3)]
        for t in range(a + 1, c):
            alpha.append((alpha[-1] @ np.exp(move)) * np.exp(emit[t]))
        for t in range(c - 1, a, -1):
            beta.insert(0, np.exp(move) @ (np.exp(emit[t]) * beta[0]))
        total = alpha[-1].sum()
        for t in range(c - a):
            want[a + t] = alpha[t] * beta[t] / total
        for t in range(1, c - a):
            expected += alpha[t - 1][:, None] * np.exp(move) * np.exp(emit[a + t]) * beta[t] / total
    assert np.allclose(post, want) and np.allclose(pairs, expected)


def test_code_switched_words_get_their_own_label():
    """A text of two languages is labelled word by word."""
    a = [("the of and that with from this which thing " * 6, "en")] * 12
    b = [("der die und nicht auf schicht zwischen gegen " * 6, "de")] * 12
    model = langid.fit(a + b)
    words = "the thing which from und nicht zwischen gegen".split()
    first = np.zeros(len(words), dtype=bool)
    first[0] = True
    post = langid.marginals(model.emission([words]), first, model.move, model.start)
    assert [model.langs[i] for i in post.argmax(axis=1)] == ["en"] * 4 + ["de"] * 4
    assert model.predict([None, "", "12 34", "the thing"])[:3] == [("und", 0.0)] * 3


def test_texts_that_spell_added_tokens_equal_the_library():
    texts = ["ab <|endoftext|> cd", "x<|endoftext|>y.<|startoftext|>", "<|ENDOFTEXT|> <|end oftext|>", "\n<|startoftext|>\t", *AWKWARD]
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert encoder(WORDS).encode(texts) == want


def test_elias_fano_selects_in_any_order():
    rng = np.random.default_rng(2)
    v = np.sort(rng.integers(0, 1 << 30, 50_000)).astype(np.uint64)
    e = EliasFano.of(v)
    for k in (rng.integers(0, len(v), 3000), np.asarray([49_999, 0, 0, 25_000]), np.arange(len(v))[::-1], np.arange(1000, 1400)):
        assert (e.select(k) == v[k]).all()


@pytest.mark.parametrize("noise", [0.0, 1e-7, 1e-5, 1e-4, 3e-4, 1e-3, 1e-2])
@pytest.mark.parametrize("single", [True, False])
def test_cover_trees_of_nearly_equal_vectors(noise, single):
    """Groups of copies with noise, and pairs of groups right at the threshold."""
    rng = np.random.default_rng(int(-np.log10(noise or 1)) + single)
    for d, sizes in ((64, (40, 400)), (64, (300, 900)), (2, (200,))):
        a, b = np.zeros(d), np.zeros(d)
        a[0] = 1.0
        b[0], b[1] = 0.95, np.sqrt(1 - 0.95**2)
        centres = [a, b][: len(sizes)]
        raw = np.concatenate([c + rng.normal(size=(n, d)) * noise / np.sqrt(d) for c, n in zip(centres, sizes)])
        x = covertree.units(raw.astype(np.float32) if single else raw)
        tree = covertree.CoverTree(x)
        one = covertree.Joined(x, x, 0.95, True)
        one.traverse(tree, tree)
        hit = x @ x.T >= 0.95
        # Pairs that double precision itself can't tell from the threshold may fall on either side.
        sure = np.abs(x @ x.T - 0.95) > 1e-14
        np.fill_diagonal(hit, False)
        assert (np.abs(one.n - hit.sum(axis=1)) <= (~sure).sum(axis=1)).all()
        if sure.all():
            assert (one.n == hit.sum(axis=1)).all() and (one.roots() == forest(len(x), *np.nonzero(hit))).all()
        half = len(x) // 2
        two = covertree.Joined(x[:half], x[half:], 0.95, False)
        two.traverse(covertree.CoverTree(x[:half]), covertree.CoverTree(x[half:]))
        assert (np.abs(two.n - hit[:half, half:].sum(axis=1)) <= (~sure[:half, half:]).sum(axis=1)).all()
