"""Matching-block similarity of many pairs of texts at once: a bound from character counts, and the exact ratio."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Length of the second text from which very common characters are left out of the search for blocks; such pairs are solved one by one.
LONG = 200
#: Elements of the comparison matrices held at once.
ELEMENTS = 1 << 20


def _codes(texts: list[str], width: int, blank: int) -> np.ndarray:
    """Code points of the texts, one row each, filled up with ``blank``."""
    out = np.full((len(texts), width), blank, dtype=np.int32)
    for row, t in zip(out, texts):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<i4")
    return out


def bounds(a: list[str], b: list[str]) -> np.ndarray:
    """What each ratio is at most: twice the characters that both texts hold, by both lengths."""
    sizes = np.asarray([len(x) + len(y) for x, y in zip(a, b)])
    side = np.repeat(np.tile([0, 1], len(sizes)), [n for x, y in zip(a, b) for n in (len(x), len(y))])
    pair = np.repeat(np.arange(len(sizes)), sizes)
    sign = np.frombuffer("".join(x + y for x, y in zip(a, b)).encode("utf-32-le", "surrogatepass"), dtype="<i4").astype(np.int64)
    key, where = np.unique(pair << 32 | sign, return_inverse=True)
    both = np.minimum(np.bincount(where, side == 0, len(key)), np.bincount(where, side == 1, len(key)))
    shared = np.bincount(key >> 32, both, len(sizes))
    return np.where(sizes > 0, 2.0 * shared / np.maximum(sizes, 1), 1.0)


def _longest(a: np.ndarray, b: np.ndarray, rows: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each window of a pair the longest common block: (begin in a, begin in b, length), the first in a and then in b of equal ones."""
    wide, high = int((bhi - blo).max()), int((ahi - alo).max())
    at = np.minimum(blo[:, None] + np.arange(wide), b.shape[1] - 1)
    right = np.where(np.arange(wide) < (bhi - blo)[:, None], b[rows[:, None], at], -3)
    run = np.zeros((len(rows), wide + 1), dtype=np.int32)
    size, end_a, end_b = np.zeros(len(rows), dtype=np.int64), alo.copy(), blo.copy()
    each = np.arange(len(rows))
    for i in range(high):
        inside = alo + i < ahi
        sign = np.where(inside, a[rows, np.minimum(alo + i, a.shape[1] - 1)], -4)
        run[:, 1:] = np.where(right == sign[:, None], run[:, :-1] + 1, 0)
        j = run.argmax(axis=1)
        longer = run[each, j] > size
        size[longer], end_a[longer], end_b[longer] = run[each, j][longer], (alo + i + 1)[longer], (blo + j)[longer]
    return end_a - size, end_b - size, size


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair: the longest block, then those to its left and to its right, and so on."""
    x, y = _codes(a, max(1, *map(len, a)), -1), _codes(b, max(1, *map(len, b)), -2)
    total = np.zeros(len(a), dtype=np.int64)
    zero = np.zeros(len(a), dtype=np.int64)
    windows = (np.arange(len(a)), zero, np.asarray([len(t) for t in a]), zero, np.asarray([len(t) for t in b]))
    while True:
        open_ = (windows[1] < windows[2]) & (windows[3] < windows[4])
        windows = tuple(w[open_] for w in windows)
        if not len(windows[0]):
            return total
        # Windows of like size are compared together.
        order = np.lexsort((windows[2] - windows[1], windows[4] - windows[3]))
        windows, found = tuple(w[order] for w in windows), []
        step = max(1, ELEMENTS // int((windows[4] - windows[3]).max() + 1))
        for k in range(0, len(order), step):
            found.append(_longest(x, y, *(w[k : k + step] for w in windows)))
        i, j, n = (np.concatenate(f) for f in zip(*found))
        hit = n > 0
        rows, alo, ahi, blo, bhi = (w[hit] for w in windows)
        i, j, n = i[hit], j[hit], n[hit]
        np.add.at(total, rows, n)
        windows = tuple(np.concatenate(p) for p in ((rows, rows), (alo, i + n), (i, ahi), (blo, j + n), (j, bhi)))


def ratios(a: list[str], b: list[str], least: np.ndarray | None = None) -> np.ndarray:
    """Twice the matched characters by both lengths, 1 for two empty texts; the order of the two matters.

    Repeated pairs are solved once. With ``least`` a pair whose bound is below it gets its bound instead of its ratio.
    """
    if not a:
        return np.empty(0)
    places: dict[tuple[str, str], int] = {}
    where = np.asarray([places.setdefault(p, len(places)) for p in zip(a, b)])
    a, b = map(list, zip(*places))
    out = bounds(a, b)
    wanted = np.ones(len(out), dtype=bool)
    if least is not None:
        lowest = np.full(len(out), np.inf)
        np.minimum.at(lowest, where, least)
        wanted = out >= lowest
    long = np.asarray([len(t) >= LONG or len(s) >= 5 * LONG for s, t in zip(a, b)])
    some = np.flatnonzero(wanted & ~long & (out > 0))
    if len(some):
        sizes = np.asarray([len(a[k]) + len(b[k]) for k in some])
        out[some] = 2.0 * matched([a[k] for k in some], [b[k] for k in some]) / np.maximum(sizes, 1)
        out[some[sizes == 0]] = 1.0
    for k in np.flatnonzero(wanted & long):
        out[k] = SequenceMatcher(None, a[k], b[k]).ratio()
    return out[where]
