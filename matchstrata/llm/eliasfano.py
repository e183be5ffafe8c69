"""Elias-Fano coding of rising whole numbers: near-minimal space, and any of them by select."""

from __future__ import annotations

import struct

import numpy as np

#: Every so many ones a select sample is kept.
SAMPLE = 256
#: Ones in a byte, and the place of the k-th one of a byte.
_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)
_HEAD = struct.Struct("<QQBQQQ")


class EliasFano:
    """n values below or equal to ``top``: the low bits of each packed, the high parts as a unary bit string with select samples."""

    def __init__(self, n: int, top: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.width, self.low, self.high, self.samples = n, top, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        if len(v) > 1 and (v[1:] < v[:-1]).any():
            raise ValueError("values must not fall")
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        if width:
            bits = (v[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.reshape(-1), bitorder="little")
        else:
            low = np.empty(0, dtype=np.uint8)
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        string = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        string[ones] = 1
        # A sample is the byte that holds a one, and how many ones stand before that byte.
        high = np.packbits(string, bitorder="little")
        before = np.concatenate(([0], np.cumsum(_ONES[high])))
        at = ones[::SAMPLE] // 8
        return cls(n, top, width, low, high, np.stack((at, before[at]), axis=1).astype("<u4") if n else np.empty((0, 2), dtype="<u4"))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The values at positions k (any order): the k-th one of the high string, found from its sample, and its low bits."""
        k = np.asarray(k, dtype=np.int64)
        if not len(k):
            return np.empty(0, dtype=np.uint64)
        if k.min() < 0 or k.max() >= self.n:
            raise IndexError("no such position")
        order = np.argsort(k, kind="stable")
        group = k[order] // SAMPLE
        place = np.empty(len(k), dtype=np.int64)
        # Neighbouring groups are unpacked together, and each once.
        cuts = [0, *(np.flatnonzero(np.diff(group) > 1) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            start, ones = (int(x) for x in self.samples[group[a]])
            last = int(group[b - 1]) + 1
            stop = int(self.samples[last][0]) + 1 if last < len(self.samples) else len(self.high)
            found = np.flatnonzero(np.unpackbits(self.high[start:stop], bitorder="little"))
            mine = order[a:b]
            place[mine] = start * 8 + found[k[mine] - ones]
        value = (place - k).astype(np.uint64) << np.uint64(self.width)
        for b in range(self.width):
            at = k * self.width + b
            value |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return value

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.top, self.width, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, width, a, b, c = _HEAD.unpack_from(data)
        at = _HEAD.size
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, top, width, low, high, np.frombuffer(data, "<u4", 2 * c, at + a + b).reshape(-1, 2))
