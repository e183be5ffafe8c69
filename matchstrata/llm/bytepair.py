"""Byte-level pair encoding by prefix dynamic programming, and its decoding.

Every prefix of a piece has one valid last token: a token that ends there whose own start is a prefix whose last token stays apart from
it under the merges. So the encoding of a longer piece is that of a prefix with a few more steps (append), and an edit
keeps all prefixes before it and, once the last tokens line up again, all tokens behind it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from matchstrata.llm.base import query, sliced, table, texts

#: Pieces, and pairs of tokens, that a task remembers in each of two generations.
REMEMBERED, PAIRS = 200_000, 400_000
#: White space by Unicode; the pattern's \s stands for it, and the regex module's \s takes four control characters more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePair:
    """Encoder and decoder over a rank file; ``pattern`` cuts a text into pieces that are encoded apart."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s\p", rf"[^{SPACE}\p").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.longest = max(map(len, ranks))
        #: The two tokens whose merge makes a token (itself twice for a byte); tokens that no merges reach have none.
        self.made: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.made[rank] = (rank, rank)
            elif halves := self._halves(token, rank):
                self.made[rank] = halves
        self.joint = {pair: r for r, pair in self.made.items() if pair[0] != r}
        #: Tokens that end in given bytes, for the walk back from a prefix's end.
        self.usable = {t: r for t, r in ranks.items() if r in self.made}
        sizes: dict[bytes, set[int]] = {}
        for t in self.usable:
            sizes.setdefault(t[-2:], set()).add(len(t))
        self.suffix_sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        top = max(self.tokens) + 1
        self.token_size = np.zeros(top, dtype=np.int64)
        self.token_size[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.token_at = np.concatenate(([0], np.cumsum(self.token_size)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(top)), dtype=np.uint8)
        self.apart: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last merge of a token, found by merging its bytes with the ranks below its own."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                if (r := self.ranks.get(parts[i] + parts[i + 1], rank)) < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of two tokens' bytes is these two tokens.

        Walking back through the merges that made them, no pair that faces across the border may have a merge that comes
        before the merges that put its two sides into larger tokens.
        """
        key = left << 20 | right
        known = self.apart.get(key)
        if known is not None:
            return known
        made, joint = self.made, self.joint
        a, b = left, right
        # A side faces the border from the merge that made it until the merge that takes it in: its ``end``.
        end = 1 << 30
        while True:
            across = joint.get((a, b))
            if across is not None and across < end:
                answer = False
                break
            if a > b:  # the side made last is undone first; of equals that is the right one, as merges go from the left
                undo_left = made[a][0] != a
                undo_right = not undo_left and made[b][0] != b
            else:
                undo_right = made[b][0] != b
                undo_left = not undo_right and made[a][0] != a
            if undo_left:
                end, a = a, made[a][1]
            elif undo_right:
                # Pairs are merged from the left, so at b's own rank a merge across the border comes first.
                end, b = b + 1, made[b][0]
            else:
                answer = True
                break
        if len(self.apart) > PAIRS:
            self.apart.clear()
        self.apart[key] = answer
        return answer

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """The last token of every prefix of ``data``, given those of some first prefixes; ``last`` grows in place."""
        usable, sizes, tokens = self.usable, self.suffix_sizes, self.token_size
        apart, stay = self.apart, self.stay_apart
        for end in range(len(last) + 1, len(data) + 1):
            for n in sizes.get(data[max(0, end - 2) : end], ()):
                if n > end:
                    continue
                token = usable.get(data[end - n : end])
                if token is None:
                    continue
                if n == end:
                    last.append(token)
                    break
                before = last[end - n - 1]
                ok = apart.get(before << 20 | token)
                if ok if ok is not None else stay(before, token):
                    last.append(token)
                    break
            else:
                last.append(usable[data[end - 1 : end]])
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of a piece, from the last tokens of its prefixes."""
        out, end, size = [], len(last), self.token_size
        while end:
            token = last[end - 1]
            out.append(token)
            end -= int(size[token])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(self.extend(data, []))

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """A piece with bytes put to its end: the prefixes it had keep their last tokens."""
        return data + more, self.extend(data + more, list(last))

    def edit(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """A piece with data[start:stop] replaced: work begins at ``start`` and ends when the last tokens line up again.

        A prefix's last token hangs on the last tokens at most ``longest`` bytes before it, so once that many in a row equal those of
        the same bytes before the edit, all later ones do.
        """
        out = data[:start] + new + data[stop:]
        shift = len(new) - (stop - start)
        found, same = list(last[:start]), 0
        while len(found) < len(out):
            self.extend(out[: len(found) + 1], found)
            at = len(found) - 1 - shift
            same = same + 1 if at >= stop and found[-1] == last[at] else 0
            if same > self.longest:
                found += last[at + 1 :]
        return out, found

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces in sorted order; each begins with the prefixes that it shares with the one before."""
        held, last = b"", []
        for piece, data in sorted((p, p.encode("utf-8", "surrogatepass")) for p in pieces):
            whole = self.ranks.get(data)
            if whole is not None:
                self.young[piece] = whole.to_bytes(4, "little")
                continue
            n = min(len(held), len(data))
            while held[:n] != data[:n]:
                n -= 1
            del last[n:]
            self.extend(data, last)
            held = data
            self.young[piece] = np.asarray(self.walk(last), dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit bytes."""
        split = [self.pattern.findall(t) for t in texts]
        need = set().union(*split)
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for p in need:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
        if new:
            self._learn(new)
        get = young.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids (little-endian 32 bits each) stand for."""
        out = []
        every = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(every), 1 << 20):
            some = every[at : at + (1 << 20)]
            size = self.token_size[some]
            begin = np.cumsum(size) - size
            out.append(self.token_bytes[np.arange(size.sum()) + np.repeat(self.token_at[some] - begin, size)].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> BytePair:
    """One coder for each rank file and Python worker."""
    return BytePair(load_ranks(path), pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: its text encoded, and the ids decoded again.

    A null text is empty and has no ids; pieces of any length take time in proportion. Repeated rows are kept, further columns left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = coder(path, pattern)
        for batch in sliced(batches):
            coded = pair.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(pair.decode(c)).hexdigest() for c in coded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op2_prefix_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
