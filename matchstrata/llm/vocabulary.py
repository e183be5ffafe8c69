"""Token ids of whole texts by a public word-level vocabulary, from a bounded memory of chunks."""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Bytes, about, of the chunks remembered in each of two generations; the older one is dropped when the younger is full.
REMEMBERED_BYTES = 40 << 20
#: What a remembered string and its ids take besides their characters.
OVERHEAD = 180
#: Letters that are one code point in NFC and lower case alike, so that a run of them is one pre-token.
PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
#: Marks of which a run is one pre-token, whatever stands before it. Not the apostrophe, which begins some suffixes.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit bytes.

    The vocabulary drops white space, and its normaliser and pre-tokenizer never look across it, so a text's ids are those of
    its chunks between spaces; marks behind a plain letter that end a chunk are a chunk of their own. New chunks of plain letters
    go to the library in one text and are told apart by their word-end tokens, others one by one. Added tokens hold no white space
    and don't end in such marks, so a text that spells one out gets its id, as the library gives by default.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.bytes = 0
        self.plain = re.compile(f"[{PLAIN}]+").fullmatch
        mark = f"[{re.escape(MARKS)}]"  # looked for first, as a set of characters is found fast
        self.behind = re.compile(f"({mark}(?<=[{PLAIN}]{mark}){mark}*)(?= |$)")
        if any(self.behind.search(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("an added token ends in marks")

    def _learn(self, chunks: list[str]) -> None:
        plain = list(filter(self.plain, chunks))
        rest = [c for c in chunks if not self.plain(c)]
        # Case makes no difference to plain letters.
        small = dict(zip(plain, map(str.lower, plain)))
        known, old = self.young, self.old
        new = set(small.values()).difference(known)
        known.update((c, old[c]) for c in new.intersection(old))
        new = list(new.difference(known))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some):
                data, stops = ids.tobytes(), [0, *((last + 1) * 4).tolist()]
                known.update(zip(some, [data[a:b] for a, b in zip(stops, stops[1:])]))
            else:
                known.update(zip(some, self._alone(some)))
        known.update((c, known[low]) for c, low in small.items())
        known.update(zip(rest, self._alone(rest)))

    def _alone(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.behind.sub(r" \1", t.replace("\n", " ").replace("\t", " ").replace("\r", " ")).split(" ") for t in texts]
        if self.bytes > REMEMBERED_BYTES:
            self.old, self.young, self.bytes = self.young, {"": b""}, 0
        need = set().union(*split).difference(self.young)
        again = need.intersection(self.old)
        self.young.update((c, self.old[c]) for c in again)
        self._learn(list(need - again))
        self.bytes += sum(map(len, need)) * 5 + len(need) * OVERHEAD
        get = self.young.__getitem__
        return [b"".join(map(get, s)) for s in split]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker."""
    return ChunkEncoder(path)
