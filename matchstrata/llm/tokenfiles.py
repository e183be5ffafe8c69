"""Token ids as binary shards: a concatenated id array, and document boundaries in Elias-Fano form.

A shard is a file: magic, ids (little-endian, two bytes each if the vocabulary fits, else four), doc_ids (delta-coded as Elias-Fano,
nulls and repeats apart), boundaries (Elias-Fano of the offsets, first 0), and a footer with the places and the sums of these parts. Shards hold
documents in ascending doc_id order, and so do the shards among themselves; nothing but a row per shard reaches the driver.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from matchstrata.core import _ensure_checkpoint_dir
from matchstrata.llm.base import query, sliced, table, texts
from matchstrata.llm.eliasfano import EliasFano
from matchstrata.llm.vocabulary import encoder

MAGIC = b"IDSHARD1"
#: documents, documents without doc_id, first doc_id, ids, bytes of an id, length of the two coded parts, crc32 of the id array.
FOOTER = "<QQqQBQQI"
#: Ids, and documents, after which a task begins another shard; a longer document is in one shard with what stands before it.
SHARD_IDS, SHARD_DOCS = 32 << 20, 2 << 20
#: Ids, and documents, that a reader holds at once.
HELD, RUN = 8 << 20, 1 << 16
SHARD = "shard long, path string, documents long, tokens long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path on it; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Writer:
    """A shard file that grows by the ids of documents in ascending doc_id order."""

    def __init__(self, fs: pafs.FileSystem, name: str, kind: np.dtype):
        self.name, self.kind, self.tokens, self.documents, self.crc = name, kind, 0, 0, 0
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.nameless = 0
        self.out = fs.open_output_stream(name)
        self.out.write(MAGIC)

    def add(self, doc_ids: pa.Array, coded: list[bytes]) -> None:
        known = doc_ids.drop_null().to_numpy()
        self.nameless += len(doc_ids) - len(known)
        self.ids.append(known)
        self.sizes.append(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4)
        data = np.frombuffer(b"".join(coded), dtype="<u4").astype(self.kind).tobytes()
        self.crc = zlib.crc32(data, self.crc)
        self.out.write(data)
        self.documents, self.tokens = self.documents + len(coded), self.tokens + int(self.sizes[-1].sum())

    def close(self) -> None:
        known = np.concatenate(self.ids)
        first = int(known[0]) if len(known) else 0
        names = EliasFano.of((known - first).astype(np.uint64)).to_bytes()
        bounds = EliasFano.of(np.cumsum(np.concatenate(([0], *self.sizes)))).to_bytes()
        self.out.write(names + bounds + struct.pack(FOOTER, self.documents, self.nameless, first, self.tokens, self.kind.itemsize, len(names), len(bounds), self.crc) + MAGIC)
        self.out.close()


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of every text and ``end_id`` into shards of ``folder``; returns (shard, path, documents, tokens), one row each.

    A null or empty text is the end id alone; rows without doc_id come first; repeated doc_ids, and null ones, stand side by side and may
    fill many shards. A shard ends after so many ids or documents. A task writes under names of its own attempt, so a second attempt
    never touches what the first wrote, and only the rows that come back count. No documents give no shards.
    """
    near = ["doc_id", F.xxhash64("text")]
    spread = texts(docs).repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *near).sortWithinPartitions(*near)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, coder = TaskContext.get(), encoder(path)
        kind = np.dtype("<u2") if max(coder.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        end = np.asarray([end_id], dtype="<u4").tobytes()
        fs, root = _open(folder)
        done, writer = 0, None

        def finished() -> pa.RecordBatch:
            writer.close()
            row = (context.partitionId() << 32 | done, f"{folder}/{writer.name.rsplit('/', 1)[1]}", writer.documents, writer.tokens)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["shard", "path", "documents", "tokens"])

        for batch in sliced(batches):
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = _Writer(fs, f"{root}/shard-{context.partitionId():06d}-{done:04d}-{context.taskAttemptId()}.ids", kind)
            writer.add(batch.column("doc_id"), [e + end for e in coder.encode(batch.column("text").to_pylist())])
            if writer.tokens >= SHARD_IDS or writer.documents >= SHARD_DOCS:
                yield finished()
                done, writer = done + 1, None
        if writer is not None:
            yield finished()

    return spread.mapInArrow(save, SHARD)


class Shard:
    """A shard file that is open for reading."""

    def __init__(self, path: str):
        fs, name = _open(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(struct.calcsize(FOOTER) + len(MAGIC), size - struct.calcsize(FOOTER) - len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no id shard")
        self.documents, self.nameless, self.first, self.tokens, self.bytes, names, bounds, self.crc = struct.unpack_from(FOOTER, tail)
        at = len(MAGIC) + self.tokens * self.bytes
        self.names = EliasFano.from_bytes(self.file.read_at(names, at))
        self.bounds = EliasFano.from_bytes(self.file.read_at(bounds, at + names))

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        """doc_ids of documents start to stop (not included); the nameless ones come first."""
        known = self.names.select(np.arange(max(start, self.nameless), max(stop, self.nameless)) - self.nameless).astype(np.int64) + self.first
        return [None] * (min(stop, self.nameless) - min(start, self.nameless)) + known.tolist()

    def offsets(self, k: np.ndarray) -> np.ndarray:
        """Where documents k begin in the id array; k = documents gives its end."""
        return self.bounds.select(k).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        data = self.file.read_at((stop - start) * self.bytes, len(MAGIC) + start * self.bytes)
        return np.frombuffer(data, dtype=f"<u{self.bytes}").astype("<u4")


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files alone.

    ``shards`` are the rows that ``write`` returned, with a column ``before``, the ids of all earlier shards.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                at = 0
                while at < shard.documents:
                    bounds = shard.offsets(np.arange(at, min(at + RUN, shard.documents) + 1))
                    n = max(1, int(np.searchsorted(bounds, bounds[0] + HELD, side="right")) - 1)
                    bounds = bounds[: n + 1]
                    held = memoryview(shard.ids(int(bounds[0]), int(bounds[-1])).tobytes())
                    cuts = ((bounds - bounds[0]) * 4).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids(at, at + n), pa.int64()),
                            pa.array(bounds[:-1] + row["before"]),
                            pa.array(np.diff(bounds)),
                            pa.array([zlib.crc32(held[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at += n

    return shards.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> DataFrame:
    """The documents as ``read`` finds them in the shards that ``write`` made of them."""
    spark = docs.sparkSession
    rows = sorted(write(docs, folder, path, end_id).collect())  # one row per shard
    upto, told = 0, []
    for r in rows:
        told.append((r.shard, r.path, r.documents, r.tokens, upto))
        upto += r.tokens
    return read(spark.createDataFrame(told, f"{SHARD}, before long").repartition(max(1, len(told)), "shard"))


@query("op6_elias_fano_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{_ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    return written_and_read(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
