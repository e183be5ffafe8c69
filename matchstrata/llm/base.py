"""Registry of the queries of this subpackage, and what several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

#: Text bytes that a task turns into Python objects at once.
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Entry:
    run: QueryFn
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    """Register a query under its key, with its SQL where SQL can express it."""

    def add(fn: QueryFn) -> QueryFn:
        if key in CATALOG:
            raise ValueError(f"query {key} registered twice")
        CATALOG[key] = Entry(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one; other columns can't clash with what an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; a longer row comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return value - (1 << 64) if value >> 63 else value
