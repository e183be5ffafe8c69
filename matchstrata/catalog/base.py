"""Registry of runnable queries over the driver tables, each with an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFn
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    """Register a query; the key starts with the inventory ids it covers."""

    def add(fn: QueryFn) -> QueryFn:
        if key in CATALOG:
            raise ValueError(f"query {key} registered twice")
        CATALOG[key] = Entry(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
