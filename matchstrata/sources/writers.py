"""Write-once sinks, parameter files and scoped snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstrata.core import ContractError, require_empty


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Versioned output that fails when the target exists.

    The commit protocol publishes the whole output or nothing (S12).
    """
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_raster(cells: DataFrame, path: str) -> None:
    """Raster table laid out by pollutant and date, one shuffle onto the layout."""
    write_once(cells.repartition("pollutant", "date"), path, ["pollutant", "date"])


def write_parameters(spark: SparkSession, parameters: dict, path: str) -> None:
    """Small parameter set as one JSON row."""
    row = spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("errorifexists").text(path)


def read_parameters(spark: SparkSession, path: str) -> dict:
    """Parameters written by ``write_parameters``."""
    rows = spark.read.text(path).limit(2).collect()
    if len(rows) != 1:
        raise ContractError(f"{path} must hold one parameter row")
    return json.loads(rows[0][0])


def write_snapshot(rows: DataFrame, path: str, scope: str, verified: bool = False) -> None:
    """Model rows with their scope and gate state."""
    marked = rows.withColumn("scope", F.lit(scope)).withColumn("formal_gate_verified", F.lit(verified))
    write_once(marked, path)


def read_snapshot(spark: SparkSession, path: str, scope: str, verified: bool = False) -> DataFrame:
    """Model rows; refuses a snapshot of another scope or gate state."""
    df = spark.read.parquet(path)
    wrong = df.filter(~F.col("scope").eqNullSafe(F.lit(scope)) | (F.col("formal_gate_verified") != verified))
    require_empty(wrong.limit(1), f"{path}: not a '{scope}' snapshot with gate {verified}")
    return df.drop("scope", "formal_gate_verified")


def stage(spark: SparkSession, tables: dict[str, str], target: str) -> None:
    """Copy named result tables into a staging folder, each write-once."""
    for name, source in tables.items():
        write_once(spark.read.parquet(source), f"{target}/{name}")
