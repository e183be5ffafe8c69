"""Session, checkpoint and contract helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A data contract (key, cardinality, invariant) does not hold."""


def local_session(cores: str = "8", name: str = "matchstrata") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="matchstrata-ckpt-"))
    else:
        raise ContractError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor re-reads files."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, options: dict[str, str] = {}) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Like ``stable``, but columnar: readers that need a few of many columns scan only those.
    """
    spark = df.sparkSession
    path = f"{_ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def require_empty(df: DataFrame, message: str) -> None:
    """Fail when a violation query returns any row."""
    if not df.isEmpty():
        raise ContractError(message)


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Bring a dimension to the driver, refusing one that outgrew its bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ContractError(f"{what}: more than {max_rows} rows")
    return rows


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_KEPT: dict = {}


def keep(spark: SparkSession, name: tuple, build):
    """Build a table or value once per session and hand it out again.

    Stands for what a study writes once and its later steps read.
    """
    key = (spark.sparkContext.applicationId, *name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def flag(cond) -> "F.Column":
    """0/1 integer of a condition, 0 for null."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def let(value, body):
    """Name a sub-expression: ``body`` gets it as one variable, evaluated once per row.

    Without it the optimizer copies the sub-expression to every place that mentions it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apart(value):
    """The same value. A wide projection that holds one lambda is compiled into many small methods; without any it becomes one
    method, too large for the JVM to compile, whose every step is then interpreted."""
    return let(value, lambda v: v)
