"""Model table: one row per stratum, and the block reader of the fitting jobs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchstrata.core import partitions, stored
from matchstrata.operators import exposure as ex

KEYS = ["pos", "study_group", "cluster_id", "month", "bits", "n", "weight"]
#: Strata of a shared series up to which its values are looked up by each scan; those of a larger one are packed with the events.
SHARED = 1 << 17


@dataclass(frozen=True)
class Shared:
    """Daily values that events share by place: one row per ``keys`` and date."""

    df: DataFrame
    keys: list[str]
    columns: list[str]


@dataclass
class StrataTable:
    """Packed strata: one array column per variable, the case row's value first.

    Values of ``shared`` series are kept once per series key and onset (arrays of a stratum of its own) and meet the events in the scan.
    """

    df: DataFrame
    columns: list[str]
    scenarios: list[str]
    cluster: str = "cluster_id"
    shared: list[Shared] = field(default_factory=list)

    def pooled(self, needed: list[str], scenarios: list[str] = ()) -> StrataTable:
        """One row for all strata that are alike in the ``needed`` variables, group, month and ``scenarios``, with their number as ``weight``.

        Events that share places and onsets have alike strata, which give a sum over strata the same part. A table that holds arrays
        of its own for its events (series of more than ``SHARED`` strata among them) is left as it is.
        """
        own = [f"o{self.columns.index(c)}" for c in needed if f"o{self.columns.index(c)}" in self.df.columns]
        if not self.shared or any(c.startswith("v") for c in self.df.columns):
            return self
        keys = list(dict.fromkeys(k for s in self.shared if any(c in s.columns for c in needed) for k in s.keys))
        mask = sum(1 << self.scenarios.index(s) for s in set(scenarios))
        bits = F.col("bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")
        alike = ["study_group", "month", "n", "times", "onset", *keys, *own]
        rows = self.df.select(bits, *alike).groupBy("bits", *alike).agg(F.count(F.lit(1)).cast("double").alias("weight"))
        # Dealt out evenly: a few small files would be read by a few tasks.
        rows = stored(rows.repartition(partitions(self.df.sparkSession)))
        return StrataTable(rows, self.columns, self.scenarios, self.cluster, self.shared)

    def scan(self, needed: list[str], *more: Column | str) -> DataFrame:
        """Only the variables a job reads; the rest stays unread in the columnar files."""
        rows, held = self.df, set(self.df.columns)
        for k, s in enumerate(self.shared):
            if some := [c for c in needed if c in s.columns]:
                side = s.df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*s.keys, "onset"])], *[F.col(c).alias(f"__s{self.columns.index(c)}") for c in some])
                on = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate([*s.keys, "onset"])]
                rows = rows.join(F.broadcast(side), on, "left").drop(*[f"__k{i}" for i in range(len(on))])

        def value(c: str) -> Column:
            i = self.columns.index(c)
            parts = [F.col(f"v{i}")] if f"v{i}" in held else []
            if f"o{i}" in held:
                parts.append(F.array_repeat(f"o{i}", F.col("n")))
            if any(c in s.columns for s in self.shared):
                # An event that comes r times holds each date r times.
                once = F.when(F.col("times") == 1, F.col(f"__s{i}")).otherwise(F.flatten(F.transform(f"__s{i}", lambda v: F.array_repeat(v, F.col("times")))))
                parts += [once, F.array_repeat(F.lit(None).cast("double"), F.col("n"))]
            return (F.coalesce(*parts) if len(parts) > 1 else parts[0]).alias(f"v{i}")

        return rows.select(*[c for c in KEYS if c in held], *more, *[value(c) for c in needed])


def pack_strata(
    rows: DataFrame,
    columns: list[str],
    scenarios: list[str] = (),
    group: str = "study_group",
    cluster: str = "cluster_id",
    parts: int | None = None,
) -> StrataTable:
    """One row per event: the case row's values first, then those of the 3-4 referent dates.

    The only shuffles of a whole model grid are here. Range partitioning on (cluster, event)
    splits a busy cluster over several files and leaves every other cluster inside one, so
    the robust variance needs no further shuffle of persons. ``pos`` numbers the rows within a
    file, which lets a reader see where its stretch of rows begins and ends.
    """
    one = _grouped(rows, columns, scenarios, group, cluster)
    ranged = _ranged(one, parts or partitions(rows.sparkSession))
    return StrataTable(stored(ranged), list(columns), list(scenarios))


def _bits(scenarios: list[str]) -> Column:
    marks = [F.when(F.array_contains("scenarios", s), F.lit(1 << i)).otherwise(F.lit(0)) for i, s in enumerate(scenarios)]
    return (sum(marks[1:], marks[0]) if marks else F.lit(0)).cast("long")


def _grouped(rows: DataFrame, columns: list[str], scenarios: list[str], group: str = "study_group", cluster: str = "cluster_id") -> DataFrame:
    """Rows of each event gathered into arrays, the case's first."""
    named = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    member = F.struct((1 - F.col("case")).alias("rank"), F.col("date").alias("date"), *named)
    one = rows.groupBy("event_id").agg(
        F.first(group).alias("study_group"),
        F.coalesce(F.first(cluster).cast("string"), F.lit("")).alias("cluster_id"),
        F.date_format(F.min("date"), "yyyy-MM").alias("month"),
        F.first(_bits(scenarios)).alias("bits"),
        F.sort_array(F.collect_list(member)).alias("m"),
    )
    return one.select(
        "event_id", "study_group", "cluster_id", "month", "bits", F.size("m").alias("n"), F.col("m.date").alias("dates"),
        *[F.col(f"m.v{i}").alias(f"v{i}") for i in range(len(columns))],
    )


def _ranged(one: DataFrame, parts: int) -> DataFrame:
    ranged = one.repartitionByRange(parts, "cluster_id", "event_id").sortWithinPartitions("cluster_id", "event_id")
    return ranged.select("event_id", F.monotonically_increasing_id().alias("pos"), *[c for c in one.columns if c != "event_id"])


def pack_events(
    events: DataFrame,
    shared: list[Shared],
    columns: list[str],
    scenarios: list[str] = (),
    parts: int | None = None,
    most: int = SHARED,
) -> StrataTable:
    """``pack_strata`` of events (event_id, onset, study_group, cluster_id, scenarios, keys and own values) over shared daily series.

    Dates are not expanded into rows: an event's strata of a series depend on the series' key and the onset, so each series is
    laid out once per (key, onset) that occurs, and events carry the keys. A series of more than ``most`` such strata is joined
    to the events before they are packed. Rows that repeat an event count as often as they come; those that give one event
    different values go through ``pack_strata``'s grouping of rows.
    """
    if any(_repeats(s) for s in shared):
        return pack_strata(_long(events, shared), columns, scenarios, parts=parts)
    held = [c for s in shared for c in s.columns]
    own = [c for c in columns if c not in held]
    keys = list(dict.fromkeys(k for s in shared for k in s.keys))
    member = F.struct("onset", *keys, "study_group", "cluster_id", "scenarios", *own)
    rows = events.where("onset IS NOT NULL")
    one = rows.groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("times"), F.min(member).alias("m"), (F.max(member) == F.min(member)).alias("alike"))
    one = stored(one)
    others = F.filter(ex.referent_dates(F.col("onset")), lambda d: d != F.col("onset"))
    days = F.concat(F.array("onset"), others)
    plain = one.where("alike").select("event_id", "times", "m.*").select(
        "event_id",
        "study_group",
        F.coalesce(F.col("cluster_id").cast("string"), F.lit("")).alias("cluster_id"),
        F.date_format("onset", "yyyy-MM").alias("month"),
        _bits(scenarios).alias("bits"),
        (F.size(days) * F.col("times")).alias("n"),
        F.when(F.col("times") == 1, days).otherwise(F.flatten(F.transform(days, lambda d: F.array_repeat(d, F.col("times"))))).alias("dates"),
        "times",
        "onset",
        *keys,
        *[F.col(c).cast("double").alias(f"o{columns.index(c)}") for c in own],
    )
    small = []
    for s in shared:
        side = stored(_laid_out(s, plain.select(*s.keys, "onset").distinct()))
        if side.count() <= most:
            small.append(Shared(side, s.keys, s.columns))
            continue
        on = [F.col(c) == F.col(f"__{c}") for c in [*s.keys, "onset"]]
        named = [F.col(c).alias(f"__{c}") for c in [*s.keys, "onset"]]
        met = plain.join(side.select(*named, *[F.col(c).alias(f"__v{columns.index(c)}") for c in s.columns if c in columns]), on, "left")
        wide = [F.flatten(F.transform(f"__v{columns.index(c)}", lambda v: F.array_repeat(v, F.col("times")))) for c in s.columns if c in columns]
        none = F.array_repeat(F.lit(None).cast("double"), F.col("n"))
        plain = met.select(*plain.columns, *[F.coalesce(w, none).alias(f"v{columns.index(c)}") for w, c in zip(wide, [c for c in s.columns if c in columns])])
    mixed = one.where("NOT alike").select("event_id")
    if not mixed.isEmpty():
        some = rows.join(mixed, rows["event_id"].eqNullSafe(mixed["event_id"]), "left_semi")
        plain = plain.unionByName(_grouped(_long(some, shared), columns, scenarios), allowMissingColumns=True)
    table = stored(_ranged(plain, parts or partitions(events.sparkSession)))
    return StrataTable(table, list(columns), list(scenarios), shared=small)


def _repeats(s: Shared) -> bool:
    """Whether a series has several rows of one place and date."""
    return not s.df.groupBy(*s.keys, "date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _long(events: DataFrame, shared: list[Shared]) -> DataFrame:
    """A row per event and date with the values of every series."""
    rows = ex.matched_strata(events, keep=[c for c in events.columns if c != "onset"])
    for s in shared:
        rows = rows.join(s.df.select(*s.keys, "date", *s.columns), [*s.keys, "date"], "left")
    return rows


def _laid_out(s: Shared, asked: DataFrame) -> DataFrame:
    """An array over the stratum's dates, the onset first, of each column of a series, per (keys, onset) of ``asked``."""
    known = asked.dropna()
    days = ex.matched_strata(known.withColumn("__on", F.col("onset")), keep=[*s.keys, "__on"])
    values = s.df.select(*s.keys, "date", *[F.col(c).cast("double").alias(c) for c in s.columns])
    met = days.join(values, [*s.keys, "date"], "left")
    member = F.struct((1 - F.col("case")).alias("rank"), "date", *s.columns)
    one = met.groupBy(*s.keys, F.col("__on").alias("onset")).agg(F.sort_array(F.collect_list(member)).alias("m"))
    return one.select(*s.keys, "onset", *[F.col(f"m.{c}").alias(c) for c in s.columns])


@dataclass
class Block:
    """Strata of one Arrow batch with equal size; every variable is (strata, dates), case first."""

    rows: np.ndarray
    values: dict[str, np.ndarray]
    group: np.ndarray
    bits: np.ndarray
    month: np.ndarray
    weight: np.ndarray | None = None
    centred: dict = field(default_factory=dict)

    def missing(self, names) -> np.ndarray:
        out = np.zeros(len(self.rows), bool)
        for c in names:
            key = ("missing", c)
            if key not in self.centred:
                self.centred[key] = np.isnan(self.values[c]).any(axis=1)
            out |= self.centred[key]
        return out

    def term(self, columns: tuple[str, ...], scale: float) -> np.ndarray:
        """scale x product of columns, minus its value on the case date; kept for the next model."""
        key = (columns, scale)
        if key not in self.centred:
            v = self.values[columns[0]] * scale
            for c in columns[1:]:
                v = v * self.values[c]
            self.centred[key] = v - v[:, :1]
        return self.centred[key]

    def by_date(self, columns: tuple[str, ...], scale: float) -> np.ndarray:
        """``term`` as (dates, strata)."""
        key = ("by_date", columns, scale)
        if key not in self.centred:
            self.centred[key] = np.ascontiguousarray(self.term(columns, scale).T)
        return self.centred[key]


@dataclass
class Batch:
    size: int
    pos: np.ndarray | None
    blocks: list[Block] = field(default_factory=list)
    key: np.ndarray | None = None


def read_batches(batches, table_columns: list[str], needed: list[str], key: str | None = None) -> Iterator[Batch]:
    """Arrow batches of a scan as numpy blocks."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        n = rb.column("n").to_numpy(zero_copy_only=False)
        group = np.asarray(rb.column("study_group").to_pylist(), dtype=object)
        month = np.asarray(rb.column("month").to_pylist(), dtype=object)
        bits = rb.column("bits").to_numpy(zero_copy_only=False)
        names = rb.schema.names
        weight = rb.column("weight").to_numpy(zero_copy_only=False) if "weight" in names else np.ones(rb.num_rows)
        out = Batch(rb.num_rows, rb.column("pos").to_numpy(zero_copy_only=False) if "pos" in names else None)
        if key:
            out.key = np.asarray(rb.column(key).to_pylist(), dtype=object)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        flat = {}
        for c in needed:
            values = rb.column(f"v{table_columns.index(c)}").flatten()
            flat[c] = values.to_numpy(zero_copy_only=False).astype(float, copy=False)
        for size in np.unique(n):
            at = np.flatnonzero(n == size)
            take = starts[at][:, None] + np.arange(size)
            out.blocks.append(Block(at, {c: v[take] for c, v in flat.items()}, group[at], bits[at], month[at], weight[at]))
        yield out
