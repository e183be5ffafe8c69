"""Person timelines: previous event, near pairs, anchored episodes, first records.

Distances are in whole days, so each person's events are first reduced to distinct days
(a map-side aggregate). What is ordered per person is then bounded by the calendar, however
many records one person holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchstrata.core import flag
from matchstrata.operators.segments import Segmented

NEAR_DAYS = 28


def with_previous_event(
    events: DataFrame, keys: list[str], onset: str, event_id: str, carry: list[str] = ()
) -> DataFrame:
    """Previous event of the same key in (onset, id) order as ``previous``, and ``gap_days``."""
    cols = [event_id, onset, *[c for c in carry if c not in (event_id, onset)]]
    out = Segmented(events, keys, [onset, event_id]).with_previous(cols, "previous")
    return out.withColumn("gap_days", F.datediff(onset, F.col(f"previous.{onset}")))


def adjacent_pairs(
    events: DataFrame, keys: list[str], onset: str, event_id: str, compare: dict[str, str], days: int = NEAR_DAYS
) -> DataFrame:
    """Adjacent pairs at most ``days`` apart with 0/1 conflict columns."""
    linked = with_previous_event(events, keys, onset, event_id, list(compare.values()))
    near = linked.filter(F.col("gap_days") <= days)
    return near.select(
        F.col(f"previous.{event_id}").alias("previous_event_id"),
        F.col(event_id).alias("current_event_id"),
        *keys,
        F.col(f"previous.{onset}").alias("previous_onset"),
        F.col(onset).alias("current_onset"),
        "gap_days",
        *[flag(~F.col(f"previous.{c}").eqNullSafe(F.col(c))).alias(n) for n, c in compare.items()],
        F.when(F.col("gap_days") == 0, "same_day_duplicate_candidate")
        .otherwise("within28_monitoring_episode_candidate")
        .alias("classification"),
    )


def event_days(events: DataFrame, keys: list[str], onset: str) -> DataFrame:
    """Distinct (key, day) with the number of events ``day_events``."""
    return events.groupBy(*keys, onset).agg(F.count(F.lit(1)).alias("day_events"))


def near_days(events: DataFrame, keys: list[str], onset: str, days: int = NEAR_DAYS) -> DataFrame:
    """Days on which an event has another event of its key within ``days``."""
    w = Window.partitionBy(*keys).orderBy(onset)
    d = event_days(events, keys, onset)
    back = F.datediff(onset, F.lag(onset).over(w)) <= days
    ahead = F.datediff(F.lead(onset).over(w), onset) <= days
    near = (F.col("day_events") > 1) | F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))
    return d.select(*keys, onset, near.cast("int").alias("near"))


def flag_near(events: DataFrame, keys: list[str], onset: str, days: int = NEAR_DAYS, name: str = "near") -> DataFrame:
    """0/1 per event: both ends of any pair within ``days``."""
    marks = near_days(events, keys, onset, days).filter("near = 1").select(*keys, onset, F.lit(1).alias("__n"))
    return events.join(marks, [*keys, onset], "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__n")


def episode_days(events: DataFrame, keys: list[str], onset: str, days: int = NEAR_DAYS) -> DataFrame:
    """(key, day) -> anchor day and episode number.

    An episode opens on a day more than ``days`` after the anchor of the running one. The rule
    depends on the last anchor, not on the previous row, so no window frame expresses it; it is
    a fold over the distinct days of a key, whose number the calendar bounds.
    """
    grouped = (
        events.select(*keys, onset)
        .distinct()
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(onset)).alias("all_days"))
    )
    start = F.struct(
        F.lit(None).cast("date").alias("anchor"),
        F.lit(0).alias("number"),
        F.array().cast("array<struct<day:date,anchor:date,number:int>>").alias("seen"),
    )

    def step(acc, day):
        opens = acc["anchor"].isNull() | (F.datediff(day, acc["anchor"]) > days)
        anchor = F.when(opens, day).otherwise(acc["anchor"])
        number = acc["number"] + opens.cast("int")
        row = F.struct(day.alias("day"), anchor.alias("anchor"), number.alias("number"))
        return F.struct(
            anchor.alias("anchor"), number.alias("number"), F.concat(acc["seen"], F.array(row)).alias("seen")
        )

    folded = grouped.select(*keys, F.explode(F.aggregate("all_days", start, step)["seen"]).alias("e"))
    return folded.select(
        *keys, F.col("e.day").alias(onset), F.col("e.anchor").alias("anchor"), F.col("e.number").alias("episode")
    )


def with_episodes(events: DataFrame, keys: list[str], onset: str, days: int = NEAR_DAYS) -> DataFrame:
    """Each event with the anchor day and number of its episode."""
    return events.join(episode_days(events, keys, onset, days), [*keys, onset], "left")


def anchored_first(events: DataFrame, keys: list[str], onset: str, event_id: str, days: int = NEAR_DAYS) -> DataFrame:
    """The one event that opens each episode: lowest id on the anchor day."""
    anchors = episode_days(events, keys, onset, days).filter(F.col(onset) == F.col("anchor"))
    firsts = events.groupBy(*keys, onset).agg(F.min(event_id).alias(event_id))
    return anchors.join(firsts, [*keys, onset]).select(*keys, onset, event_id, "episode")


def first_records(events: DataFrame, keys: list[str], onset: str, event_id: str) -> DataFrame:
    """Earliest (onset, id) per key as a map-side minimum."""
    first = events.groupBy(*keys).agg(F.min(F.struct(onset, event_id)).alias("f"))
    return first.select(*keys, F.col(f"f.{onset}").alias(onset), F.col(f"f.{event_id}").alias(event_id))


def _cell_pairs(cells: DataFrame, keys: list[str], code: str, onset: str, days: int) -> DataFrame:
    """Earlier and later cells of one key with different codes, at most ``days`` apart.

    Days fall into buckets of days+1; an earlier cell looks into its own bucket and the next, so
    each cell travels twice at most, and a bucket of one key is bounded by its days and codes.
    """
    day = F.datediff(onset, F.lit("1970-01-01").cast("date"))
    bucket = F.floor(day / (days + 1))
    early = cells.select(
        *keys,
        F.explode(F.array(bucket, bucket + 1)).alias("__b"),
        F.col(onset).alias("previous_onset"),
        F.col(code).alias("previous_code"),
        F.col("n").alias("n_previous"),
    )
    late = cells.select(
        *keys,
        bucket.alias("__b"),
        F.col(onset).alias("current_onset"),
        F.col(code).alias("current_code"),
        F.col("n").alias("n_current"),
    )
    gap = F.datediff("current_onset", "previous_onset")
    met = early.join(late, [*keys, "__b"]).withColumn("gap_days", gap)
    return met.filter(
        F.col("gap_days").between(0, days)
        & (F.col("previous_code") != F.col("current_code"))
        & ((F.col("gap_days") > 0) | (F.col("previous_code") < F.col("current_code")))
    ).drop("__b")


def cross_code_cells(
    events: DataFrame, keys: list[str], code: str, onset: str, location: str, days: int = NEAR_DAYS
) -> DataFrame:
    """Pairs of different codes of one key within ``days``, as counted day cells.

    A cell is all events of one (key, day, code). Listing event pairs would grow with the square
    of a busy key; a cell meets only the cells of the next ``days`` days, and the pair count is
    the product of the two cell sizes. Members of a cell are the events with that (key, day, code).
    """
    ends = [*keys, "previous_onset", "previous_code", "current_onset", "current_code"]
    cells = events.groupBy(*keys, onset, code).agg(F.count(F.lit(1)).alias("n"))
    pairs = _cell_pairs(cells, keys, code, onset, days).select(
        *ends, "gap_days", (F.col("n_previous") * F.col("n_current")).alias("n_pairs")
    )
    placed = events.groupBy(*keys, location, onset, code).agg(F.count(F.lit(1)).alias("n"))
    same = (
        _cell_pairs(placed, [*keys, location], code, onset, days)
        .groupBy(*ends)
        .agg(F.sum(F.col("n_previous") * F.col("n_current")).alias("n_same_location"))
    )
    conflict = F.col("n_pairs") - F.coalesce("n_same_location", F.lit(0))
    return pairs.join(same, ends, "left").select(*pairs.columns, conflict.alias("n_location_conflict"))


def flag_cross_code(
    events: DataFrame, keys: list[str], code: str, onset: str, days: int = NEAR_DAYS, name: str = "cross_near"
) -> DataFrame:
    """0/1 per event: another code of the same key within ``days``.

    Least and greatest code around a day tell whether there is another one; the window runs over
    distinct (day, code) cells of a key.
    """
    cells = events.select(*keys, onset, code).distinct()
    day = F.datediff(onset, F.lit("1970-01-01").cast("date"))
    around = Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, days)
    hit = (F.min(code).over(around) != F.col(code)) | (F.max(code).over(around) != F.col(code))
    marks = cells.select(*keys, onset, code, hit.cast("int").alias(name))
    return events.join(marks, [*keys, onset, code], "left").withColumn(name, F.coalesce(name, F.lit(0)))
