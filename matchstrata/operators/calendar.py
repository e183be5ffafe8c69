"""Holiday calendar dimension and its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Official break ranges, adjusted workdays and statutory days per year.
BREAKS = [
    ("2023-01-01", "2023-01-02"),
    ("2023-01-21", "2023-01-27"),
    ("2023-04-05", "2023-04-05"),
    ("2023-04-29", "2023-05-03"),
    ("2023-06-22", "2023-06-24"),
    ("2023-09-29", "2023-10-06"),
    ("2023-12-30", "2023-12-31"),
    ("2024-01-01", "2024-01-01"),
    ("2024-02-10", "2024-02-17"),
    ("2024-04-04", "2024-04-06"),
    ("2024-05-01", "2024-05-05"),
    ("2024-06-08", "2024-06-10"),
    ("2024-09-15", "2024-09-17"),
    ("2024-10-01", "2024-10-07"),
    ("2025-01-01", "2025-01-01"),
    ("2025-01-28", "2025-02-04"),
    ("2025-04-04", "2025-04-06"),
    ("2025-05-01", "2025-05-05"),
    ("2025-05-31", "2025-06-02"),
    ("2025-10-01", "2025-10-08"),
]
WORKDAYS = [
    "2023-01-28", "2023-01-29", "2023-04-23", "2023-05-06", "2023-06-25", "2023-10-07", "2023-10-08",
    "2024-02-04", "2024-02-18", "2024-04-07", "2024-04-28", "2024-05-11", "2024-09-14", "2024-09-29",
    "2024-10-12",
    "2025-01-26", "2025-02-08", "2025-04-27", "2025-09-28", "2025-10-11",
]
STATUTORY = [
    "2023-01-01", "2023-01-22", "2023-01-23", "2023-01-24", "2023-04-05", "2023-05-01", "2023-06-22",
    "2023-09-29", "2023-10-01", "2023-10-02", "2023-10-03",
    "2024-01-01", "2024-02-10", "2024-02-11", "2024-02-12", "2024-04-04", "2024-05-01", "2024-06-10",
    "2024-09-17", "2024-10-01", "2024-10-02", "2024-10-03",
    "2025-01-01", "2025-01-28", "2025-01-29", "2025-01-30", "2025-01-31", "2025-04-04", "2025-05-01",
    "2025-05-02", "2025-05-31", "2025-10-06", "2025-10-01", "2025-10-02", "2025-10-03",
]
EXPECTED_STATUTORY = {2023: 11, 2024: 11, 2025: 13}
EXPECTED_WORKDAYS = {2023: 7, 2024: 8, 2025: 5}


def with_calendar(days: DataFrame, date: str = "date") -> DataFrame:
    """Add the calendar columns to any daily table (K01); the rules are a few constants."""
    d = F.col(date)

    def among(values):
        return d.isin([F.lit(v).cast("date") for v in values]).cast("int")

    on_break = F.lit(False)
    for a, b in BREAKS:
        on_break = on_break | d.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return days.select(
        "*",
        among(STATUTORY).alias("holiday"),
        among(STATUTORY).alias("statutory_holiday"),
        on_break.cast("int").alias("official_break"),
        among(WORKDAYS).alias("adjusted_workday"),
        (F.weekday(d) + 1).alias("weekday"),
    )


def calendar(spark: SparkSession, start: str = "2023-01-01", end: str = "2025-12-31") -> DataFrame:
    """The calendar dimension."""
    span = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    return with_calendar(spark.range(1).select(span))


def rule_violations(cal: DataFrame) -> DataFrame:
    """Days that break a calendar rule."""
    return cal.filter(
        ((F.col("official_break") == 1) & (F.col("adjusted_workday") == 1))
        | ((F.col("holiday") == 1) & (F.col("official_break") == 0))
    )


def yearly_totals(cal: DataFrame) -> DataFrame:
    """Day counts per year."""
    return cal.groupBy(F.year("date").alias("year")).agg(
        *[F.sum(c).alias(f"{c}_days") for c in ("statutory_holiday", "official_break", "adjusted_workday")]
    )
