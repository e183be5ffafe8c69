"""Contracts as queries that return violating rows; an empty result means the contract holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchstrata.operators import weather


def stratum_violations(rows: DataFrame) -> DataFrame:
    """Strata without exactly one case, 4-5 rows, distinct dates and one location."""
    per = rows.groupBy("event_id").agg(
        F.sum("case").alias("cases"),
        F.count(F.lit(1)).alias("n"),
        F.size(F.collect_set("date")).alias("dates"),
        (F.min("location_id") == F.max("location_id")).alias("one_location"),
    )
    return per.filter(
        (F.col("cases") != 1)
        | ~F.col("n").isin(4, 5)
        | (F.col("n") != F.col("dates"))
        | ~F.coalesce("one_location", F.lit(False))
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by several rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def weather_violations(series: DataFrame) -> DataFrame:
    """Null, out-of-range, repeated or gapped weather rows, with the rule broken."""
    bad = F.when(F.col("temp").isNull() | F.col("rh").isNull(), "null").when(
        ~F.col("rh").between(0, 100) | ~F.col("temp").between(-90, 60), "range"
    )
    rows = series.withColumn("rule", bad).filter("rule IS NOT NULL").select("weather_grid_id", "date", "rule")
    twice = duplicate_keys(series, ["weather_grid_id", "date"]).select(
        "weather_grid_id", "date", F.lit("duplicate").alias("rule")
    )
    holes = weather.gaps(series).filter("step > 1").select("weather_grid_id", "date", F.lit("gap").alias("rule"))
    return rows.unionByName(twice).unionByName(holes)


def adjudication_violations(rows: DataFrame) -> DataFrame:
    """Pending rows with an eligibility, included rows with flags."""
    pending = (F.col("decision") == "pending_review") & (F.col("eligible").isNotNull() | (F.col("dedup_finalized") != 0))
    included = (F.col("decision") == "included") & (~F.col("eligible").eqNullSafe(F.lit(1)) | (F.size("review_flags") > 0))
    return rows.filter(pending | included)


def location_violations(rows: DataFrame) -> DataFrame:
    """Tier flags that contradict the evidence."""
    conflict = F.lit(False)
    for c in ("district_conflict", "road_conflict", "house_number_conflict", "building_number_conflict"):
        conflict = conflict | (F.col(c) == 1)
    return rows.filter(
        (F.col("main_eligible") != F.col("verified_within_1km"))
        | ((F.col("main_eligible") == 1) & (F.col("independently_verified_within_1km") != 1))
        | ((F.col("sensitivity_eligible") == 1) & (conflict | (F.col("multiple_plausible_locations") == 1)))
        | (
            F.col("sensitivity_eligible")
            != F.col("sensitivity_core_eligible") + F.col("sensitivity_coarse_eligible")
        )
    )


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys lost, gained, or with a changed value."""
    a = before.select(key, F.struct(*columns).alias("__a"), F.lit(1).alias("__in_a"))
    b = after.select(key, F.struct(*columns).alias("__b"), F.lit(1).alias("__in_b"))
    both = a.join(b, key, "full")
    kind = (
        F.when(F.col("__in_b").isNull(), "lost")
        .when(F.col("__in_a").isNull(), "gained")
        .when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    )
    return both.select(key, kind.alias("change")).filter("change IS NOT NULL")


def several_values(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Keys whose value is not single (V08): stratum within one month, unchanged grid axes."""
    return df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo <> hi")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on one side only, marked with the side; empty when the sets are equal."""
    sides = [
        left.exceptAll(right).withColumn("side", F.lit("left")),
        right.exceptAll(left).withColumn("side", F.lit("right")),
    ]
    return reduce(DataFrame.unionByName, sides)


def seeded_sample(df: DataFrame, key: list[str], seed: int, n: int) -> DataFrame:
    """Repeatable sample without replacement: lowest salted hashes."""
    return df.withColumn("__h", F.xxhash64(*key, F.lit(seed))).orderBy("__h", *key).limit(n).drop("__h")


def reextraction_errors(
    sample: DataFrame, values: DataFrame, cell: list[str], names: list[str], lags: range, tolerance: float = 1e-4
) -> DataFrame:
    """Compare stored histories with a direct value lookup at date - lag."""
    triples = [
        F.struct(F.lit(v).alias("name"), F.lit(k).alias("lag"), F.col(f"{v}_l{k}").cast("double").alias("stored"))
        for v in names
        for k in lags
    ]
    wanted = sample.select("event_id", *cell, "date", F.explode(F.array(*triples)).alias("t")).select(
        "event_id", *cell, F.date_sub("date", F.col("t.lag")).alias("date"), "t.name", "t.lag", "t.stored"
    )
    pairs = [F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("direct")) for v in names]
    direct = values.select(*cell, "date", F.inline(F.array(*pairs)))
    joined = wanted.join(direct, [*cell, "date", "name"], "left")
    same = (F.col("stored").isNull() & F.col("direct").isNull()) | (
        F.abs(F.col("stored") - F.col("direct")) <= tolerance
    )
    return joined.filter(~F.coalesce(same, F.lit(False)))
