"""End-to-end slices over the driver tables: matched strata with daily exposures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstrata.catalog.base import table
from matchstrata.operators import exposure as ex


def order_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events of a person."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("person_id"),
        F.to_date("o_orderdate").alias("onset"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def daily_series(spark: SparkSession, sf: str) -> DataFrame:
    """One value per ship date: mean line quantity."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"))
        .agg((F.sum("l_quantity") / F.count(F.lit(1))).alias("v"))
        .withColumn("cell", F.lit(0))
    )


SPAN = ("1995-01-01", "2001-12-31")


def dense_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Complete strata with the mean exposure of the day and the day before, as ``v_lag01``."""
    series = ex.dense_series(daily_series(spark, sf), ["cell"], "date", *SPAN)
    histories = ex.lag_history(series, ["cell"], "date", ["v"], 7)
    strata = ex.matched_strata(order_events(spark, sf), keep=["event_id", "person_id", "priority"])
    rows = strata.withColumn("cell", F.lit(0)).join(histories, ["cell", "date"], "left")
    rows = ex.with_windows(rows, ["v"], {"lag01": (0, 1)})
    return ex.complete_strata(rows, ["v_lag01"])


def exposure_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Case and referent rows with their mean exposure over complete strata."""
    means = dense_exposure(spark, sf).groupBy("case").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v_lag01"), 4).alias("mean_exposure")
    )
    return means
