"""Fixed-coefficient likelihood and fitted probabilities as plain DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linear_predictor(terms: dict[str, float]):
    total = F.lit(0.0)
    for c, b in terms.items():
        total = total + F.col(c) * F.lit(float(b))
    return total


def fitted_probabilities(rows: DataFrame, terms: dict[str, float], event_id: str = "event_id") -> DataFrame:
    """Within-stratum softmax of the linear predictor (M17); strata hold at most five rows."""
    w = Window.partitionBy(event_id)
    lp = rows.withColumn("__lp", linear_predictor(terms))
    e = lp.withColumn("__e", F.exp(F.col("__lp") - F.max("__lp").over(w)))
    return e.withColumn("prob", F.col("__e") / F.sum("__e").over(w)).drop("__lp", "__e")


def daily_residuals(fitted: DataFrame) -> DataFrame:
    """Daily sum of case minus fitted probability."""
    return fitted.groupBy("date").agg(F.sum(F.col("case") - F.col("prob")).alias("residual"))


def fixed_beta(rows: DataFrame, x: str, beta: float, event_id: str = "event_id") -> DataFrame:
    """Log-likelihood, score and information of a one-covariate model at a fixed beta."""
    v = F.col(x)
    e = F.exp(v * float(beta))
    per = rows.groupBy(event_id).agg(
        F.sum(F.when(F.col("case") == 1, v)).alias("xc"),
        F.sum(e).alias("s0"),
        F.sum(e * v).alias("s1"),
        F.sum(e * v * v).alias("s2"),
    )
    mean = F.col("s1") / F.col("s0")
    return per.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.col("xc") * float(beta) - F.log("s0")).alias("loglik"),
        F.sum(F.col("xc") - mean).alias("score"),
        F.sum(F.col("s2") / F.col("s0") - mean * mean).alias("information"),
    )
