"""Weather series: contract, humidity mean, temperature cross-basis."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchstrata.functions import spline
from matchstrata.operators.segments import exact_quantiles

GRID, DAY = "weather_grid_id", "date"


@dataclass(frozen=True)
class BasisConfig:
    lag: int = 21
    var_df: int = 3
    lag_df: int = 3


# The main configuration and its three alternatives.
CONFIGS = {
    "main": BasisConfig(),
    "lag14": BasisConfig(lag=14),
    "lag28": BasisConfig(lag=28),
    "df4": BasisConfig(var_df=4, lag_df=4),
}


def flatten_daily(batches: DataFrame) -> DataFrame:
    """Parallel day arrays of a weather response to one row per grid and day.

    ``batches``: latitude, longitude, daily struct<time, temp, rh>. A grid that was returned
    several times must carry the same values; ``versions`` counts the distinct ones.
    """
    zipped = F.arrays_zip("daily.time", "daily.temp", "daily.rh").cast("array<struct<time:string,temp:double,rh:double>>")
    rows = batches.select("latitude", "longitude", F.explode(zipped).alias("d"))
    both = F.struct("d.temp", "d.rh")
    return (
        rows.groupBy("latitude", "longitude", F.col("d.time").cast("date").alias(DAY))
        .agg(F.min(both).alias("v"), (F.min(both) != F.max(both)).cast("int").alias("conflict"))
        .select(
            F.format_string("ERA5_%.2f_%.2f", "latitude", "longitude").alias(GRID),
            "latitude",
            "longitude",
            DAY,
            F.col("v.temp").alias("temp"),
            F.col("v.rh").alias("rh"),
            "conflict",
        )
    )


def gaps(series: DataFrame, key: str = GRID, date: str = DAY) -> DataFrame:
    """Rows whose previous row of the key is not the day before."""
    w = Window.partitionBy(key).orderBy(date)
    step = F.datediff(date, F.lag(date).over(w))
    return series.withColumn("step", step).filter(F.col("step").isNotNull() & (F.col("step") != 1)).select(key, date, "step")


def rolling_mean(series: DataFrame, value: str, days: int = 4, out: str = "rh_ma03") -> DataFrame:
    """Mean of the last ``days`` rows, null while the history is short or has gaps."""
    w = Window.partitionBy(GRID).orderBy(DAY).rowsBetween(-(days - 1), 0)
    full = F.count(value).over(w) == days
    return series.withColumn(out, F.when(full, F.avg(value).over(w)))


def basis_parameters(series: DataFrame, configs: dict[str, BasisConfig]) -> dict[str, dict]:
    """Knots and bounds per configuration, pooled over the lattice.

    All quantiles of a variable come from one pass.
    """
    dfs = sorted({c.var_df for c in configs.values()})
    probs = {f"k{n}_{i}": i / n for n in dfs for i in range(1, n)}
    probs.update({"k3_1": 1 / 3, "k3_2": 2 / 3, "lo": 0.0, "hi": 1.0})
    pairs = [F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in ("temp", "rh_ma03")]
    long = series.select(F.inline(F.array(*pairs)))
    found = {r["variable"]: r for r in exact_quantiles(long, ["variable"], "value", probs).collect()}
    temp, rh = found["temp"], found["rh_ma03"]
    return {
        name: {
            "temp_knots": [temp[f"k{c.var_df}_{i}"] for i in range(1, c.var_df)],
            "temp_bounds": [temp["lo"], temp["hi"]],
            "rh_knots": [rh["k3_1"], rh["k3_2"]],
            "rh_bounds": [rh["lo"], rh["hi"]],
        }
        for name, c in configs.items()
    }


def cross_basis(series: DataFrame, config: BasisConfig, params: dict, start: str | None = None) -> DataFrame:
    """Temperature cross-basis and humidity spline columns per grid and day.

    cb[a, b](t) = sum over lags l of basis_a(temp(t-l)) * lagbasis_b(l); null until the history
    is complete. One window per grid over the gapless daily series.
    """
    tb = spline.spline_columns(F.col("temp"), params["temp_knots"], params["temp_bounds"])
    lb = spline.lag_basis(config.lag, config.lag_df)
    frame = Window.partitionBy(GRID).orderBy(DAY).rowsBetween(-config.lag, 0)
    base = series.select(GRID, DAY, "temp", "rh_ma03", *[c.alias(f"__t{a}") for a, c in enumerate(tb)])
    # The last lag+1 values of each basis column, oldest first; nulls are left out and show as a short list.
    recent = base.select("*", *[F.collect_list(f"__t{a}").over(frame).alias(f"__h{a}") for a in range(len(tb))])
    weights = [F.array(*[F.lit(float(w)) for w in lb[::-1, b]]) for b in range(config.lag_df)]
    cols = []
    for a in range(len(tb)):
        history = F.col(f"__h{a}")
        for b in range(config.lag_df):
            parts = F.zip_with(history, weights[b], lambda v, w: v * w)
            total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
            whole = F.size(history) == config.lag + 1
            cols.append(F.when(whole, total).alias(f"temp_cb{a * config.lag_df + b + 1}"))
    rh = spline.spline_columns(F.col("rh_ma03"), params["rh_knots"], params["rh_bounds"])
    out = recent.select(GRID, DAY, "temp", "rh_ma03", *cols, *[c.alias(f"rh_ns{i + 1}") for i, c in enumerate(rh)])
    return out.filter(F.col(DAY) >= F.lit(start).cast("date")) if start else out


def temp_columns(config: BasisConfig) -> list[str]:
    return [f"temp_cb{i + 1}" for i in range(config.var_df * config.lag_df)]


HUMIDITY_COLUMNS = ["rh_ns1", "rh_ns2", "rh_ns3"]


def describe(rows: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Size, missing, mean, sd and quartiles per variable."""
    parts = []
    for v in variables:
        q = exact_quantiles(rows, keys, v, {"p25": 0.25, "median": 0.5, "p75": 0.75}).drop("n")
        m = rows.groupBy(*keys).agg(
            F.lit(v).alias("variable"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(v).isNull()).alias("missing"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("sd"),
        )
        parts.append(m.join(q, keys, "left"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
