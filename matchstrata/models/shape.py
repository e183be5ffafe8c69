"""Shaping of result tables for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Display labels.
OUTCOME_LABELS = {
    "CVD": "Cardiovascular",
    "CBVD": "Cerebrovascular",
    "MI": "Myocardial infarction",
    "ANGINA": "Angina (unconfirmed acute)",
    "IS": "Ischemic stroke",
    "ICH": "Intracerebral hemorrhage",
    "SAH": "Subarachnoid hemorrhage",
}
POLLUTANT_LABELS = {"PM25": "PM2.5", "PM10": "PM10", "O3": "O3"}
SCENARIO_LABELS = {
    "all_registry_all_coordinates": "Full registry",
    "strict_previous_adjudication": "Strict event subset",
    "core_addresses": "Core addresses (unverified)",
    "no_imputed_coordinates": "No imputed coordinates",
    "first_person_group_record": "First record per person/group",
    "anchored28_ICD3_scenario": "Anchored 28-day scenario",
    "trim_candidate_tails_0.1pct_complete_strata": "Trim 0.1% exposure tails",
}
FULL = "all_registry_all_coordinates"
DAILY_WINDOWS = ["lag0", "lag1", "lag2", "lag3", "lag4", "lag01", "lag02", "lag03", "lag04"]


def _label(c, labels: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def stack(parts: list[DataFrame]) -> DataFrame:
    """Union by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def labelled(results: DataFrame) -> DataFrame:
    return results.withColumn("outcome", _label("outcome_id", OUTCOME_LABELS)).withColumn(
        "pollutant_label", _label("pollutant", POLLUTANT_LABELS)
    )


def forest(results: DataFrame) -> DataFrame:
    """Main estimates: full sample, main weather, lag 0-1."""
    main = (F.col("scenario") == FULL) & (F.col("weather_config") == "main") & (F.col("window") == "lag01")
    return labelled(results.filter(main))


def daily_windows(results: DataFrame, extra: DataFrame) -> DataFrame:
    """Estimates by exposure window, main ones and the added lags 4 and 0-4."""
    main = results.filter((F.col("scenario") == FULL) & (F.col("weather_config") == "main"))
    more = extra.filter(F.col("scenario") == "reference_daily_lag_extension")
    return labelled(stack([main, more]).filter(F.col("window").isin(DAILY_WINDOWS)))


def dual_pollutant(dual: DataFrame, single: DataFrame) -> DataFrame:
    """Two-pollutant estimates beside the single-pollutant ones."""
    first = F.col("term") == "poll_first"
    two = dual.withColumn("pollutant", F.when(first, F.col("first")).otherwise(F.col("second"))).withColumn(
        "model", F.concat(F.lit("Adjusted for "), F.when(first, F.col("second")).otherwise(F.col("first")))
    )
    return labelled(stack([two, single.withColumn("model", F.lit("Single pollutant"))]))


def curve_comparison(percentile_knots: DataFrame, equal_knots: DataFrame) -> DataFrame:
    """Curves under both knot rules."""
    return labelled(
        stack(
            [
                percentile_knots.withColumn("model", F.lit("Percentile knots")),
                equal_knots.withColumn("model", F.lit("Equally spaced concentration knots")),
            ]
        )
    )


def sensitivity(results: DataFrame, extra: DataFrame, groups: list[str]) -> DataFrame:
    """Named sensitivity scenarios of the broad groups."""
    both = stack([results, extra])
    keep = (
        F.col("outcome_id").isin(groups)
        & (F.col("window") == "lag01")
        & (F.col("weather_config") == "main")
        & F.col("scenario").isin(list(SCENARIO_LABELS))
    )
    return labelled(both.filter(keep)).withColumn("scenario_label", _label("scenario", SCENARIO_LABELS))


def annual_counts(wide: DataFrame, key: str, years: list[int]) -> DataFrame:
    """Wide yearly counts back to rows."""
    return wide.unpivot(key, [f"y{y}" for y in years], "year", "events").withColumn(
        "year", F.regexp_replace("year", "^y", "").cast("int")
    )
