"""From scoped events to model tables and model grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstrata.core import stored
from matchstrata.models import clogit, grid
from matchstrata.models.strata import Shared, StrataTable, pack_events
from matchstrata.operators import exposure as ex
from matchstrata.operators import weather
from matchstrata.operators.multiplicity import benjamini_hochberg

CALENDAR_COLUMNS = ["holiday", "adjusted_workday", "official_break"]


def join_bases(bases: dict[str, DataFrame]) -> DataFrame:
    """One weather table with the columns of every configuration; only 'main' has no prefix.

    Configurations meet on the small lattice-day side, so event rows are joined once.
    """
    parts = []
    for config, basis in bases.items():
        cols = [*weather.temp_columns(weather.CONFIGS[config]), *weather.HUMIDITY_COLUMNS]
        prefix = "" if config == "main" else f"{config}_"
        parts.append(
            basis.select(weather.GRID, weather.DAY, *[F.col(c).alias(f"{prefix}{c}") for c in cols])
        )
    return reduce(lambda a, b: a.join(b, [weather.GRID, weather.DAY], "full"), parts)


def analysis_series(
    histories: DataFrame,
    calendar: DataFrame,
    basis: DataFrame,
    cell: list[str],
    pollutants: list[str] = ex.POLLUTANTS,
    windows: dict[str, tuple] = {**ex.WINDOWS, **ex.EXTRA_WINDOWS},
) -> list[Shared]:
    """Daily values of the matched rows: exposure windows by cell, calendar, weather by grid.

    Each is stored once, a row per place and day, as its strata and its scans read it.
    """
    days = ex.with_windows(histories, pollutants, windows)
    parts = [(days, cell), (calendar.select("date", *CALENDAR_COLUMNS), []), (basis, [weather.GRID])]
    return [Shared(stored(df), list(keys), [c for c in df.columns if c not in (*keys, "date")]) for df, keys in parts]


def model_table(
    scope: DataFrame, placements: DataFrame, series: list[Shared], columns: list[str], scenarios: list[str] = ()
) -> StrataTable:
    """Packed strata of the scoped events. Joins are between events (scope, location tier, cell, weather grid); no date is expanded."""
    held = [Shared(s.df, s.keys, [c for c in s.columns if c in columns]) for s in series]
    return pack_events(scope.join(placements, "location_id", "left"), held, columns, scenarios)


def grid_columns(
    configs=("main", "lag14", "lag28", "df4"), pollutants=ex.POLLUTANTS, windows=tuple(ex.WINDOWS)
) -> list[str]:
    """Columns the scenario grid reads."""
    cols = [f"{p}_{w}" for p in pollutants for w in windows] + CALENDAR_COLUMNS
    for config in configs:
        prefix = "" if config == "main" else f"{config}_"
        names = [*weather.temp_columns(weather.CONFIGS[config]), *weather.HUMIDITY_COLUMNS]
        cols += [f"{prefix}{n}" for n in names]
    return cols


def run_grid(table: StrataTable, specs: list, family: list[str], family_size: int) -> DataFrame:
    """Fit a grid in lock-step and add labels and q-values of the main family."""
    spark = table.df.sparkSession
    fits = clogit.fit_models(table, specs)
    out = clogit.results(spark, fits).join(grid.label_frame(spark, specs), "model_id")
    main = (
        (F.col("scenario") == grid.FULL_SAMPLE) & (F.col("weather_config") == "main") & (F.col("window") == "lag01")
    )
    q = benjamini_hochberg(out.filter(main), family, "p", "model_id", family_size).select("model_id", "q")
    return out.join(q, "model_id", "left").withColumn("increment", F.lit(int(grid.INCREMENT)))
