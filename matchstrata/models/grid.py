"""Model families: scenario grid, interactions, two pollutants, curves, distributed lags."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstrata.functions import spline
from matchstrata.models import clogit
from matchstrata.models.clogit import Fit, ModelSpec, Term
from matchstrata.operators.exposure import POLLUTANTS, WINDOWS
from matchstrata.operators.weather import CONFIGS, HUMIDITY_COLUMNS, temp_columns

INCREMENT = 10.0
FULL_SAMPLE = "all_registry_all_coordinates"


def adjustment(config: str = "main", holiday: str = "holiday", prefix: str = "") -> tuple[Term, ...]:
    """Weather and calendar terms; alternative weather columns carry their config as prefix."""
    temp = temp_columns(CONFIGS[config])
    names = [f"{prefix}{c}" for c in [*temp, *HUMIDITY_COLUMNS]] + [holiday, "adjusted_workday"]
    return tuple(Term(n, (n,)) for n in names)


def exposure_term(column: str, name: str = "pollution10") -> Term:
    return Term(name, (column,), 1.0 / INCREMENT)


def single(
    model_id: str,
    exposure: str,
    adjust: tuple[Term, ...],
    group: str | None = None,
    scenario: str | None = None,
    also_complete: tuple[str, ...] = (),
    labels: dict[str, str] | None = None,
) -> ModelSpec:
    """One-exposure model (M01); ``labels`` travel to the result table."""
    return ModelSpec(
        model_id, (exposure_term(exposure), *adjust), "pollution10", group, scenario, also_complete,
        labels=tuple((labels or {}).items()),
    )


def interaction(model_id: str, exposure: str, modifier: str, adjust, group=None, scenario=None) -> ModelSpec:
    """Exposure x modifier product without a main effect, which is constant in a stratum.

    A null modifier drops the stratum.
    """
    terms = (
        exposure_term(exposure),
        *adjust,
        Term("pollution10:modifier", (exposure, modifier), 1.0 / INCREMENT),
    )
    return ModelSpec(model_id, terms, "pollution10:modifier", group, scenario)


def two_pollutant(model_id: str, first: str, second: str, adjust, group=None) -> ModelSpec:
    """Two exposures together."""
    terms = (exposure_term(first, "poll_first"), exposure_term(second, "poll_second"), *adjust)
    return ModelSpec(model_id, terms, "poll_first", group, gate="events")


def custom(model_id: str, names: list[str], adjust, group=None) -> ModelSpec:
    """Base for curve and lag models: several exposure columns, event-count gate."""
    terms = (*[Term(n, (n,)) for n in names], *adjust)
    return ModelSpec(model_id, terms, names[0], group, gate="events")


def scenario_grid(
    groups: list[str],
    scenarios: list[str],
    pollutants: list[str] = POLLUTANTS,
    configs: tuple[str, ...] = ("main", "lag14", "lag28", "df4"),
    windows: list[str] = tuple(WINDOWS),
) -> list[ModelSpec]:
    """Outcome x pollutant x window x weather x scenario."""
    specs = []

    def add(group, pol, window, config, scenario, adjust, which=None, extra=()):
        specs.append(
            single(
                "|".join([group, pol, window, config, scenario]),
                f"{pol}_{window}",
                adjust,
                group,
                which,
                extra,
                {
                    "outcome_id": group,
                    "pollutant": pol,
                    "window": window,
                    "weather_config": config,
                    "scenario": scenario,
                },
            )
        )

    main = adjustment()
    for group in groups:
        for pol in pollutants:
            for config in configs:
                adjust = main if config == "main" else adjustment(config, prefix=f"{config}_")
                for window in windows if config == "main" else ["lag01"]:
                    add(group, pol, window, config, FULL_SAMPLE, adjust)
            for s in scenarios:
                add(group, pol, "lag01", "main", s, main, s)
            everywhere = tuple(f"{pol}_{w}" for w in windows)
            for window in windows:
                add(group, pol, window, "main", "all_windows_common_complete", main, None, everywhere)
            add(group, pol, "lag01", "main", "official_break_calendar", adjustment(holiday="official_break"))
    return specs


def label_frame(spark: SparkSession, specs: list[ModelSpec]) -> DataFrame:
    """Labels of the models, one row each."""
    names = list(dict.fromkeys(k for s in specs for k, _ in s.labels))
    rows = [(s.model_id, *[dict(s.labels).get(n) for n in names]) for s in specs]
    return spark.createDataFrame(rows, ", ".join(["model_id string", *[f"{n} string" for n in names]]))


# ---------------------------------------------------------------- curves and lags


def with_curve_columns(rows: DataFrame, exposure: str, knots, bounds, prefix: str) -> DataFrame:
    """Add the exposure spline columns ``{prefix}1..``."""
    cols = spline.spline_columns(F.col(exposure), knots, bounds)
    return rows.select("*", *[c.alias(f"{prefix}{i + 1}") for i, c in enumerate(cols)])


def equal_width_knots(low: float, high: float) -> list[float]:
    """Knots at thirds of the range."""
    return [low + (high - low) / 3, low + 2 * (high - low) / 3]


def curve_rows(fit: Fit, names: list[str], knots, bounds, reference: float, grid) -> list[tuple]:
    """(concentration, reference, OR, lower, upper) along a grid."""
    basis = spline.spline_matrix(grid, knots, bounds)
    at_ref = spline.spline_matrix([reference], knots, bounds)
    got = clogit.contrast(fit, names, basis - at_ref)
    return [(float(g), float(reference), o, lo, hi) for g, (_, o, lo, hi) in zip(grid, got)]


def with_lag_columns(rows: DataFrame, pollutant: str, prefix: str, max_lag: int = 7, df: int = 3) -> DataFrame:
    """Add distributed-lag columns: lag history per 10 units times the lag basis."""
    basis = spline.lag_basis(max_lag, df)
    cols = []
    for j in range(df):
        total = F.lit(0.0)
        for k in range(max_lag + 1):
            total = total + F.col(f"{pollutant}_l{k}") * float(basis[k, j] / INCREMENT)
        cols.append(total.alias(f"{prefix}{j + 1}"))
    return rows.select("*", *cols)


def lag_rows(fit: Fit, names: list[str], max_lag: int = 7, df: int = 3) -> tuple[list[tuple], tuple]:
    """Per-lag (lag, OR, lower, upper) and the cumulative (OR, lower, upper)."""
    basis = spline.lag_basis(max_lag, df)
    per = [(k, o, lo, hi) for k, (_, o, lo, hi) in enumerate(clogit.contrast(fit, names, basis))]
    _, o, lo, hi = clogit.contrast(fit, names, basis.sum(axis=0))[0]
    return per, (o, lo, hi)


def subgroup_rows(fit: Fit) -> list[tuple]:
    """(level, OR, lower, upper, p) at modifier 0 and 1 of an interaction model."""
    terms = ["pollution10", "pollution10:modifier"]
    out = []
    for level in (0, 1):
        if not fit.ok:
            out.append((level, None, None, None, None))
            continue
        eta, o, lo, hi = clogit.contrast(fit, terms, [1.0, float(level)])[0]
        se = (math.log(hi) - eta) / clogit.Z95
        out.append((level, o, lo, hi, clogit.normal_p(eta / se) if se > 0 else None))
    return out


def season_followup(table, pairs: list[tuple[str, str]], adjust, season_of: dict[int, str]) -> dict[str, Fit]:
    """Refits of flagged (group, pollutant) pairs: the interaction and each season alone.

    ``season_of`` names the packed scenario holding the strata of season 0 and 1.
    """
    specs = []
    for group, pol in pairs:
        column = f"{pol}_lag01"
        specs.append(interaction(f"{group}|{pol}|interaction", column, "warm", adjust, group))
        for s, scenario in season_of.items():
            specs.append(single(f"{group}|{pol}|season{s}", column, adjust, group, scenario))
    return clogit.fit_models(table, specs)


def dense_lag_curve(points: DataFrame, keys: list[str], max_lag: int = 7, df: int = 3, steps: int = 281) -> DataFrame:
    """Continuous lag curve recovered from the per-lag estimates.

    ``points`` holds one (lag, odds_ratio, lower, upper) row per lag, eight rows a group; the
    group's coefficients and covariance follow by least squares.
    """
    import pandas as pd

    def rebuild(pdf):
        pdf = pdf.sort_values("lag")
        basis = spline.lag_basis(max_lag, df)
        eta = np.log(pdf["odds_ratio"].to_numpy())
        se2 = ((np.log(pdf["upper"]) - np.log(pdf["lower"])).to_numpy() / (2 * clogit.Z95)) ** 2
        beta = np.linalg.lstsq(basis, eta, rcond=None)[0]
        pairs = [(i, j) for i in range(df) for j in range(i, df)]
        quad = np.column_stack([basis[:, i] * basis[:, j] * (1 if i == j else 2) for i, j in pairs])
        v = np.linalg.lstsq(quad, se2, rcond=None)[0]
        cov = np.zeros((df, df))
        for (i, j), e in zip(pairs, v):
            cov[i, j] = cov[j, i] = e
        error = max(np.abs(basis @ beta - eta).max(), np.abs(quad @ v - se2).max())
        x = np.linspace(0, max_lag, steps)
        knots = np.quantile(np.arange(max_lag + 1), np.arange(1, df - 1) / (df - 1))
        b = spline.spline_matrix(x, knots, (0, max_lag), intercept=True)
        fit = b @ beta
        s = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", b, cov, b), 0))
        out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys}, index=range(steps))
        return out.assign(
            lag=x,
            odds_ratio=np.exp(fit),
            lower=np.exp(fit - clogit.Z95 * s),
            upper=np.exp(fit + clogit.Z95 * s),
            rebuild_error=error,
        )

    types = dict(points.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    schema += ", lag double, odds_ratio double, lower double, upper double, rebuild_error double"
    cols = [*keys, "lag", "odds_ratio", "lower", "upper"]
    return points.select(*cols).groupBy(*keys).applyInPandas(rebuild, schema)
