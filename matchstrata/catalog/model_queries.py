"""Queries that fit conditional logistic models on strata built from orders and shipments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from matchstrata.catalog import exposure_queries as eq
from matchstrata.catalog import model_sql as sql
from matchstrata.catalog.base import query
from matchstrata.core import keep, stable
from matchstrata.functions import spline
from matchstrata.models import bootstrap, clogit, grid, likelihood, shape
from matchstrata.models.clogit import ModelSpec, Term
from matchstrata.models.strata import Shared, pack_strata
from matchstrata.operators import audit, weather
from matchstrata.operators import exposure as ex
from matchstrata.operators.segments import exact_quantiles
from matchstrata.plans import slices, study

# ---------------------------------------------------------------- one covariate, SQL twins

_X = """m AS (SELECT cast(l_shipdate AS date) AS date, sum(l_quantity) / count(*) AS v FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS event_id, o_custkey AS person, o_orderpriority AS priority, cast(d AS date) AS date,
  cast(cast(d AS date) = cast(o_orderdate AS date) AS integer) AS c
  FROM (SELECT *, unnest(generate_series(date_trunc('month', o_orderdate), last_day(o_orderdate), interval 1 day)) AS d
    FROM orders) WHERE dayofweek(d) = dayofweek(o_orderdate)),
y AS (SELECT s.*, a.v AS v0, b.v AS v1 FROM s LEFT JOIN m a ON a.date = s.date LEFT JOIN m b ON b.date = s.date - 1),
x AS (SELECT event_id, person, priority, date, c, (v0 + v1) / 20 AS x FROM y
  WHERE event_id NOT IN (SELECT event_id FROM y WHERE v0 IS NULL OR v1 IS NULL))"""


def _newton(model: str, rounds: int = 7) -> str:
    """Chained Newton steps of a one-covariate model per model id."""
    steps = [f"b0 AS (SELECT {model}, 0e0 AS b FROM z GROUP BY {model})"]
    for i in range(rounds):
        steps.append(
            f"""e{i} AS (SELECT z.{model}, event_id, person, b, sum(c * x) AS xc, sum(exp(b * x)) AS s0, sum(x * exp(b * x)) AS s1,
            sum(x * x * exp(b * x)) AS s2 FROM z JOIN b{i} USING ({model}) GROUP BY ALL)"""
        )
        steps.append(
            f"""b{i + 1} AS (SELECT {model}, b + sum(xc - s1 / s0) / sum(s2 / s0 - (s1 / s0) * (s1 / s0)) AS b FROM e{i} GROUP BY {model}, b)"""
        )
    last = rounds - 1
    steps.append(f"u AS (SELECT {model}, person, sum(xc - s1 / s0) AS u FROM e{last} GROUP BY ALL)")
    steps.append(f"meat AS (SELECT {model}, sum(u * u) AS uu, count(*) AS clusters FROM u GROUP BY ALL)")
    steps.append(
        f"bread AS (SELECT {model}, b, sum(s2 / s0 - (s1 / s0) * (s1 / s0)) AS i, count(*) AS n_events FROM e{last} GROUP BY {model}, b)"
    )
    return ", ".join(steps)


_FITTED = """round(b, 6) AS log_or, round(sqrt(uu) / i, 6) AS robust_se, round(exp(b), 5) AS odds_ratio,
 round(exp(b - 1.96 * sqrt(uu) / i), 5) AS lower, round(exp(b + 1.96 * sqrt(uu) / i), 5) AS upper, n_events, clusters"""


def one_covariate_table(spark, sf):
    rows = slices.dense_exposure(spark, sf).withColumnRenamed("priority", "study_group")
    rows = rows.withColumnRenamed("person_id", "cluster_id")
    return pack_strata(rows, ["v_lag01", "v_l0", "v_l1", "v_l2"])


def shown(results, *extra):
    return results.select(
        *extra,
        F.round("log_or", 6).alias("log_or"),
        F.round("robust_se", 6).alias("robust_se"),
        F.round("odds_ratio", 5).alias("odds_ratio"),
        F.round("lower", 5).alias("lower"),
        F.round("upper", 5).alias("upper"),
        "n_events",
        "clusters",
    )


@query(
    "M01_M02_conditional_logistic_fit",
    f"WITH {_X}, z AS (SELECT 'all' AS model_id, * FROM x), {_newton('model_id')} "
    f"SELECT {_FITTED} FROM bread JOIN meat USING (model_id)",
)
def one_fit(spark, sf):
    table = one_covariate_table(spark, sf)
    spec = ModelSpec("all", (grid.exposure_term("v_lag01"),), "pollution10")
    return shown(clogit.results(spark, clogit.fit_models(table, [spec])))


@query(
    "M18_lockstep_grid_one_covariate",
    f"""WITH {_X}, w AS (SELECT y.* FROM y WHERE event_id IN (SELECT event_id FROM x)),
    z AS (SELECT priority || '|' || k AS model_id, event_id, person, c, v AS x FROM
      (SELECT priority, event_id, person, c, unnest(['l0', 'l1', 'lag01']) AS k, unnest([v0 / 10, v1 / 10, (v0 + v1) / 20]) AS v FROM w)),
    {_newton('model_id')} SELECT model_id, {_FITTED} FROM bread JOIN meat USING (model_id)""",
)
def grid_fit(spark, sf):
    table = one_covariate_table(spark, sf)
    groups = [r[0] for r in table.df.select("study_group").distinct().collect()]
    specs = [
        ModelSpec(f"{g}|{w}", (grid.exposure_term(f"v_{w}"),), "pollution10", g, also_complete=("v_lag01",))
        for g in groups
        for w in ("l0", "l1", "lag01")
    ]
    return shown(clogit.results(spark, clogit.fit_models(table, specs)), "model_id")


@query(
    "M22_fixed_beta_likelihood",
    f"""WITH {_X}, e AS (SELECT event_id, sum(c * x) AS xc, sum(exp(0.05e0 * x)) AS s0, sum(x * exp(0.05e0 * x)) AS s1,
      sum(x * x * exp(0.05e0 * x)) AS s2 FROM x GROUP BY 1)
    SELECT count(*) AS n_events, round(sum(xc * 0.05e0 - ln(s0)), 4) AS loglik, round(sum(xc - s1 / s0), 4) AS score,
    round(sum(s2 / s0 - (s1 / s0) * (s1 / s0)), 4) AS information FROM e""",
)
def fixed_beta(spark, sf):
    rows = slices.dense_exposure(spark, sf).withColumn("x", F.col("v_lag01") / 10)
    out = likelihood.fixed_beta(rows, "x", 0.05)
    return out.select("n_events", *[F.round(c, 4).alias(c) for c in ("loglik", "score", "information")])


_PROB = """p AS (SELECT *, exp(0.05e0 * x) / sum(exp(0.05e0 * x)) OVER (PARTITION BY event_id) AS prob FROM x)"""


@query(
    "M17_fitted_probabilities",
    f'WITH {_X}, {_PROB} SELECT event_id, cast(date AS varchar) AS date, c AS "case", round(prob, 6) AS prob FROM p',
)
def fitted(spark, sf):
    rows = slices.dense_exposure(spark, sf).withColumn("x", F.col("v_lag01") / 10)
    out = likelihood.fitted_probabilities(rows, {"x": 0.05})
    return out.select("event_id", eq.iso("date"), "case", F.round("prob", 6).alias("prob"))


@query(
    "A36_residual_autocorrelation",
    f"""WITH {_X}, {_PROB}, d AS (SELECT date, sum(c - prob) AS r FROM p GROUP BY 1), f AS (SELECT date, r - avg(r) OVER () AS r FROM d),
    n AS (SELECT row_number() OVER (ORDER BY date) AS i, r FROM f)
    SELECT k AS lag, round(sum(a.r * b.r) / (SELECT sum(r * r) FROM n), 5) AS acf
    FROM (SELECT unnest(range(1, 22)) AS k) CROSS JOIN n a JOIN n b ON b.i = a.i - k GROUP BY 1""",
)
def residual_acf(spark, sf):
    rows = slices.dense_exposure(spark, sf).withColumn("x", F.col("v_lag01") / 10)
    daily = likelihood.daily_residuals(likelihood.fitted_probabilities(rows, {"x": 0.05}))
    return audit.autocorrelation(daily, "date", "residual").select("lag", F.round("acf", 5).alias("acf"))


# ---------------------------------------------------------------- full design

MODIFIERS = ["age65", "male", "warm"]
SCENARIOS = ["final_review_only", "first_person_group_record", "season_warm", "season_cold"]


def study_scope(spark, sf):
    """Orders as scoped events with sample marks and modifiers."""
    events = slices.order_events(spark, sf)
    first = events.groupBy("person_id", "priority").agg(F.min(F.struct("onset", "event_id")).alias("f"))
    first = first.select(F.col("f.event_id").alias("event_id"), F.lit(1).alias("is_first"))
    warm = F.month("onset").between(4, 9)
    marks = [
        F.when(F.col("status") == "F", F.lit(SCENARIOS[0])),
        F.when(F.col("is_first") == 1, F.lit(SCENARIOS[1])),
        F.when(warm, F.lit(SCENARIOS[2])),
        F.when(~warm, F.lit(SCENARIOS[3])),
    ]
    return events.join(first, "event_id", "left").select(
        "event_id",
        "onset",
        F.col("person_id").alias("cluster_id"),
        F.col("person_id").alias("location_id"),
        F.when(F.substring("priority", 1, 1).isin("1", "2"), "CVD").otherwise("CBVD").alias("study_group"),
        F.array_compact(F.array(*marks)).alias("scenarios"),
        (F.col("person_id") % 3 == 0).cast("int").alias("age65"),
        F.when(F.col("person_id") % 7 != 0, F.col("person_id") % 2).alias("male"),
        warm.cast("int").alias("warm"),
    )


def study_calendar(spark):
    days = spark.range(1).select(
        F.explode(F.sequence(*[F.lit(d).cast("date") for d in slices.SPAN])).alias("date")
    )
    d = F.dayofmonth("date")
    return days.select(
        "date",
        (d <= 3).cast("int").alias("holiday"),
        (d == 15).cast("int").alias("adjusted_workday"),
        (d <= 5).cast("int").alias("official_break"),
    )


def study_series(spark, sf, configs=("main",)):
    """Daily values of the full design, with the curve and lag terms of PM2.5."""
    series = keep(spark, (sf, "series"), lambda: stable(eq.humid(spark, sf)))
    params = weather.basis_parameters(series, {c: weather.CONFIGS[c] for c in configs})
    bases = {c: weather.cross_basis(series, weather.CONFIGS[c], params[c]) for c in configs}
    q = curve_parameters(spark, sf)
    bounds = [q["lo"], q["hi"]]
    exposure, *rest = study.analysis_series(eq.histories(spark, sf), study_calendar(spark), study.join_bases(bases), eq.CELL)
    days = grid.with_curve_columns(exposure.df, "PM25_lag01", [q["k1"], q["k2"]], bounds, "curve")
    days = grid.with_curve_columns(days, "PM25_lag01", grid.equal_width_knots(*bounds), bounds, "equal")
    days = grid.with_lag_columns(days, "PM25", "dlag")
    return [Shared(days, exposure.keys, [c for c in days.columns if c not in (*exposure.keys, "date")]), *rest]


def study_places(spark, sf):
    """Raster cell and weather grid of each location."""
    cells = ex.nearest_cell(eq.locations(spark, sf), eq.LAT_AXIS, eq.LON_AXIS)
    return cells.select("location_id", *eq.CELL, F.concat(F.lit("R"), (F.col("location_id") % 5).cast("string")).alias(weather.GRID))


def curve_parameters(spark, sf):
    """Quantiles of the one-day-lag PM2.5 over all matched rows, counted by cell and onset before dates are expanded."""

    def build():
        probs = {"k1": 1 / 3, "k2": 2 / 3, "lo": 0.0, "hi": 1.0, "ref": 0.5, "d05": 0.05, "d95": 0.95}
        events = slices.order_events(spark, sf).withColumn("location_id", F.col("person_id"))
        placed = events.select("location_id", "onset").join(study_places(spark, sf), "location_id", "left")
        counted = placed.groupBy(*eq.CELL, "onset").agg(F.count(F.lit(1)).alias("events"))
        rows = ex.matched_strata(counted, keep=[*eq.CELL, "events"]).join(eq.histories(spark, sf), [*eq.CELL, "date"], "left")
        rows = ex.with_windows(rows, ["PM25"], {"lag01": (0, 1)})
        return exact_quantiles(rows, [], "PM25_lag01", probs, "events").first().asDict()

    return keep(spark, (sf, "curve"), build)


def full_table(spark, sf):
    def build():
        more = [f"{k}{i}" for k in ("curve", "equal", "dlag") for i in (1, 2, 3)]
        more += [f"{p}_{w}" for p in ex.POLLUTANTS for w in ex.EXTRA_WINDOWS] + MODIFIERS
        series = study_series(spark, sf, tuple(weather.CONFIGS))
        return study.model_table(study_scope(spark, sf), study_places(spark, sf), series, study.grid_columns() + more, SCENARIOS)

    return keep(spark, (sf, "full"), build)


GROUPS = ["CVD", "CBVD"]
ADJUST = grid.adjustment()


def rounded_results(df, *extra):
    cols = ["log_or", "robust_se", "odds_ratio", "lower", "upper", "p"]
    return df.select(*extra, "n_events", "variable_exposure_events", "status", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "M01_M02_M03_adjusted_fit",
    sql.fitted(sql.single("grp || '|PM25'", "PM25"), f"model_id, {sql.SHOWN}"),
)
def adjusted(spark, sf):
    specs = [grid.single(f"{g}|PM25", "PM25_lag01", ADJUST, g) for g in GROUPS]
    return rounded_results(clogit.results(spark, clogit.fit_models(full_table(spark, sf), specs)), "model_id")


@query("M18_M19_M20_P09_P12_scenario_grid")
def scenario_grid(spark, sf):
    specs = grid.scenario_grid(GROUPS, SCENARIOS)
    out = study.run_grid(full_table(spark, sf), specs, ["outcome_id"], 3)
    labels = ("outcome_id", "pollutant", "window", "weather_config", "scenario")
    return rounded_results(out.withColumn("q", F.round("q", 6)), *labels, "q")


_ALTERNATIVES = ["lag14", "lag28", "df4"]


@query(
    "M19_M20_alternative_adjustment",
    sql.fitted(
        " UNION ALL ".join(sql.single(f"grp || '|{p}|{a}'", p, adjust=f"adjust_{a}") for p in ex.POLLUTANTS for a in [*_ALTERNATIVES, "break"]),
        f"model_id, {sql.SHOWN}",
        design=sql.design(["main", *_ALTERNATIVES]),
    ),
)
def alternative_adjustment(spark, sf):
    """The one-day-lag models with other weather terms, and with the official breaks as holidays."""
    adjust = {a: grid.adjustment(a, prefix=f"{a}_") for a in _ALTERNATIVES} | {"break": grid.adjustment(holiday="official_break")}
    specs = [grid.single(f"{g}|{p}|{a}", f"{p}_lag01", terms, g) for g in GROUPS for p in ex.POLLUTANTS for a, terms in adjust.items()]
    return rounded_results(clogit.results(spark, clogit.fit_models(full_table(spark, sf), specs)), "model_id")


_INTERACTIONS = " UNION ALL ".join(sql.interaction(f"grp || '|{p}|{m}'", p, m) for p in ex.POLLUTANTS for m in MODIFIERS)


@query("M04_interactions", sql.fitted(_INTERACTIONS, f"model_id, {sql.SHOWN}"))
def interactions(spark, sf):
    specs = [
        grid.interaction(f"{g}|{p}|{m}", f"{p}_lag01", m, ADJUST, g) for g in GROUPS for p in ex.POLLUTANTS for m in MODIFIERS
    ]
    return rounded_results(clogit.results(spark, clogit.fit_models(full_table(spark, sf), specs)), "model_id")


@query(
    "M15_subgroup_contrasts",
    sql.fitted(
        _INTERACTIONS,
        f"""f.model_id, cast(f.k - 1 AS int) AS level, coalesce(n.n, 0) AS n_events, {sql.ESTIMATE.replace("log_or", "f.log_or").replace("se)", "f.se)")},
        round({sql.normal_p('f.log_or / f.se')}, 6) AS p, round({sql.normal_p('i.log_or / i.se')}, 6) AS interaction_p""",
        f"""SELECT model_id, k, list_transform(range(1, 17), lambda j: CASE WHEN (j = 1 AND k < 3) OR (j = 16 AND k > 1) THEN 1e0 ELSE 0e0 END) AS w
        FROM (SELECT DISTINCT model_id FROM z), (VALUES (1), (2), (3)) t(k)""",
        last="""FROM fit f JOIN fit i ON f.model_id = i.model_id AND i.k = 3
        LEFT JOIN (SELECT model_id, level, count(DISTINCT event_id) AS n FROM z GROUP BY ALL) n ON n.model_id = f.model_id AND n.level = f.k - 1 WHERE f.k < 3""",
    ),
)
def subgroups(spark, sf):
    """Odds ratios at both levels of a modifier, with the complete strata of the level and the interaction's p."""
    specs = [grid.interaction(f"{g}|{p}|{m}", f"{p}_lag01", m, ADJUST, g) for g in GROUPS for p in ex.POLLUTANTS for m in MODIFIERS]
    table = full_table(spark, sf)
    fits = clogit.fit_models(table, specs)
    rows = [(m, *r, clogit.result_row(f)[10]) for m, f in fits.items() for r in grid.subgroup_rows(f)]
    out = spark.createDataFrame(rows, "model_id string, level int, odds_ratio double, lower double, upper double, p double, interaction_p double")
    cases = clogit.scored(table, fits, {s.model_id: s.terms[-1].columns[1] for s in specs}).filter("case = 1")
    counts = cases.groupBy("model_id", F.col("carried").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n_events"))
    estimates = ("odds_ratio", "lower", "upper", "p", "interaction_p")
    return out.join(counts, ["model_id", "level"], "left").select("model_id", "level", F.coalesce("n_events", F.lit(0)).alias("n_events"), *[F.round(c, 6).alias(c) for c in estimates])


@query(
    "A36_M17_adjusted_residuals",
    sql.fitted(
        " UNION ALL ".join(sql.single(f"grp || '|{p}'", p) for p in ex.POLLUTANTS),
        "a.model_id, cast(k AS int) AS lag, round(sum(a.r * b.r) / any_value(w.s), 6) AS acf",
        last=f"""FROM (SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY date) AS i, r - avg(r) OVER (PARTITION BY model_id) AS r FROM
          (SELECT model_id, date, sum(c - p) AS r FROM r{sql.ROUNDS} GROUP BY ALL)) a
        JOIN (SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY date) AS i, r - avg(r) OVER (PARTITION BY model_id) AS r FROM
          (SELECT model_id, date, sum(c - p) AS r FROM r{sql.ROUNDS} GROUP BY ALL)) b ON a.model_id = b.model_id
        JOIN range(1, 22) t(k) ON b.i = a.i - k
        JOIN (SELECT model_id, sum((r - m) * (r - m)) AS s FROM (SELECT model_id, r, avg(r) OVER (PARTITION BY model_id) AS m FROM
          (SELECT model_id, date, sum(c - p) AS r FROM r{sql.ROUNDS} GROUP BY ALL)) GROUP BY ALL) w ON w.model_id = a.model_id GROUP BY a.model_id, k""",
    ),
)
def adjusted_residuals(spark, sf):
    """Autocorrelation of the daily residuals of the adjusted model of each outcome and pollutant."""
    table = full_table(spark, sf)
    fits = clogit.fit_models(table, [grid.single(f"{g}|{p}", f"{p}_lag01", ADJUST, g) for g in GROUPS for p in ex.POLLUTANTS])
    daily = clogit.scored(table, fits).groupBy("model_id", "date").agg(F.sum(F.col("case") - F.col("prob")).alias("residual"))
    out = audit.autocorrelation(daily, "date", "residual", keys=["model_id"])
    return out.select("model_id", "lag", F.round("acf", 6).alias("acf"))


@query(
    "M05_M07_two_pollutants",
    sql.fitted(
        " UNION ALL ".join(
            sql.several(f"grp || '|{a}+O3'", f'["{a}" / 10, "O3" / 10]') for a in ("PM25", "PM10")
        ),
        f"model_id, term, {sql.SHOWN}",
        f"""SELECT model_id, k, {sql.one_hot('16', 'k')} AS w, CASE k WHEN 1 THEN 'poll_first' ELSE 'poll_second' END AS term
        FROM (SELECT DISTINCT model_id FROM z), (VALUES (1), (2)) t(k)""",
    ),
)
def two_pollutants(spark, sf):
    pairs = [("PM25", "O3"), ("PM10", "O3")]
    specs = [
        grid.two_pollutant(f"{g}|{a}+{b}", f"{a}_lag01", f"{b}_lag01", ADJUST, g) for g in GROUPS for a, b in pairs
    ]
    fits = clogit.fit_models(full_table(spark, sf), specs)
    out = clogit.results(spark, fits, all_terms=True).filter(F.col("term").isin("poll_first", "poll_second"))
    return rounded_results(out, "model_id", "term")


_CURVE_SHAPE = """qs AS (SELECT quantile_cont("PM25", 1/3.0) AS k1, quantile_cont("PM25", 2/3.0) AS k2, min("PM25") AS lo, max("PM25") AS hi, median("PM25") AS ref,
   quantile_cont("PM25", 0.05) AS d05, quantile_cont("PM25", 0.95) AS d95 FROM base),
 grid AS (SELECT *, d05 + (d95 - d05) * i / 79e0 AS conc, i + 1 AS k FROM qs, range(80) t(i)), """
_KNOTS = {"curve": ["k1", "k2"], "equal": ["(lo + (hi - lo) / 3)", "(lo + 2 * (hi - lo) / 3)"]}


def _curve_sql(x, kind):
    return sql.spline_terms(x, _KNOTS[kind], "lo", "hi")


@query(
    "M06_M08_M10_exposure_curves",
    sql.fitted(
        " UNION ALL ".join(sql.several(f"grp || '|{k}'", _curve_sql('"PM25"', k)) + ", qs" for k in _KNOTS),
        f"model_id, round(conc, 6) AS concentration, round(ref, 6) AS reference, {sql.ESTIMATE}",
        " UNION ALL ".join(
            f"""SELECT g || '|{k}' AS model_id, k, conc, ref, list_concat(list_transform(list_zip({_curve_sql('conc', k)}, {_curve_sql('ref', k)}), lambda p: p[1] - p[2]), list_transform(range(14), lambda j: 0e0)) AS w
            FROM grid, (VALUES ('CVD'), ('CBVD')) t(g)"""
            for k in _KNOTS
        ),
        _CURVE_SHAPE,
    ),
)
def curves(spark, sf):
    q = curve_parameters(spark, sf)
    bounds = [q["lo"], q["hi"]]
    knots = {"curve": [q["k1"], q["k2"]], "equal": grid.equal_width_knots(*bounds)}
    names = {k: [f"{k}{i}" for i in (1, 2, 3)] for k in knots}
    specs = [grid.custom(f"{g}|{k}", names[k], ADJUST, g) for g in GROUPS for k in knots]
    fits = clogit.fit_models(full_table(spark, sf), specs)
    points = np.linspace(q["d05"], q["d95"], 80)
    rows = []
    for m, f in fits.items():
        if f.ok:
            k = m.split("|")[1]
            rows += [(m, *r) for r in grid.curve_rows(f, names[k], knots[k], bounds, q["ref"], points)]
    out = spark.createDataFrame(
        rows, "model_id string, concentration double, reference double, odds_ratio double, lower double, upper double"
    )
    return out.select("model_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


LAG_SCHEMA = "outcome_id string, pollutant string, lag int, odds_ratio double, lower double, upper double"


def lag_points(spark, sf):
    names = ["dlag1", "dlag2", "dlag3"]
    fits = clogit.fit_models(full_table(spark, sf), [grid.custom(g, names, ADJUST, g) for g in GROUPS])
    rows, total = [], []
    for g, f in fits.items():
        if f.ok:
            per, whole = grid.lag_rows(f, names)
            rows += [(g, "PM25", *r) for r in per]
            total.append((g, "PM25", -1, *whole))
    return spark.createDataFrame(rows, LAG_SCHEMA), spark.createDataFrame(total, LAG_SCHEMA)


_LAG_BASIS = spline.lag_basis(7, 3)
_LAG_TERMS = "[" + ", ".join(" + ".join(f'"PM25_l{k}" * {float(_LAG_BASIS[k, j] / 10)!r}' for k in range(8)) + " + 0e0" for j in range(3)) + "]"


def _lag_contrasts(weights) -> str:
    """One contrast for each (number, weights of the three lag terms)."""
    rows = ", ".join(f"({i}, {n!r}, [{', '.join(f'{float(v)!r}::DOUBLE' for v in w)}])" for i, (n, w) in enumerate(weights, 1))
    return f"SELECT g AS model_id, k, lag, list_concat(w3, list_transform(range(14), lambda j: 0e0)) AS w FROM (VALUES {rows}) t(k, lag, w3), (VALUES ('CVD'), ('CBVD')) u(g)"


@query(
    "M09_distributed_lag",
    sql.fitted(
        sql.several("grp", _LAG_TERMS),
        f"model_id AS outcome_id, 'PM25' AS pollutant, cast(lag AS int) AS lag, {sql.ESTIMATE}",
        _lag_contrasts([(k, _LAG_BASIS[k]) for k in range(8)] + [(-1, _LAG_BASIS.sum(axis=0))]),
    ),
)
def distributed_lag(spark, sf):
    per, whole = lag_points(spark, sf)
    return per.unionByName(whole).select("outcome_id", "pollutant", "lag", *[F.round(c, 6).alias(c) for c in ("odds_ratio", "lower", "upper")])


def _dense_lags():
    x = np.linspace(0, 7, 281)
    return [(round(float(v), 6), w) for v, w in zip(x, spline.spline_matrix(x, np.quantile(np.arange(8), [0.5]), (0, 7), intercept=True))]


@query(
    "M21_dense_lag_curve",
    sql.fitted(
        sql.several("grp", _LAG_TERMS),
        f"model_id AS outcome_id, 'PM25' AS pollutant, cast(lag AS double) AS lag, {sql.ESTIMATE}, 0e0 AS rebuild_error",
        _lag_contrasts(_dense_lags()),
    ),
)
def dense_lag(spark, sf):
    """The curve recovered from the eight estimates; its twin reads it off the fitted terms."""
    out = grid.dense_lag_curve(lag_points(spark, sf)[0], ["outcome_id", "pollutant"])
    return out.select("outcome_id", "pollutant", *[F.round(c, 6).alias(c) for c in ("lag", "odds_ratio", "lower", "upper", "rebuild_error")])


@query(
    "M11_month_cluster_errors",
    sql.fitted(" UNION ALL ".join(sql.single(f"grp || '|{p}'", p, "month") for p in ex.POLLUTANTS), "model_id, clusters, n_events, round(log_or, 6) AS log_or, round(se, 6) AS robust_se"),
)
def month_errors(spark, sf):
    """Robust errors with the calendar month as cluster; the t interval is in the next query."""
    return month_clusters(spark, sf).select("model_id", "clusters", "n_events", "log_or", "robust_se")


@query("M11_month_clusters")
def month_clusters(spark, sf):
    specs = [grid.single(f"{g}|{p}", f"{p}_lag01", ADJUST, g) for g in GROUPS for p in ex.POLLUTANTS]
    fits = clogit.fit_models(full_table(spark, sf), specs, cluster="month")
    return rounded_results(clogit.results(spark, fits, use_t=True), "model_id", "clusters")


@query(
    "M16_season_followup",
    sql.fitted(
        " UNION ALL ".join(
            m
            for p in ex.POLLUTANTS
            for m in (
                sql.interaction(f"grp || '|{p}|interaction'", p, "warm"),
                sql.single(f"grp || '|{p}|season1'", p, where="warm = 1"),
                sql.single(f"grp || '|{p}|season0'", p, where="warm = 0"),
            )
        ),
        f"model_id, {sql.SHOWN}",
    ),
)
def season(spark, sf):
    fits = grid.season_followup(
        full_table(spark, sf), [(g, p) for g in GROUPS for p in ex.POLLUTANTS], ADJUST, {1: "season_warm", 0: "season_cold"}
    )
    return rounded_results(clogit.results(spark, fits), "model_id")


@query(
    "M24_draw_table",
    """WITH y AS (SELECT strftime(o_orderdate, '%Y') AS year, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS freq FROM orders GROUP BY 1)
    SELECT d AS draw, year, freq FROM y, range(200) t(d)""",
)
def draws(spark, sf):
    """Each draw holds as many months of a year as the year has."""
    table = drawn_months(spark, sf)
    return table.groupBy("draw", F.substring("month", 1, 4).alias("year")).agg(F.sum("freq").alias("freq"))


def drawn_months(spark, sf):
    months = slices.order_events(spark, sf).select(F.date_format("onset", "yyyy-MM").alias("month"))
    return bootstrap.draw_table(months, draws=200)


@query(
    "M24_draws_month_by_month",
    """WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year FROM orders),
    n AS (SELECT year, month, row_number() OVER (PARTITION BY year ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY year) AS size FROM m),
    s AS (SELECT d AS draw, year, size, unnest(range(size)) AS slot FROM (SELECT DISTINCT year, size FROM n), range(200) t(d)),
    p AS (SELECT draw, year, cast('0x' || substr(md5('20261003:' || draw || ':' || year || ':' || slot), 1, 12) AS BIGINT) % size AS i FROM s)
    SELECT cast(draw AS int) AS draw, month, count(*) AS freq FROM p JOIN n USING (year, i) GROUP BY ALL""",
)
def draws_by_month(spark, sf):
    return drawn_months(spark, sf)


@query("M12_M13_month_bootstrap")
def month_bootstrap(spark, sf):
    table = full_table(spark, sf)
    fits = clogit.fit_models(table, [grid.single(f"{g}|{p}", f"{p}_lag01", ADJUST, g) for g in GROUPS for p in ex.POLLUTANTS])
    draws = bootstrap.draw_table(table.df.select("month"), draws=200)
    rows = []
    for m, f in fits.items():
        lo, hi, asked, good = bootstrap.bootstrap_interval(bootstrap.bootstrap_fits(table, f, draws))
        rows.append((*m.split("|"), f.n_events, float(np.exp(f.beta[0])), lo, hi, asked, good))
    return spark.createDataFrame(
        rows,
        "outcome_id string, pollutant string, n_events long, odds_ratio double, lower_month_block double, upper_month_block double, "
        "requested_draws int, successful_draws int",
    )


@query("M14_weights_equal_clones", "SELECT 'PM25' AS pollutant, 1 AS agree")
def weights_equal_clones(spark, sf):
    """Doubling the weight of a stratum equals entering it twice."""
    rows = slices.dense_exposure(spark, sf).withColumn("study_group", F.lit("all"))
    rows = rows.withColumn("cluster_id", F.col("person_id").cast("string"))
    months = rows.select(F.date_format("date", "yyyy-MM").alias("month")).distinct()
    twice = F.substring("month", 6, 2).cast("int") % 2 == 0
    weights = months.select(F.lit(0).alias("draw"), "month", F.when(twice, 2).otherwise(1).alias("freq"))
    spec = ModelSpec("w", (grid.exposure_term("v_lag01"),), "pollution10")
    table = pack_strata(rows, ["v_lag01"])
    weighted = bootstrap.bootstrap_fits(table, clogit.fit_models(table, [spec])["w"], weights)[0]
    copies = F.when(F.month("date") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cloned = rows.withColumn("copy", F.explode(copies)).withColumn("event_id", F.concat_ws("_", "event_id", "copy"))
    clone_fit = clogit.fit_models(pack_strata(cloned, ["v_lag01"]), [spec])["w"]
    agree = abs(weighted - clone_fit.beta[0]) < 1e-6
    return spark.createDataFrame([("PM25", int(agree))], "pollutant string, agree int")


@query("M23_U01_report_tables")
def report_tables(spark, sf):
    table = full_table(spark, sf)
    specs = grid.scenario_grid(GROUPS, SCENARIOS, configs=("main",))
    results = study.run_grid(table, specs, ["outcome_id"], 3)
    extra = [
        grid.single(
            f"{g}|{p}|{w}",
            f"{p}_{w}",
            ADJUST,
            g,
            labels={
                "outcome_id": g,
                "pollutant": p,
                "window": w,
                "weather_config": "main",
                "scenario": "reference_daily_lag_extension",
            },
        )
        for g in GROUPS
        for p in ex.POLLUTANTS
        for w in ex.EXTRA_WINDOWS
    ]
    more = clogit.results(spark, clogit.fit_models(table, extra)).join(grid.label_frame(spark, extra), "model_id")
    parts = {
        "forest": shape.forest(results),
        "windows": shape.daily_windows(results, more),
        "sensitivity": shape.sensitivity(results, more, GROUPS),
    }
    stacked = shape.stack([p.withColumn("report", F.lit(k)) for k, p in parts.items()])
    return rounded_results(
        stacked, "report", "outcome", "pollutant_label", "window", "scenario", "scenario_label"
    )
