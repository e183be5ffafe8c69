"""Model engine against numpy optima on synthetic strata."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchstrata.models import bootstrap, clogit, grid, likelihood, strata
from matchstrata.models.clogit import ModelSpec, Term
from matchstrata.models.strata import pack_strata
from matchstrata.operators import exposure, validate

DATES = [dt.date(2024, 6, 3), dt.date(2024, 6, 10), dt.date(2024, 6, 17), dt.date(2024, 6, 24)]
ADJUST = [f"temp_cb{i}" for i in range(1, 10)] + ["rh_ns1", "rh_ns2", "rh_ns3", "holiday", "adjusted_workday"]


def simulate(n=1800, beta=0.18, seed=20261002):
    rng = np.random.default_rng(seed)
    x = rng.uniform(5, 90, (n, 4))
    z = rng.normal(size=(n, 4))
    p = np.exp(beta * x / 10)
    p /= p.sum(axis=1, keepdims=True)
    case = np.array([rng.choice(4, p=q) for q in p])
    return x, z, case


@pytest.fixture(scope="module")
def data():
    return simulate()


@pytest.fixture(scope="module")
def rows(spark, data):
    x, z, case = data
    out = [
        (f"S{i}", "hot" if i % 3 == 0 else f"P{i % 600}", f"L{i}", DATES[j], int(case[i] == j), float(x[i, j]), float(z[i, j]))
        for i in range(len(x))
        for j in range(4)
    ]
    df = spark.createDataFrame(out, "event_id string, cluster_id string, location_id string, date date, case int, PM25_lag01 double, z double")
    return df.select("*", F.lit("all").alias("study_group"), *[F.lit(0.0).alias(c) for c in ADJUST])


@pytest.fixture(scope="module")
def table(rows):
    return pack_strata(rows, ["PM25_lag01", "z", *ADJUST])


def newton(cols, case, weights=None):
    """Plain numpy conditional likelihood."""
    d = np.stack(cols, axis=-1)
    n, _, k = d.shape
    w = np.ones(n) if weights is None else weights
    b = np.zeros(k)
    for _ in range(30):
        eta = d @ b
        p = np.exp(eta - eta.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        mean = np.einsum("ij,ijk->ik", p, d)
        u = d[np.arange(n), case] - mean
        info = np.einsum("i,ij,ijk,ijl->kl", w, p, d, d) - np.einsum("i,ik,il->kl", w, mean, mean)
        b = b + np.linalg.solve(info, (w[:, None] * u).sum(0))
    return b, u, np.linalg.inv(info)


def sandwich(u, bread, clusters):
    meat = np.zeros_like(bread)
    for c in set(clusters):
        s = u[np.array(clusters) == c].sum(0)
        meat += np.outer(s, s)
    return bread @ meat @ bread


def test_recovers_the_effect_and_drops_constant_terms(spark, rows, table):
    assert validate.stratum_violations(rows).isEmpty()
    fit = clogit.fit_models(table, [grid.single("m", "PM25_lag01", tuple(Term(c, (c,)) for c in ADJUST))])["m"]
    assert fit.ok and abs(fit.beta[0] - 0.18) < 0.05
    assert fit.kept.tolist() == [True] + [False] * len(ADJUST)
    assert clogit.result_row(fit, "holiday")[-1] == "term_not_estimable"


def test_equals_the_independent_optimum_and_sandwich(table, data):
    x, z, case = data
    spec = ModelSpec("m", (grid.exposure_term("PM25_lag01"), Term("z", ("z",)), Term("xz", ("PM25_lag01", "z"), 0.1)), "pollution10")
    fit = clogit.fit_models(table, [spec])["m"]
    b, u, bread = newton([x / 10, z, x * z / 10], case)
    clusters = ["hot" if i % 3 == 0 else f"P{i % 600}" for i in range(len(x))]
    assert np.abs(fit.beta - b).max() < 1e-6
    assert np.allclose(fit.robust, sandwich(u, bread, clusters), rtol=1e-6)
    assert fit.clusters == len(set(clusters))
    by_month = clogit.fit_models(table, [spec], cluster="month")["m"]
    assert by_month.clusters == 1


def test_missing_value_removes_exactly_its_stratum(rows):
    hole = (F.col("event_id") == "S1") & (F.col("date") == F.lit("2024-06-10").cast("date"))
    bad = rows.withColumn("PM25_lag01", F.when(~hole, F.col("PM25_lag01")))
    left = exposure.complete_strata(bad, ["PM25_lag01"])
    assert left.count() == 1799 * 4 and left.filter("event_id = 'S1'").isEmpty()
    fit = clogit.fit_models(pack_strata(bad, ["PM25_lag01"]), [ModelSpec("m", (grid.exposure_term("PM25_lag01"),), "pollution10")])["m"]
    assert (fit.n_before, fit.n_events) == (1800, 1799)


def test_gates(spark, rows):
    few = pack_strata(rows.filter("substring(event_id, 1, 3) = 'S10' AND length(event_id) < 4"), ["PM25_lag01", "z"])
    spec = ModelSpec("m", (grid.exposure_term("PM25_lag01"),), "pollution10")
    fit = clogit.fit_models(few, [spec])["m"]
    assert fit.status == "insufficient_within_stratum_variation"
    assert clogit.results(spark, {"m": fit}).first()["odds_ratio"] is None


def test_weighted_bootstrap_equals_numpy(spark, data):
    x, _, case = data
    months = [(i % 12) + 1 for i in range(len(x))]
    first = [dt.date(2024, m, 1) for m in months]
    rows = [
        (f"S{i}", f"P{i}", first[i] + dt.timedelta(days=7 * j), int(case[i] == j), float(x[i, j]), "all")
        for i in range(len(x))
        for j in range(4)
    ]
    df = spark.createDataFrame(rows, "event_id string, cluster_id string, date date, case int, PM25_lag01 double, study_group string")
    table = pack_strata(df, ["PM25_lag01"])
    base = clogit.fit_models(table, [ModelSpec("m", (grid.exposure_term("PM25_lag01"),), "pollution10")])["m"]
    draws = bootstrap.draw_table(table.df.select("month"), draws=3, seed=7)
    got = bootstrap.bootstrap_fits(table, base, draws)
    freq = {(r["draw"], r["month"]): r["freq"] for r in draws.collect()}
    assert sum(v for (d, _), v in freq.items() if d == 0) == 12
    for d in range(3):
        w = np.array([float(freq.get((d, f"2024-{m:02d}"), 0)) for m in months])
        b, _, _ = newton([x / 10], case, w)
        assert got[d] == pytest.approx(b[0], abs=1e-7)


def test_fixed_beta_and_softmax(rows, data):
    x, _, case = data
    df = rows.withColumn("x", F.col("PM25_lag01") / 10)
    r = likelihood.fixed_beta(df, "x", 0.2).first()
    eta = 0.2 * x / 10
    want = eta[np.arange(len(x)), case].sum() - np.log(np.exp(eta).sum(1)).sum()
    assert r["loglik"] == pytest.approx(want)
    p = likelihood.fitted_probabilities(df, {"x": 0.2}).groupBy("event_id").agg(F.sum("prob").alias("s"))
    assert p.filter(F.abs(F.col("s") - 1) > 1e-12).isEmpty()


def test_curve_lag_and_subgroups(spark, rows, data):
    x, z, case = data
    knots, bounds = [30.0, 60.0], [5.0, 90.0]
    curved = grid.with_curve_columns(rows, "PM25_lag01", knots, bounds, "c")
    fit = clogit.fit_models(pack_strata(curved, ["c1", "c2", "c3"]), [grid.custom("m", ["c1", "c2", "c3"], ())])["m"]
    points = grid.curve_rows(fit, ["c1", "c2", "c3"], knots, bounds, 40.0, [20.0, 40.0, 80.0])
    assert points[1][2] == pytest.approx(1.0) and points[0][2] < 1 < points[2][2]
    lagged = rows.select("*", *[(F.col("PM25_lag01") * (1 - 0.1 * k) + F.col("z") * k).alias(f"PM25_l{k}") for k in range(8)])
    lagged = grid.with_lag_columns(lagged, "PM25", "d")
    names = ["d1", "d2"]
    fit = clogit.fit_models(pack_strata(lagged, ["d1", "d2", "d3"]), [grid.custom("m", ["d1", "d2", "d3"], ())])["m"]
    # Histories built from two series span two dimensions; the third term repeats them.
    assert fit.kept.tolist() == [True, True, False] and names
    half = rows.withColumn("male", (F.substring("event_id", -1, 1).cast("int") % 2))
    fit = clogit.fit_models(pack_strata(half, ["PM25_lag01", "male"]), [grid.interaction("m", "PM25_lag01", "male", ())])["m"]
    odd = np.array([i % 2 == 1 for i in range(len(x))])
    (_, or0, *_), (_, or1, *_) = grid.subgroup_rows(fit)
    assert math.log(or1) == pytest.approx(newton([x[odd] / 10], case[odd])[0][0], abs=1e-6)
    assert math.log(or0) == pytest.approx(newton([x[~odd] / 10], case[~odd])[0][0], abs=1e-6)


def test_dense_lag_curve_rebuilds_the_points(spark):
    from matchstrata.functions import spline

    basis = spline.lag_basis(7, 3)
    beta, cov = np.array([0.1, -0.05, 0.02]), np.diag([0.01, 0.02, 0.03])
    eta, se = basis @ beta, np.sqrt(np.einsum("ij,jk,ik->i", basis, cov, basis))
    pts = [("A", "PM25", k, math.exp(e), math.exp(e - 1.96 * s), math.exp(e + 1.96 * s)) for k, (e, s) in enumerate(zip(eta, se))]
    df = spark.createDataFrame(pts, "outcome_id string, pollutant string, lag int, odds_ratio double, lower double, upper double")
    out = grid.dense_lag_curve(df, ["outcome_id", "pollutant"]).toPandas()
    assert len(out) == 281 and out["rebuild_error"].max() < 1e-10
    assert out.loc[out["lag"] == 7, "odds_ratio"].iloc[0] == pytest.approx(math.exp(eta[7]))


def test_tails():
    assert clogit.normal_p(1.96) == pytest.approx(0.04999579, abs=1e-7)
    assert clogit.t_quantile(0.975, 35) == pytest.approx(2.030108, abs=1e-5)
    assert clogit.t_p(2.030108, 35) == pytest.approx(0.05, abs=1e-6)


def test_scored_rows_are_the_softmax_of_the_fit(spark, rows, data):
    """Probabilities of a two-term model by row, a carried column, and a stratum with a missing value left out."""
    x, z, case = data
    holed = rows.withColumn("z", F.when((F.col("event_id") == "S5") & (F.col("date") == DATES[1]), None).otherwise(F.col("z")))
    packed = pack_strata(holed, ["PM25_lag01", "z"])
    spec = ModelSpec("two", (grid.exposure_term("PM25_lag01"), Term("z", ("z",))), "pollution10")
    fit = clogit.fit_models(packed, [spec])["two"]
    got = {(r["event_id"], r["date"]): r for r in clogit.scored(packed, {"two": fit}, {"two": "z"}).collect()}
    eta = fit.beta[0] * x / 10 + fit.beta[1] * z
    p = np.exp(eta - eta.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert len(got) == 4 * (len(x) - 1) and not any(e == "S5" for e, _ in got)
    for i in range(0, len(x), 37):
        if i != 5:
            for j, day in enumerate(DATES):
                r = got[f"S{i}", day]
                assert r["prob"] == pytest.approx(p[i, j], abs=1e-9) and r["case"] == int(case[i] == j) and r["carried"] == pytest.approx(z[i, j])
    none = ModelSpec("none", (grid.exposure_term("PM25_lag01"),), "pollution10", group="nobody")
    assert clogit.scored(packed, clogit.fit_models(packed, [none])).collect() == []


def test_events_packed_over_shared_series_equal_packed_rows(spark):
    """Repeated events, events of two places, unknown places and days without values; the daily values are not copied to the events."""
    day = dt.date(2024, 6, 1)
    series = [(c, day + dt.timedelta(d), float(7 * d % 5 + c) if d % 9 else None) for c in (0, 1) for d in range(60)]
    series = spark.createDataFrame(series, "cell int, date date, x double")
    days = spark.createDataFrame([(day + dt.timedelta(d), d % 3) for d in range(60)], "date date, off int")
    events = [(i, day + dt.timedelta(i * 11 % 61), i % 2 if i % 13 else None, f"P{i % 5}", i % 2) for i in range(40)]
    events += [events[3]] * 2 + [(4, day, 1, "P4", 0), (50, None, 0, "P0", 1), (51, day + dt.timedelta(200), 0, None, None)]
    events = spark.createDataFrame(events, "event_id int, onset date, cell int, cluster_id string, male int")
    events = events.select("*", F.lit("all").alias("study_group"), F.array(F.lit("even")).alias("scenarios"))
    columns = ["x", "off", "male"]
    shared = [strata.Shared(series, ["cell"], ["x"]), strata.Shared(days, [], ["off"])]
    rows = exposure.matched_strata(events, keep=[c for c in events.columns if c != "onset"])
    wide = pack_strata(rows.join(series, ["cell", "date"], "left").join(days, "date", "left"), columns, ["even"])

    def packed(table):
        found = table.scan(columns, "event_id", "dates").drop("pos").collect()
        return sorted(str((r.event_id, r.study_group, r.cluster_id, r.month, r.bits, r.n, r.dates, r.v0, r.v1, r.v2)) for r in found)

    narrow = strata.pack_events(events, shared, columns, ["even"], parts=3)
    assert packed(narrow) == packed(wide)
    assert packed(strata.pack_events(events, shared, columns, ["even"], most=0)) == packed(wide)
    once = strata.pack_events(events.dropDuplicates(["event_id"]), shared, columns, ["even"])
    assert not {"v0", "v1", "v2"} & set(once.df.columns)
    twice = [strata.Shared(series.unionByName(series.filter("cell = 0")), ["cell"], ["x"]), shared[1]]
    more = rows.join(twice[0].df, ["cell", "date"], "left").join(days, "date", "left")
    assert packed(strata.pack_events(events, twice, columns, ["even"])) == packed(pack_strata(more, columns, ["even"]))


def test_alike_strata_are_gone_through_once(spark):
    """Fits, draws and person errors over pooled strata equal those over each event's own; a table of own arrays is left as it is."""
    day = dt.date(2024, 1, 1)
    series = spark.createDataFrame([(c, day + dt.timedelta(d), float(d * (7 + c) % 23)) for c in (0, 1) for d in range(366)], "cell int, date date, x double")
    events = [(i, day + dt.timedelta(i * 11 % 120), i % 2, f"P{i % 40}") for i in range(1500)]
    events = spark.createDataFrame(events, "event_id int, onset date, cell int, cluster_id string")
    marks = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("third"))).otherwise(F.array().cast("array<string>"))
    events = events.select("*", F.lit("all").alias("study_group"), marks.alias("scenarios"))
    shared = [strata.Shared(series, ["cell"], ["x"])]
    narrow = strata.pack_events(events, shared, ["x"], ["third"], parts=3)
    wide = strata.pack_events(events, shared, ["x"], ["third"], parts=3, most=0)
    pool = narrow.pooled(["x"])
    held = pool.df.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
    assert held["n"] <= 240 and held["w"] == 1500 and wide.pooled(["x"]) is wide
    assert narrow.pooled(["x"], ["third"]).df.filter("bits = 1").agg(F.sum("weight")).first()[0] == 500
    specs = [ModelSpec(n, (grid.exposure_term("x"),), "pollution10", scenario=s) for n, s in (("a", None), ("t", "third"))]
    one, two = clogit.fit_models(narrow, specs), clogit.fit_models(wide, specs)
    for m in one:
        assert one[m].ok and (one[m].n_events, one[m].n_varying, one[m].clusters) == (two[m].n_events, two[m].n_varying, two[m].clusters)
        assert one[m].beta == pytest.approx(two[m].beta, abs=1e-10) and one[m].robust.ravel() == pytest.approx(two[m].robust.ravel(), rel=1e-9)
    draws = bootstrap.draw_table(narrow.df.select("month"), draws=7)
    got, want = (bootstrap.bootstrap_fits(t, f["a"], draws) for t, f in ((narrow, one), (wide, two)))
    assert got == pytest.approx(want, abs=1e-9)
