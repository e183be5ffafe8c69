"""Ordered, grouped and skewed operators against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchstrata.core import ContractError
from matchstrata.operators import audit, clusters, exposure, registry, timeline, validate, weather
from matchstrata.operators.multiplicity import benjamini_hochberg
from matchstrata.operators.segments import Segmented, exact_quantiles

DAY = dt.date(2024, 1, 1)


def hot_events(n=3000, seed=1):
    """A third of all rows belong to one person."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        person = "hot" if rng.random() < 0.34 else f"p{rng.randrange(200)}"
        rows.append((i, person, rng.choice("AB"), DAY + dt.timedelta(days=rng.randrange(400)), rng.randrange(5)))
    return rows


SCHEMA = "event_id long, person string, code string, onset date, location int"


def test_previous_event_with_hot_key(spark):
    rows = hot_events()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["event_id"]: r["p"] for r in timeline.with_previous_event(df, ["person", "code"], "onset", "event_id").select("event_id", F.col("previous.event_id").alias("p")).collect()}
    want, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        want[r[0]] = last.get((r[1], r[2]))
        last[(r[1], r[2])] = r[0]
    assert got == want


def test_running_totals_cross_segments(spark):
    df = spark.createDataFrame([(k, i, (i * 7) % 11) for k in ("a", "b", None) for i in range(500)], "k string, i int, v int")
    out = Segmented(df, ["k"], ["i"], parts=8).with_running({"s": ("sum", "v"), "m": ("min", "v"), "x": ("max", "v")}).toPandas()
    assert len(out) == 1500
    for _, g in out.groupby("k", dropna=False):
        g = g.sort_values("i")
        assert (g["s"] == g["v"].cumsum()).all() and (g["m"] == g["v"].cummin()).all() and (g["x"] == g["v"].cummax()).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [("h" if rng.random() < 0.4 else f"g{rng.integers(5)}", float(v)) for v in rng.normal(size=4000)]
    df = spark.createDataFrame(rows + [("h", None)], "k string, v double")
    out = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.001, "b": 1 / 3, "c": 0.95}).collect()}
    for k, g in pd.DataFrame(rows, columns=["k", "v"]).groupby("k"):
        assert out[k]["n"] == len(g)
        assert np.allclose([out[k][c] for c in "abc"], np.quantile(g["v"], [0.001, 1 / 3, 0.95]))
    small = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    r = exact_quantiles(small, [], "v", {"q": 0.25, "t": 1 / 3}).first()
    assert (r["q"], r["t"]) == (1.75, 2.0)


def test_near_flags_and_pairs(spark):
    rows = hot_events(1500, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["event_id"]: r["near"] for r in timeline.flag_near(df, ["person", "code"], "onset").collect()}
    cross = {r["event_id"]: r["cross_near"] for r in timeline.flag_cross_code(df, ["person"], "code", "onset").collect()}
    cells = timeline.cross_code_cells(df, ["person"], "code", "onset", "location").agg(F.sum("n_pairs"), F.sum("n_location_conflict")).first()
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    pairs = conflicts = 0
    for rs in by.values():
        for i, a in enumerate(rs):
            near = any(b is not a and b[2] == a[2] and abs((b[3] - a[3]).days) <= 28 for b in rs)
            other = any(b[2] != a[2] and abs((b[3] - a[3]).days) <= 28 for b in rs)
            assert got[a[0]] == int(near) and cross[a[0]] == int(other)
            for b in rs[i + 1 :]:
                if a[2] != b[2] and abs((b[3] - a[3]).days) <= 28:
                    pairs += 1
                    conflicts += a[4] != b[4]
    assert tuple(cells) == (pairs, conflicts)


@pytest.mark.parametrize("days,starts", [([0, 10, 28, 29, 50, 58], [0, 29, 58]), ([0, 20, 40], [0, 40])])
def test_anchored_episodes(spark, days, starts):
    df = spark.createDataFrame([(i, "p", DAY + dt.timedelta(days=d)) for i, d in enumerate(days)], "event_id int, person string, onset date")
    opened = timeline.anchored_first(df, ["person"], "onset", "event_id").orderBy("onset").collect()
    assert [(r["onset"] - DAY).days for r in opened] == starts
    assert timeline.flag_near(df, ["person"], "onset").filter("near = 1").count() == len(days)


def greedy(rows):
    cards, events, out = set(), set(), []
    for r in rows:
        if r[1] is not None and r[1] in cards:
            out.append("card")
        elif r[2] in events:
            out.append("event")
        else:
            out.append("")
            events.add(r[2])
            if r[1] is not None:
                cards.add(r[1])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_deduplication(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *range(6), *range(40)]), rng.choice([*range(5), *range(60)])) for i in range(150)]
    if seed == 0:
        rows = [(0, 1, 10), (1, 2, 10), (2, 2, 11)]
    df = spark.createDataFrame(rows, "i int, card int, event int")
    for fold in (registry.FOLD, 3):
        got = registry.greedy_distinct(df, ["i"], {"card": ["card"], "event": ["event"]}, fold=fold).orderBy("i").collect()
        assert [r["reason"] for r in got] == greedy(rows)
    assert registry.greedy_distinct(df.limit(0), ["i"], {"card": ["card"], "event": ["event"]}).collect() == []


def test_greedy_deduplication_of_long_chains(spark):
    """A chain in which each row conflicts with the next: jobs grow with the logarithm of its length. A hot key is decided in the first round."""
    jobs, sc = {}, spark.sparkContext
    for n in (300, 10_000):
        rows = [(i, i // 2, (i + 1) // 2) for i in range(n)] + [(n + i, -1, -1 - i) for i in range(3000)]
        df = spark.createDataFrame(rows, "i int, card int, event int")
        sc.setJobGroup(f"chain {n}", "")
        got = registry.greedy_distinct(df, ["i"], {"card": ["card"], "event": ["event"]}).orderBy("i").collect()
        sc.setJobGroup("other", "")
        jobs[n] = len(sc.statusTracker().getJobIdsForGroup(f"chain {n}"))
        assert [r["reason"] for r in got] == greedy(rows)
    assert jobs[10_000] <= 2 * jobs[300] and jobs[10_000] < 1000


def test_components(spark):
    from matchstrata.operators.graph import components

    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(900 + i, 901 + i) for i in range(300)] + [(7, 7), (5000, 5001), (5001, 5000)]
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_referents_of_a_leap_day(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 2, 29))], "event_id int, onset date")
    rows = exposure.matched_strata(df).orderBy("date").collect()
    assert [r["date"].day for r in rows] == [1, 8, 15, 22, 29] and [r["case"] for r in rows] == [0, 0, 0, 0, 1]


def test_windows_and_rolling_need_every_part(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 2.0)], "v_l0 double, v_l1 double")
    got = exposure.with_windows(df, ["v"], {"lag01": (0, 1)}).collect()
    assert [r["v_lag01"] for r in got] == [2.0, None]
    rows = [("g", DAY + dt.timedelta(days=i), 10.0, float(i)) for i in range(6)]
    series = spark.createDataFrame(rows, "weather_grid_id string, date date, temp double, rh double")
    assert [r["rh_ma03"] for r in weather.rolling_mean(series, "rh").orderBy("date").collect()] == [None, None, None, 1.5, 2.5, 3.5]
    bad = spark.createDataFrame([rows[0], rows[2], ("h", DAY, None, 1.0), ("h", DAY, 1.0, 120.0)], series.schema)
    rules = {r["rule"] for r in validate.weather_violations(bad).collect()}
    assert rules == {"gap", "null", "range", "duplicate"}


def test_cross_basis_against_numpy(spark):
    rng = np.random.default_rng(5)
    temp = rng.normal(20, 5, 60)
    rows = [("g", DAY + dt.timedelta(days=i), float(t), 50.0 + i % 7) for i, t in enumerate(temp)]
    series = weather.rolling_mean(spark.createDataFrame(rows, "weather_grid_id string, date date, temp double, rh double"), "rh")
    config = weather.CONFIGS["lag14"]
    params = weather.basis_parameters(series, {"lag14": config})["lag14"]
    out = weather.cross_basis(series, config, params).orderBy("date").toPandas()
    from matchstrata.functions import spline

    tb = spline.spline_matrix(temp, params["temp_knots"], params["temp_bounds"])
    lb = spline.lag_basis(14, 3)
    for t in (13, 14, 40):
        want = np.array([[sum(tb[t - k, a] * lb[k, b] for k in range(15)) if t >= 14 else np.nan for b in range(3)] for a in range(3)])
        got = out.loc[t, [f"temp_cb{i + 1}" for i in range(9)]].to_numpy(float).reshape(3, 3)
        assert np.allclose(got, want, equal_nan=True)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, "f", 0.01), (2, "f", 0.04), (3, "f", 0.03), (4, "f", None)], "id int, fam string, p double")
    q = {r["id"]: r["q"] for r in benjamini_hochberg(df, ["fam"], "p", "id", 3).collect()}
    assert [q[1], q[2], q[3]] == pytest.approx([0.03, 0.04, 0.04]) and q[4] is None


def test_ranks_and_spearman(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    r = {x["v"]: x["r"] for x in audit.average_ranks(df, [], "v", "r").collect()}
    assert r == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": "a", "x": rng.integers(0, 9, 400).astype(float), "y": rng.normal(size=400)})
    got = audit.spearman(spark.createDataFrame(pdf), ["k"], "x", "y").first()["spearman_r"]
    assert got == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))


@pytest.mark.parametrize("lat,count", [(0.0, 60), (23.0, 240), (60.0, 300), (-75.0, 200)])
def test_leader_clusters(spark, lat, count):
    rng = random.Random(4)
    pts = []
    for i in range(count):
        key = "big" if i % 3 else f"k{i % 7}"
        pts.append((key, i, 113 + rng.random() * 0.006, lat + rng.random() * 0.006))
    df = spark.createDataFrame([*pts, ("big", -1, None, lat), ("big", -2, 113.0, None)], "k string, i int, lon double, lat double")
    found = clusters.leaders(df, "k", "i", "lon", "lat")
    got = {(r["k"], r["ord"]) for r in found.collect()}

    def metres(a, b):
        la, lb = np.radians(a[3]), np.radians(b[3])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371008.8 * np.arcsin(np.sqrt(h))

    want = {}
    for p in pts:
        led = want.setdefault(p[0], [])
        if all(metres(p, q) > 100 for q in led):
            led.append(p)
    assert got == {(k, p[1]) for k, led in want.items() for p in led}
    spread = {r["k"]: r for r in clusters.separation(found, "k").collect()}
    for k, led in want.items():
        assert spread[k]["clusters"] == len(led)
        far = max((metres(a, b) for a in led for b in led), default=0.0)
        assert spread[k]["max_separation_m"] == pytest.approx(far, abs=1e-6)


def test_contracts(spark):
    ok = spark.createDataFrame([("e", DAY + dt.timedelta(days=7 * i), int(i == 0), "l") for i in range(4)], "event_id string, date date, case int, location_id string")
    assert validate.stratum_violations(ok).isEmpty()
    assert validate.stratum_violations(ok.filter("case = 0")).count() == 1
    other = ok.withColumn("location_id", F.when(F.col("case") == 1, "m").otherwise("l"))
    assert validate.stratum_violations(other).count() == 1
    from matchstrata.core import collect_bounded

    with pytest.raises(ContractError):
        collect_bounded(ok, 2, "rows")


def test_nearest_grid(spark):
    """Against a full scan, with locations off the lattice, across the date line and without coordinates."""
    rng = random.Random(11)
    near = [(i, 112 + rng.random() * 3, 22 + rng.random() * 3) for i in range(60)]
    far = [(100, -60.0, -40.0), (101, 179.9, 23.0), (102, -179.9, 23.0), (103, 113.0, 89.5), (104, 300.0, 10.0)]
    locs = spark.createDataFrame([*near, *far, (200, None, 23.0), (201, 113.0, None)], "location_id int, longitude double, latitude double")
    for grids in (exposure.lattice(spark), spark.createDataFrame([("a", -179.5, 23.0), ("b", 178.0, 23.0)], "weather_grid_id string, longitude double, latitude double")):
        points = sorted(map(tuple, grids.select("weather_grid_id", "longitude", "latitude").collect()))
        got = {r["location_id"]: r for r in exposure.nearest_grid(locs, grids, "weather_grid_id").collect()}
        assert len(got) == len(near) + len(far) + 2 and got[200]["weather_grid_id"] is None and got[201]["weather_distance_km"] is None
        for i, x, y in near + far:
            p = np.radians([[y, g[2], x, g[1]] for g in points])
            h = np.sin((p[:, 1] - p[:, 0]) / 2) ** 2 + np.cos(p[:, 0]) * np.cos(p[:, 1]) * np.sin((p[:, 3] - p[:, 2]) / 2) ** 2
            km = 2 * 6371.0 * np.arcsin(np.sqrt(h))
            assert got[i]["weather_distance_km"] == pytest.approx(km.min(), abs=1e-6)
            if np.sort(km)[1] - km.min() > 1e-6:
                assert got[i]["weather_grid_id"] == points[int(km.argmin())][0]
    assert exposure.nearest_grid(locs, exposure.lattice(spark).limit(0), "weather_grid_id").count() == len(got)


def test_farthest_pair_of_a_key(spark):
    """Rings, discs, lines, copies, poles, the date line, and keys spread over the globe, against all pairs."""
    from matchstrata.operators import hull

    rng = np.random.default_rng(3)
    t = np.linspace(0, 2 * np.pi, 701)[:-1]
    shapes = {
        "ring": np.stack([113 + 0.2 * np.cos(t), 23 + 0.18 * np.sin(t)], 1),
        "disc": rng.normal([113, 23], 0.1, (900, 2)),
        "line": np.stack([np.linspace(100, 120, 60), np.zeros(60)], 1),
        "copies": np.repeat([[113.0, 23.0]], 40, 0),
        "one": np.asarray([[10.0, 10.0]]),
        "two": np.asarray([[10.0, 10.0], [10.5, 10.0]]),
        "pole": np.stack([rng.uniform(-180, 180, 300), rng.uniform(88, 90, 300)], 1),
        "date": np.stack([np.where(rng.random(300) < 0.5, 179.5, -179.5) + rng.normal(0, 0.1, 300), rng.normal(0, 0.1, 300)], 1),
        "globe": np.stack([rng.uniform(-180, 180, 300), rng.uniform(-80, 80, 300)], 1),
        "half": np.stack([rng.uniform(-40, 40, 300), rng.uniform(-30, 30, 300)], 1),
        "ends": np.asarray([[0.0, 0.0], [180.0, 0.0], [90.0, 10.0]]),
        None: rng.normal([5, 50], 0.3, (50, 2)),
    }
    rows = [(k, float(x), float(y)) for k, ps in shapes.items() for x, y in ps]
    rng.shuffle(rows := np.array(rows, dtype=object))
    df = spark.createDataFrame([tuple(r) for r in rows.tolist()], "k string, x double, y double")
    got = {r["k"]: r for r in clusters.separation(df, "k").collect()}
    for k, ps in shapes.items():
        lon, lat = np.radians(ps[:, 0]), np.radians(ps[:, 1])
        h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
        assert got[k]["clusters"] == len(ps)
        assert got[k]["max_separation_m"] == pytest.approx(2 * 6371008.8 * np.arcsin(np.sqrt(min(1.0, h.max()))), abs=1e-3 if k in ("globe", "ends") else 1e-6), k
    assert clusters.separation(df.limit(0), "k").collect() == []
    # A million points on one ring, all of them corners of its hull.
    t = rng.permutation(np.linspace(0, 2 * np.pi, 1_000_001)[:-1])
    x, y = 0.2 * np.cos(t), 0.1999 * np.sin(t)
    z = np.stack([x, y, np.ones_like(x)], 1) / np.sqrt(1 + x * x + y * y)[:, None]
    order = hull.hull(x, y)
    assert len(order) == 1_000_000
    assert hull.metres(hull.widest(z[order]), 1.0) == pytest.approx(2 * np.arctan(0.2), abs=1e-9)


def test_longest_prefix_in_dealt_districts(spark):
    """Against a scan of all prefixes, in one automaton for each district and in many small ones."""
    from matchstrata.functions import address as ad
    from matchstrata.operators import location

    rng = random.Random(8)
    names = ["天河区", "海珠区"]
    refs = sorted({(d, d + "".join(rng.choices("东沙石溪村", k=rng.randrange(1, 7)))) for d in names for _ in range(80)})
    rows = [(i, rng.choice([*names, "白云区", ""]) + "".join(rng.choices(["东", "沙", "石", "溪", "村", "1号"], k=rng.randrange(12)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "天河区" + "东沙石溪村" * 400), (1003, "海珠区天河区东村")]
    references = spark.createDataFrame([(d, p, f"{i},1", "村庄") for i, (d, p) in enumerate(refs)], "district string, prefix string, location string, level string")
    unresolved = spark.createDataFrame(rows, "query_id int, address string")
    want = {}
    for i, a in rows:
        if a:
            mine = [(len(p), p) for d, p in refs if p in a and d == next((x for x in ad.DISTRICTS if x in a), "")]
            if mine:
                want[i] = max(mine)[1]
    assert len(want) > 100
    for sizes in ((location.AUTOMATON, location.WALKERS), (7, 11)):
        got = location.longest_prefix(unresolved, references, *sizes).collect()
        assert {r["query_id"]: r["prefix"] for r in got} == want and len(got) == len(want)
    assert location.longest_prefix(unresolved.limit(0), references).collect() == []
    assert location.longest_prefix(unresolved, references.limit(0)).collect() == []


def test_rank_matrix_and_autocorrelation_by_key(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 300), "u": rng.integers(0, 9, 300).astype(float), "v": rng.normal(size=300), "w": rng.normal(size=300)})
    pdf.loc[::7, "u"], pdf.loc[::5, "w"] = np.nan, np.nan
    df = spark.createDataFrame(pdf).select("k", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "uvw"])
    got = {(r["k"], r["variable1"], r["variable2"]): r for r in audit.spearman_matrix(df, ["k"], ["u", "v", "w"]).collect()}
    assert len(got) == 6
    for (k, a, b), r in got.items():
        some = pdf[(pdf["k"] == k) & pdf[a].notna() & pdf[b].notna()]
        assert r["n"] == len(some) and r["spearman_r"] == pytest.approx(some[a].rank().corr(some[b].rank()))
    series = {k: rng.normal(size=n) for k, n in (("a", 60), ("b", 25))}
    daily = spark.createDataFrame([(k, DAY + dt.timedelta(days=2 * i), float(x)) for k, v in series.items() for i, x in enumerate(v)], "k string, date date, r double")
    got = {(r["k"], r["lag"]): r["acf"] for r in audit.autocorrelation(daily, "date", "r", 21, ["k"]).collect()}
    alone = {r["lag"]: r["acf"] for r in audit.autocorrelation(daily.where("k = 'a'"), "date", "r").collect()}
    for k, v in series.items():
        c = v - v.mean()
        for lag in range(1, 22):
            assert got[k, lag] == pytest.approx((c[lag:] * c[:-lag]).sum() / (c * c).sum())
    assert all(alone[lag] == pytest.approx(got["a", lag]) for lag in range(1, 22))


def test_locations_of_one_request_share_its_candidates(spark):
    """The audit is that of every location with all its candidates spelled out, but a request's cached candidates stay one set."""
    from matchstrata.functions import address as ad
    from matchstrata.operators import location as loc

    text = "广东省广州市天河区天河路{}号"
    places = [(i, text.format(5 + i % 2), 113.0 + (i % 5) * 1e-3, 23.0 + (i % 3) * 2e-5, "existing_amap") for i in range(24)]
    places += [(3, text.format(7), 113.0, 23.0, "existing_amap"), (30, None, 113.0, 23.0, "existing_amap")]
    rows = spark.createDataFrame(places, "location_id int, address string, longitude double, latitude double, coordinate_source string")
    rows = rows.select("*", F.col("longitude").alias("gcj_lon"), F.col("latitude").alias("gcj_lat"), ad.normalise(F.col("address")).alias("request"))
    rows = rows.select("*", *[F.lit(v).alias(c) for c, v in [("provider_level", "门牌号"), ("match_quality", ""), ("fuzzy_level", "")]])
    cached = [(text.format(5 + k % 3), 113.0 + (k % 7) * 1e-3, 23.0 + (k % 2) * 1e-5, text.format(5 + k % 2), "440106" if k % 6 else "440600", k) for k in range(60)]
    cached = spark.createDataFrame(cached, "address string, lon double, lat double, text string, adcode string, pos int")
    cached = cached.select("*", F.lit("amap").alias("provider"), F.lit("门牌号").alias("level"))
    own = [(i % 26, 113.0 + (i % 11) * 1e-3, 23.0, text.format(5 + i % 2), "440106", 100 + i) for i in range(90)]
    own = spark.createDataFrame(own, "location_id int, lon double, lat double, text string, adcode string, pos int")
    own = own.select("*", F.lit("amap").alias("provider"), F.lit("门牌号").alias("level"))
    asked = rows.select("location_id", "request", "address")
    pool = loc.candidate_pool(asked, cached, own)
    assert pool.shared.count() == pool.shared.select("request", "lon", "lat", "text").distinct().count() < 60
    spelled = asked.select("location_id", F.col("request").alias("address")).join(cached, "address").drop("address")
    alone = loc.candidate_pool(asked, cached.filter("1 = 0"), spelled.unionByName(own))

    def audited(p):
        return sorted(str(r.asDict()) for r in loc.audit_locations(rows.drop("request"), p).collect())

    found = audited(pool)
    assert found == audited(alone)
    assert any("'candidate_evidence_found': 1" in r for r in found) and any("'clusters': 9" in r or "'clusters': 10" in r or "'clusters': 11" in r for r in found)


def test_rows_without_a_key_are_dealt_out_in_a_join(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 100, F.col("id")).alias("k"), F.col("id").alias("u"))
    other = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how, n in (("left", 4000), ("left_anti", 3910)):
            held = registry.join_known(rows, other, ["k"], ["u"], how).rdd.glom().map(len).collect()
            assert sum(held) == n and max(held) < n / 4
        got = registry.join_known(rows, other, ["k"], ["u"]).filter("v IS NOT NULL").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[0])
        spark.conf.set("spark.sql.adaptive.enabled", kept[1])
    assert sorted((r["k"], r["v"]) for r in got) == [(i, 2 * i) for i in range(90)]


def test_leaders_of_few_points_equal_those_of_rounds(spark):
    rng = random.Random(5)
    points = [(k, i // 2, 113 + rng.random() * 0.004, 23 + rng.random() * 0.004) for k in range(12) for i in range(10 * (k + 1))]
    points += points[:30] + [(50, i, None, 23.0) for i in range(3)]
    df = spark.createDataFrame(points, "k long, i long, lon double, lat double")
    rounds = sorted(clusters.leaders(df, "k", "i", "lon", "lat", few=0).collect())
    for few in (45, 10_000):
        assert sorted(clusters.leaders(df, "k", "i", "lon", "lat", few=few).collect()) == rounds


def test_trimmed_strata_take_as_many_tasks_as_asked(spark):
    df = spark.createDataFrame([(e, float(e + d)) for e in range(50) for d in range(4)], "event_id long, a double")
    got = exposure.trim_strata(df, "a", 3.0, 40.0, parts=21)
    assert got.rdd.getNumPartitions() == 21
    assert sorted(got.collect()) == sorted(exposure.trim_strata(df, "a", 3.0, 40.0).collect())


def test_rows_without_a_card_are_held_against_the_rule_by_many_tasks(spark):
    rows = [(2000, i, None if i % 10 else f"c{i % 200}", f"p{i % 3000}", DAY, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "source_year int, source_row long, card_token string, person_id string, onset date, disease string")
    judged = registry.candidate_events(df.withColumn("reason", F.lit(""))).cache()
    kept = [spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = registry.held_against_rule(judged)
        assert held.filter("should <> reason").isEmpty() and held.filter("should <> ''").count() > 1000
        marked = held.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        plan = held._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept[0])
        spark.conf.set("spark.sql.adaptive.enabled", kept[1])
    assert sum(r["count"] for r in marked) == 4000 and plan.count("__s") > 1
    wrong = judged.withColumn("reason", F.when(F.col("source_row") == 7, registry.DUP_EVENT).otherwise(F.col("reason")))
    assert not registry.held_against_rule(wrong).filter("should <> reason").isEmpty()


def test_treatments_of_angina_events_are_counted_beside_address_details(spark):
    """Typed records carry the treatment text; A08 counts it by code and class."""
    from matchstrata.functions import identity as idf

    texts = ["onset", "birth", "report_date", "diagnosis_date", "sex", "diagnosis_text", "card_no", "review_status", "duplicate_flag", "first_onset_flag", "icd10", "identity", "treatment", *registry.ADDRESS_PARTS]
    given = [("i20.0", "行 PCI术", "村", "1号"), ("I20.0", "植入支 架", "村", "无"), ("I20.9", "cabg", "", ""), ("I20.9", None, None, None), ("I63", "支架", "村", "2号"), ("I20.9", "药物", "", "0")]
    rows = [tuple({"onset": "2000-03-04", "icd10": c, "treatment": t, "addr_community": a, "addr_number": d}.get(x, "") for x in texts) for c, t, a, d in given]
    raw = spark.createDataFrame([(2000, i, 0, *r) for i, r in enumerate(rows)], "source_year int, source_row long, identity_is_number int, " + ", ".join(f"{c} string" for c in texts))
    got = audit.treatment_and_address_counts(registry.typed_records(raw, idf.ReadableTokens())).select("year", "icd10", "treatment_field", "text_detail", "n")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (2000, "I20.0", "提及PCI/介入", None, 2), (2000, "I20.9", "提及CABG/搭桥", None, 1), (2000, "I20.9", "缺失", None, 1), (2000, "I20.9", "有填写（需按原表核实）", None, 1),
        (2000, None, None, "门牌栏有文字", 2), (2000, None, None, "有居委会或村文字", 1), (2000, None, None, "仅街道及以上文字", 3),
    ]))
