"""Queries over exposure rasters, weather series and matched strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstrata.catalog.base import query, table
from matchstrata.catalog.bindings import SparkDialect
from matchstrata.core import partitions
from matchstrata.functions import geo, spline
from matchstrata.functions.text import rounded
from matchstrata.operators import audit, calendar, validate, weather
from matchstrata.operators import exposure as ex
from matchstrata.operators.segments import exact_quantiles
from matchstrata.plans import slices

# ---------------------------------------------------------------- stand-in data, one SQL text

# Daily packed raster: cells are supplier nations on a 3 x 2 grid; single-line cells on every seventh
# day carry the fill value.
RASTER_SQL = """
 SELECT pollutant, date, lat_idx, lon_idx, 22e0 + 1.2e0 * lat_idx AS lat, 112.5e0 + 2e0 * lon_idx AS lon,
   cast(CASE WHEN n = 1 AND day(date) % 7 = 0 THEN 65535 ELSE v END AS int) AS raw
 FROM (
  SELECT 'PM25' AS pollutant, date, lat_idx, lon_idx, n, floor(10e0 * q / n) AS v FROM ({cells}) a
  UNION ALL SELECT 'PM10', date, lat_idx, lon_idx, n, floor(p / n / 1e3) FROM ({cells}) b
  UNION ALL SELECT 'O3', date, lat_idx, lon_idx, n, floor(1e2 * d / n) FROM ({cells}) c) t
"""
CELLS_SQL = """
 SELECT cast(l_shipdate AS date) AS date, cast(floor(s_nationkey / 9) AS int) AS lat_idx,
   cast(s_nationkey % 2 AS int) AS lon_idx, count(*) AS n, sum(l_quantity) AS q,
   cast(sum(cast(round(l_extendedprice * 1e2) AS bigint)) AS double) AS p,
   cast(sum(cast(round(l_discount * 1e2) AS bigint)) AS double) AS d
 FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY 1, 2, 3
"""
LOCATIONS_SQL = """
 SELECT c_custkey AS location_id, 112.4e0 + (c_custkey % 230) / 1e2 AS longitude,
   21.9e0 + (c_custkey % 290) / 1e2 AS latitude FROM {customer}
"""
LAT_AXIS = [22.0, 23.2, 24.4]
LON_AXIS = [112.5, 114.5]


def _duck_raster() -> str:
    return RASTER_SQL.format(cells=CELLS_SQL.format(lineitem="lineitem", supplier="supplier"))


def raster(spark, sf):
    text = RASTER_SQL.replace("{cells}", CELLS_SQL)
    return spark.sql(text, lineitem=table(spark, sf, "lineitem"), supplier=table(spark, sf, "supplier"))


def locations(spark, sf):
    return spark.sql(LOCATIONS_SQL, customer=table(spark, sf, "customer"))


_LOC = f"loc AS ({LOCATIONS_SQL.format(customer='customer')})"
_RASTER = f"ras AS ({_duck_raster()})"
_DECODED = "dec AS (SELECT *, CASE WHEN raw <> 65535 THEN raw * 0.1e0 END AS value FROM ras)"


def values_wide(spark, sf):
    """Decoded values, one column per pollutant, one row per cell-day."""
    cells = raster(spark, sf).withColumn("value", ex.decode(F.col("raw")))
    picks = [F.max(F.when(F.col("pollutant") == p, F.col("value"))).alias(p) for p in ex.POLLUTANTS]
    return cells.groupBy("lat_idx", "lon_idx", "date").agg(*picks)


CELL = ["lat_idx", "lon_idx"]


def histories(spark, sf):
    dense = ex.dense_series(values_wide(spark, sf), CELL, "date", *slices.SPAN)
    return ex.lag_history(dense, CELL, "date", ex.POLLUTANTS)


def strata(spark, sf):
    events = slices.order_events(spark, sf).withColumn("location_id", F.col("person_id"))
    return ex.matched_strata(events, keep=["event_id", "person_id", "location_id", "priority", "status"])


def exposure_rows(spark, sf):
    cells = ex.nearest_cell(locations(spark, sf), LAT_AXIS, LON_AXIS)
    return ex.attach_exposure(strata(spark, sf), cells, histories(spark, sf), CELL)


def iso(c):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


# ---------------------------------------------------------------- twins of the shared steps

_STRATA = """strata AS (SELECT o_orderkey AS event_id, o_custkey AS location_id, o_orderpriority AS priority,
 o_orderstatus AS status, cast(d AS date) AS date, cast(cast(d AS date) = cast(o_orderdate AS date) AS integer) AS "case"
 FROM (SELECT *, unnest(generate_series(date_trunc('month', o_orderdate), last_day(o_orderdate), interval 1 day)) AS d FROM orders)
 WHERE dayofweek(d) = dayofweek(o_orderdate))"""
_LATS = ", ".join(f"({i}, {v!r}e0)" for i, v in enumerate(LAT_AXIS))
_LONS = ", ".join(f"({i}, {v!r}e0)" for i, v in enumerate(LON_AXIS))
_NEAREST = f"""cellof AS (SELECT location_id, longitude, latitude,
 longitude BETWEEN {min(LON_AXIS)!r}e0 AND {max(LON_AXIS)!r}e0 AND latitude BETWEEN {min(LAT_AXIS)!r}e0 AND {max(LAT_AXIS)!r}e0 AS ok,
 (SELECT i FROM (VALUES {_LATS}) t(i, v) ORDER BY abs(v - latitude), i LIMIT 1) AS yi,
 (SELECT i FROM (VALUES {_LONS}) t(i, v) ORDER BY abs(v - longitude), i LIMIT 1) AS xi FROM loc)"""
_LAGS = ", ".join(
    f"max(CASE WHEN pollutant = '{p}' AND r.date = s.date - {k} THEN value END) AS \"{p}_l{k}\""
    for p in ex.POLLUTANTS
    for k in range(8)
)
_EXPOSED = f"""exposed AS (SELECT s.event_id, s.location_id, s.date, s."case", s.priority, s.status, {_LAGS}
 FROM strata s JOIN cellof c USING (location_id)
 LEFT JOIN dec r ON c.ok AND r.lat_idx = c.yi AND r.lon_idx = c.xi AND r.date BETWEEN s.date - 7 AND s.date
 GROUP BY ALL)"""
BASE = [_LOC, _RASTER, _DECODED, _STRATA, _NEAREST, _EXPOSED]


def twin(select: str, *more: str) -> str:
    return "WITH " + ", ".join([*BASE, *more]) + " " + select


# ---------------------------------------------------------------- referents and rasters


@query(
    "J01_referent_dates",
    f"""WITH {_STRATA} SELECT event_id, cast(date AS varchar) AS date, "case" FROM strata""",
)
def referents(spark, sf):
    return strata(spark, sf).select("event_id", iso("date"), "case")


@query(
    "J01_W05_W06_J12_P10_exposure_contrast",
    """WITH m AS (SELECT cast(l_shipdate AS date) AS date, sum(l_quantity) / count(*) AS v FROM lineitem GROUP BY 1),
    s AS (SELECT o_orderkey AS event_id, cast(d AS date) AS date, cast(d AS date) = cast(o_orderdate AS date) AS c
      FROM (SELECT *, unnest(generate_series(date_trunc('month', o_orderdate), last_day(o_orderdate), interval 1 day)) AS d
        FROM orders) WHERE dayofweek(d) = dayofweek(o_orderdate)),
    x AS (SELECT s.*, (a.v + b.v) / 2 AS e FROM s LEFT JOIN m a ON a.date = s.date LEFT JOIN m b ON b.date = s.date - 1)
    SELECT cast(c AS integer) AS "case", count(*) AS n, round(avg(e), 4) AS mean_exposure FROM x
    WHERE event_id NOT IN (SELECT event_id FROM x WHERE e IS NULL) GROUP BY 1""",
)
def contrast(spark, sf):
    return slices.exposure_contrast(spark, sf)


@query(
    "F29_S07_decoded_raster",
    f"WITH {_RASTER}, {_DECODED} SELECT pollutant, cast(date AS varchar) AS date, lat_idx, lon_idx, round(value, 4) AS value FROM dec",
)
def decoded(spark, sf):
    return raster(spark, sf).select(
        "pollutant", iso("date"), "lat_idx", "lon_idx", F.round(ex.decode(F.col("raw")), 4).alias("value")
    )


@query(
    "P03_A26_crop_statistics",
    f"""WITH {_RASTER}, {_DECODED} SELECT pollutant, cast(date AS varchar) AS date, count(DISTINCT lat_idx) AS lat_cells,
    count(DISTINCT lon_idx) AS lon_cells, count(value) AS valid_cells, count(*) - count(value) AS missing_cells,
    round(min(value), 4) AS min_value, round(max(value), 4) AS max_value FROM dec
    WHERE lon BETWEEN 112.0e0 AND 113.9e0 AND lat BETWEEN 22.5e0 AND 24.5e0 GROUP BY 1, 2""",
)
def crop_statistics(spark, sf):
    out = ex.crop_statistics(ex.crop(raster(spark, sf), (112.0, 113.9, 22.5, 24.5)))
    return out.select(
        "pollutant", iso("date"), "lat_cells", "lon_cells", "valid_cells", "missing_cells",
        F.round("min_value", 4).alias("min_value"), F.round("max_value", 4).alias("max_value"),
    )


@query(
    "A26_axis_steps",
    f"""WITH {_RASTER} SELECT pollutant, round(median(s), 6) AS lat_step FROM (SELECT pollutant, abs(v - lag(v) OVER
    (PARTITION BY pollutant ORDER BY lat_idx)) AS s FROM (SELECT DISTINCT pollutant, lat_idx, lat AS v FROM ras)) GROUP BY 1""",
)
def steps(spark, sf):
    return ex.axis_steps(raster(spark, sf), "lat", "lat_idx").withColumn("lat_step", F.round("lat_step", 6))


@query(
    "J10_nearest_cell",
    f"""WITH {_LOC}, {_NEAREST} SELECT location_id, CASE WHEN ok THEN yi END AS lat_idx, CASE WHEN ok THEN xi END AS lon_idx,
    cast(ok AS integer) AS in_extent FROM cellof""",
)
def nearest_cells(spark, sf):
    return ex.nearest_cell(locations(spark, sf), LAT_AXIS, LON_AXIS).select("location_id", *CELL, "in_extent")


_LATTICE = """grid AS (SELECT printf('ERA5_%.2f_%.2f', 22.25e0 + i * 0.25e0, 112.5e0 + j * 0.25e0) AS weather_grid_id,
 22.25e0 + i * 0.25e0 AS latitude, 112.5e0 + j * 0.25e0 AS longitude FROM range(10) a(i), range(10) b(j))"""
_KM = """2 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians(g.latitude - l.latitude) / 2), 2)
 + cos(radians(l.latitude)) * cos(radians(g.latitude)) * pow(sin(radians(g.longitude - l.longitude) / 2), 2))))"""


@query(
    "J11_K03_K04_F26_location_assignments",
    f"""WITH {_LOC}, {_NEAREST}, {_LATTICE}, d AS (SELECT l.location_id, g.weather_grid_id, {_KM} AS km FROM loc l, grid g),
    b AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY round(km, 9), weather_grid_id) AS r FROM d)
    SELECT b.location_id, b.weather_grid_id, round(b.km, 4) AS weather_distance_km, cast(c.ok AS integer) AS in_extent
    FROM b JOIN cellof c USING (location_id) WHERE r = 1""",
)
def assignments(spark, sf):
    placed = ex.nearest_cell(locations(spark, sf), LAT_AXIS, LON_AXIS)
    out = ex.nearest_grid(placed, ex.lattice(spark), "weather_grid_id")
    return out.select(
        "location_id", "weather_grid_id", F.round("weather_distance_km", 4).alias("weather_distance_km"), "in_extent"
    )


@query(
    "K03_lattice",
    f"WITH {_LATTICE} SELECT weather_grid_id, latitude, longitude, n FROM grid, (SELECT count(*) AS n FROM supplier)",
)
def lattice(spark, sf):
    n = table(spark, sf, "supplier").agg(audit.n_rows())
    return ex.lattice(spark).select("weather_grid_id", "latitude", "longitude", n.scalar().alias("n"))


@query(
    "J02_J12_W05_F32_exposure_rows",
    twin(
        "SELECT event_id, cast(date AS varchar) AS date, location_id, "
        + ", ".join(f'round("{p}_l{k}", 4) AS "{p}_l{k}"' for p in ex.POLLUTANTS for k in range(8))
        + " FROM exposed"
    ),
)
def exposed(spark, sf):
    rows = exposure_rows(spark, sf)
    return rows.select(
        "event_id", iso("date"), "location_id",
        *[rounded(F.col(f"{p}_l{k}")).alias(f"{p}_l{k}") for p in ex.POLLUTANTS for k in range(8)],
    )


_MEANS = {"lag01": (0, 1), "lag02": (0, 1, 2), "lag03": (0, 1, 2, 3), "lag12": (1, 2), "lag04": (0, 1, 2, 3, 4)}


def _mean_sql(p: str, lags: tuple) -> str:
    return "(" + " + ".join(f'"{p}_l{k}"' for k in lags) + f") / {len(lags)}"


# One row per matched row and pollutant: the two-day mean, and whether all windows are known.
_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT event_id, location_id, date, '{p}' AS pollutant, {_mean_sql(p, (0, 1))} AS a, "
    + " AND ".join(f'"{p}_l{k}" IS NOT NULL' for k in range(4))
    + " AS every FROM exposed"
    for p in ex.POLLUTANTS
) + ")"


def long_rows(spark, sf):
    """Two-day means, one row per matched row and pollutant."""
    rows = ex.with_windows(exposure_rows(spark, sf), ex.POLLUTANTS, {"lag01": (0, 1)})
    pairs = [F.struct(F.lit(p).alias("pollutant"), F.col(f"{p}_lag01").alias("a")) for p in ex.POLLUTANTS]
    return rows.select("event_id", "location_id", "date", F.inline(F.array(*pairs)))


@query(
    "W06_window_means",
    twin(
        "SELECT event_id, cast(date AS varchar) AS date, "
        + ", ".join(f'round({_mean_sql(p, lags)}, 4) AS "{p}_{w}"' for p in ex.POLLUTANTS for w, lags in _MEANS.items())
        + " FROM exposed"
    ),
)
def window_means(spark, sf):
    rows = ex.with_windows(exposure_rows(spark, sf), ex.POLLUTANTS, {**ex.WINDOWS, **ex.EXTRA_WINDOWS})
    names = [f"{p}_{w}" for p in ex.POLLUTANTS for w in _MEANS]
    return rows.select("event_id", iso("date"), *[F.round(n, 4).alias(n) for n in names])


@query(
    "P10_P12_A34_complete_strata",
    twin(
        """SELECT p AS pollutant, s AS sample, count(event_id) AS n_events,
        CASE WHEN count(event_id) > 0 THEN count(*) FILTER (v) END AS variable_exposure_events
        FROM (SELECT DISTINCT pollutant AS p FROM long), (VALUES ('lag01'), ('all_windows')) t(s) LEFT JOIN (
        SELECT pollutant, 'lag01' AS sample, event_id, max(a) > min(a) AS v FROM long GROUP BY ALL HAVING bool_and(a IS NOT NULL)
        UNION ALL SELECT pollutant, 'all_windows', event_id, max(a) > min(a) FROM long GROUP BY ALL HAVING bool_and(every))
        ON pollutant = p AND sample = s GROUP BY ALL""",
        _LONG,
    ),
)
def complete(spark, sf):
    rows = ex.with_windows(exposure_rows(spark, sf), ex.POLLUTANTS)
    parts = []
    for p in ex.POLLUTANTS:
        for sample, windows in (("lag01", ["lag01"]), ("all_windows", ex.WINDOWS)):
            kept = ex.complete_strata(rows, [f"{p}_{w}" for w in windows])
            parts.append(ex.stratum_variation(kept, f"{p}_lag01").select(F.lit(p).alias("pollutant"), F.lit(sample).alias("sample"), "*"))
    return reduce(DataFrame.unionByName, parts)


_LAG_NAMES = [f"{p}_l{k}" for p in ex.POLLUTANTS for k in range(8)]


@query(
    "A28_missing_exposure",
    twin(
        "SELECT unnest(["
        + ", ".join(f"'{c}'" for c in _LAG_NAMES)
        + '], recursive := false) AS "column", unnest(['
        + ", ".join(f'count(*) - count("{c}")' for c in _LAG_NAMES)
        + "]) AS missing FROM exposed"
    ),
)
def missing(spark, sf):
    return ex.missing_counts(exposure_rows(spark, sf), _LAG_NAMES)


#: Rows of one pollutant that a task goes through when strata are trimmed.
TRIMMED_AT_ONCE = 1 << 20


@query(
    "P11_trimmed_strata",
    twin(
        """SELECT pollutant, event_id, count(*) AS n FROM long JOIN (SELECT pollutant, quantile_cont(a, 0.001) AS lo, quantile_cont(a, 0.999) AS hi
        FROM long GROUP BY 1) USING (pollutant) GROUP BY ALL HAVING bool_and(coalesce(a BETWEEN lo AND hi, false))""",
        _LONG,
    ),
)
def trimmed(spark, sf):
    rows = long_rows(spark, sf)
    cuts = exact_quantiles(rows, ["pollutant"], "a", {"lo": 0.001, "hi": 0.999}).collect()  # one row per pollutant
    # A task sorts a bounded number of rows; an event's rows stay where they are to be counted.
    tasks = max(partitions(spark), max((q["n"] for q in cuts), default=0) // TRIMMED_AT_ONCE)
    slim = rows.select("pollutant", "event_id", "a")
    parts = [ex.trim_strata(slim.filter(F.col("pollutant") == q["pollutant"]), "a", q["lo"], q["hi"], parts=tasks) for q in cuts]
    return reduce(DataFrame.unionByName, [audit.count_by(part, "pollutant", "event_id") for part in parts])


@query(
    "A30_spline_parameters",
    twin(
        """SELECT pollutant, round(quantile_cont(a, 1/3.0), 6) AS k1, round(quantile_cont(a, 2/3.0), 6) AS k2, round(min(a), 6) AS lo,
        round(max(a), 6) AS hi, round(quantile_cont(a, 0.5), 6) AS reference, round(quantile_cont(a, 0.05), 6) AS d05,
        round(quantile_cont(a, 0.95), 6) AS d95, count(a) AS n FROM long GROUP BY 1""",
        _LONG,
    ),
)
def parameters(spark, sf):
    probs = {"k1": 1 / 3, "k2": 2 / 3, "lo": 0.0, "hi": 1.0, "reference": 0.5, "d05": 0.05, "d95": 0.95}
    out = exact_quantiles(long_rows(spark, sf), ["pollutant"], "a", probs)
    return out.select("pollutant", "n", *[F.round(p, 6).alias(p) for p in probs])


@query(
    "A31_iqr_residence_days",
    twin(
        """SELECT pollutant, round(quantile_cont(a, 0.75) - quantile_cont(a, 0.25), 6) AS iqr, count(a) AS n FROM
        (SELECT DISTINCT pollutant, location_id, date, a FROM long) GROUP BY 1""",
        _LONG,
    ),
)
def iqr(spark, sf):
    days = long_rows(spark, sf).groupBy("pollutant", "location_id", "date").agg(F.max("a").alias("a"))
    out = exact_quantiles(days, ["pollutant"], "a", {"q1": 0.25, "q3": 0.75})
    return out.select("pollutant", "n", F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"))


@query(
    "A32_spearman",
    twin(
        """, u AS (SELECT DISTINCT priority, location_id, date, "PM25_l0" AS x, "O3_l0" AS y FROM exposed
          WHERE "PM25_l0" IS NOT NULL AND "O3_l0" IS NOT NULL),
        r AS (SELECT priority, rank() OVER (PARTITION BY priority ORDER BY x) + (count(*) OVER (PARTITION BY priority, x) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY priority ORDER BY y) + (count(*) OVER (PARTITION BY priority, y) - 1) / 2.0 AS ry FROM u)
        SELECT priority, count(*) AS n, round(corr(rx, ry), 6) AS spearman_r FROM r GROUP BY 1"""
    ),
)
def spearman(spark, sf):
    rows = exposure_rows(spark, sf).groupBy("priority", "location_id", "date").agg(
        F.max("PM25_l0").alias("x"), F.max("O3_l0").alias("y")
    )
    out = audit.spearman(rows, ["priority"], "x", "y")
    return out.select("priority", "n", F.round("spearman_r", 6).alias("spearman_r"))


@query("T04_V07_reextraction", "SELECT 30 AS sampled, 30 AS planted, 30 AS found, 0 AS others")
def reextraction(spark, sf):
    """A seeded sample of stored rows, one lag of each changed: the lookup must find these and nothing else."""
    sample = validate.seeded_sample(exposure_rows(spark, sf), ["event_id", "date"], 20261003, 30)
    wrong = sample.withColumn("PM25_l3", F.coalesce("PM25_l3", F.lit(0.0)) + 1)
    errors = validate.reextraction_errors(wrong, values_wide(spark, sf), CELL, ex.POLLUTANTS, range(8))
    planted = (F.col("name") == "PM25") & (F.col("lag") == 3)
    found = errors.agg(F.count_if(planted).cast("int").alias("found"), F.count_if(~planted).cast("int").alias("others"))
    return sample.agg(F.count(F.lit(1)).cast("int").alias("sampled")).crossJoin(found).select("sampled", F.col("sampled").alias("planted"), "found", "others")


@query("V01_stratum_contract", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 101 = 0 OR o_orderkey % 103 = 0")
def contract(spark, sf):
    """Strata without a case, over two locations, or with a date twice are planted by the order's key."""
    key = F.col("event_id")
    rows = strata(spark, sf)
    rows = rows.withColumn("location_id", F.when((key % 101 == 0) & (F.col("case") == 1), F.col("location_id") + 1).otherwise(F.col("location_id")))
    rows = rows.withColumn("case", F.when(key % 97 == 0, 0).otherwise(F.col("case")))
    twice = rows.filter((key % 103 == 0) & (F.col("case") == 0)).groupBy(rows.columns).agg(F.lit(1)).select(rows.columns)
    return validate.stratum_violations(rows.unionByName(twice)).select("event_id")


@query("V08_single_month", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 89 = 0")
def single_month(spark, sf):
    """The case day of some strata is moved to another month."""
    moved = F.when((F.col("event_id") % 89 == 0) & (F.col("case") == 1), F.add_months("date", 1)).otherwise(F.col("date"))
    rows = strata(spark, sf).withColumn("date", moved)
    return validate.several_values(rows, "event_id", F.date_format("date", "yyyy-MM")).select("event_id")


# ---------------------------------------------------------------- weather

# Weather lattice: five regions; temperature and humidity from the region's shipments of the day.
WEATHER_DAYS_SQL = """
 SELECT n_regionkey AS region, cast(l_shipdate AS date) AS date, count(*) AS n, sum(l_quantity) AS q
 FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey GROUP BY 1, 2
"""


def weather_series(spark, sf):
    days = spark.sql(
        WEATHER_DAYS_SQL,
        lineitem=table(spark, sf, "lineitem"),
        supplier=table(spark, sf, "supplier"),
        nation=table(spark, sf, "nation"),
    )
    dense = ex.dense_series(days, ["region"], "date", *slices.SPAN).fillna(0, ["n", "q"])
    return dense.select(
        F.concat(F.lit("R"), F.col("region").cast("string")).alias("weather_grid_id"),
        "date",
        (F.lit(5.0) + (F.col("q") * 7 % 300) / 10).alias("temp"),
        (F.lit(40.0) + ((F.col("q") * 3 + F.col("n") * 11) % 500) / 10).alias("rh"),
    )


_WEATHER = f"""wd AS ({WEATHER_DAYS_SQL.format(lineitem="lineitem", supplier="supplier", nation="nation")}),
 wx AS (SELECT 'R' || r.region AS weather_grid_id, d.date, 5e0 + (coalesce(q, 0) * 7 % 300) / 10 AS temp,
   40e0 + ((coalesce(q, 0) * 3 + coalesce(n, 0) * 11) % 500) / 10 AS rh
 FROM (SELECT DISTINCT region FROM wd) r
 CROSS JOIN (SELECT cast(unnest(generate_series(date '1995-01-01', date '2001-12-31', interval 1 day)) AS date) AS date) d
 LEFT JOIN wd ON wd.region = r.region AND wd.date = d.date),
 rolled AS (SELECT *, CASE WHEN count(rh) OVER w = 4 THEN avg(rh) OVER w END AS rh_ma03 FROM wx
   WINDOW w AS (PARTITION BY weather_grid_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def humid(spark, sf):
    return weather.rolling_mean(weather_series(spark, sf), "rh")


@query(
    "W07_humidity_mean",
    f"WITH {_WEATHER} SELECT weather_grid_id, cast(date AS varchar) AS date, round(rh_ma03, 4) AS rh_ma03 FROM rolled",
)
def humidity(spark, sf):
    return humid(spark, sf).select("weather_grid_id", iso("date"), F.round("rh_ma03", 4).alias("rh_ma03"))


@query(
    "W12_V03_weather_contract",
    f"""WITH {_WEATHER}, p AS (SELECT weather_grid_id, date, dayofmonth(date) AS d, month(date) AS m FROM wx)
    SELECT weather_grid_id, cast(date AS varchar) AS date, 'null' AS rule FROM p WHERE d = 5 AND m = 3
    UNION ALL SELECT weather_grid_id, cast(date AS varchar), 'range' FROM p WHERE d = 6 AND m = 4
    UNION ALL SELECT weather_grid_id, cast(date AS varchar), 'duplicate' FROM p WHERE d = 7 AND m = 5
    UNION ALL SELECT weather_grid_id, cast(date + 1 AS varchar), 'gap' FROM p WHERE d = 8 AND m = 6""",
)
def weather_contract(spark, sf):
    """Null, out-of-range, repeated and missing days are planted by date."""
    d, m = F.dayofmonth("date"), F.month("date")
    rows = weather_series(spark, sf).filter(~((d == 8) & (m == 6)))
    rows = rows.withColumn("temp", F.when((d == 5) & (m == 3), F.lit(None)).otherwise(F.col("temp")))
    rows = rows.withColumn("rh", F.when((d == 6) & (m == 4), F.lit(101.0)).otherwise(F.col("rh")))
    rows = rows.unionByName(rows.filter((d == 7) & (m == 5)))
    return validate.weather_violations(rows).select("weather_grid_id", iso("date"), "rule")


@query(
    "V02_weather_key",
    f"""WITH {_WEATHER} SELECT weather_grid_id, cast(date AS varchar) AS date, cast(2 AS bigint) AS rows FROM wx WHERE dayofmonth(date) = 11""",
)
def weather_key(spark, sf):
    rows = weather_series(spark, sf)
    twice = rows.unionByName(rows.filter(F.dayofmonth("date") == 11))
    return validate.duplicate_keys(twice, ["weather_grid_id", "date"]).select("weather_grid_id", iso("date"), "rows")


@query(
    "W12_gap_check",
    f"""WITH x AS (SELECT s_nationkey AS key, cast(l_shipdate AS date) AS date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      GROUP BY 1, 2), g AS (SELECT *, datediff('day', lag(date) OVER (PARTITION BY key ORDER BY date), date) AS step FROM x)
    SELECT key, cast(date AS varchar) AS date, step FROM g WHERE step <> 1""",
)
def gap_check(spark, sf):
    rows = table(spark, sf, "lineitem").join(
        table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    days = rows.select(F.col("s_nationkey").alias("key"), F.to_date("l_shipdate").alias("date")).distinct()
    return weather.gaps(days, "key", "date").select("key", iso("date"), "step")


def _spline_sql(x: str, knots: list[str], lo: str, hi: str) -> list[str]:
    """Truncated-power natural spline in SQL, written from the textbook formula."""
    u = f"(({x} - {lo}) / ({hi} - {lo}))"
    ks = [f"(({k} - {lo}) / ({hi} - {lo}))" for k in knots]

    def d(k):
        return f"((pow(greatest({u} - {k}, 0), 3) - pow(greatest({u} - 1, 0), 3)) / (1 - {k}))"

    return [u, f"({d('0e0')} - {d(ks[-1])})", *[f"({d(k)} - {d(ks[-1])})" for k in ks[:-1]]]


_TB = _spline_sql("temp", ["k1", "k2"], "lo", "hi")
_CB_LAG = spline.lag_basis(21, 3)
_CB = ", ".join(
    "round("
    + " + ".join(
        f"{float(_CB_LAG[k, b])!r} * " + (f"t{a}" if k == 0 else f"lag(t{a}, {k}) OVER w") for k in range(22)
    )
    + f", 4) AS temp_cb{a * 3 + b + 1}"
    for a in range(3)
    for b in range(3)
)


@query(
    "W08_F30_cross_basis",
    f"""WITH {_WEATHER}, p AS (SELECT quantile_cont(temp, 1/3.0) AS k1, quantile_cont(temp, 2/3.0) AS k2, min(temp) AS lo,
      max(temp) AS hi FROM rolled),
    t AS (SELECT weather_grid_id, date, {_TB[0]} AS t0, {_TB[1]} AS t1, {_TB[2]} AS t2 FROM rolled, p)
    SELECT weather_grid_id, cast(date AS varchar) AS date, {_CB} FROM t
    WINDOW w AS (PARTITION BY weather_grid_id ORDER BY date)""",
)
def cross_basis(spark, sf):
    series = humid(spark, sf)
    config = weather.CONFIGS["main"]
    params = weather.basis_parameters(series, {"main": config})["main"]
    out = weather.cross_basis(series, config, params)
    return out.select("weather_grid_id", iso("date"), *[F.round(c, 4).alias(c) for c in weather.temp_columns(config)])


_REGION_GRID = """SELECT s.event_id, s.location_id, s.date, s."case", s.priority,
 'R' || (s.location_id % 5) AS weather_grid_id FROM strata s"""


def with_grid(spark, sf):
    return strata(spark, sf).withColumn(
        "weather_grid_id", F.concat(F.lit("R"), (F.col("location_id") % 5).cast("string"))
    )


_MATRIX = [*ex.POLLUTANTS, "temp", "rh_ma03"]


@query(
    "A32_spearman_matrix",
    twin(
        "SELECT priority, a AS variable1, b AS variable2, count(*) AS n, round(corr(rx, ry), 6) AS spearman_r FROM v GROUP BY ALL",
        _WEATHER,
        """days AS (SELECT DISTINCT priority, e.location_id, e.date, ("PM25_l0" + "PM25_l1") / 2 AS "PM25", ("PM10_l0" + "PM10_l1") / 2 AS "PM10", ("O3_l0" + "O3_l1") / 2 AS "O3", temp, rh_ma03
          FROM exposed e LEFT JOIN rolled r ON r.weather_grid_id = 'R' || (e.location_id % 5) AND r.date = e.date)""",
        "pairs AS ("
        + " UNION ALL ".join(f"""SELECT priority, '{a}' AS a, '{b}' AS b, "{a}" AS x, "{b}" AS y FROM days""" for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1 :])
        + ")",
        """v AS (SELECT *, rank() OVER (PARTITION BY priority, a, b ORDER BY x) + (count(*) OVER (PARTITION BY priority, a, b, x) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY priority, a, b ORDER BY y) + (count(*) OVER (PARTITION BY priority, a, b, y) - 1) / 2.0 AS ry FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL)""",
    ),
)
def spearman_matrix(spark, sf):
    """All ten pairs of one-day-lag exposures and weather per group, over distinct residence days."""
    rows = ex.with_windows(exposure_rows(spark, sf), ex.POLLUTANTS, {"lag01": (0, 1)})
    rows = rows.groupBy("priority", "location_id", "date").agg(*[F.max(f"{p}_lag01").alias(p) for p in ex.POLLUTANTS])
    rows = rows.withColumn("weather_grid_id", F.concat(F.lit("R"), (F.col("location_id") % 5).cast("string"))).join(humid(spark, sf), ["weather_grid_id", "date"], "left")
    out = audit.spearman_matrix(rows, ["priority"], _MATRIX)
    return out.select("priority", "variable1", "variable2", "n", F.round("spearman_r", 6).alias("spearman_r"))


@query(
    "J06_J23_A29_weather_description",
    f"""WITH {_STRATA}, {_WEATHER}, z AS (SELECT DISTINCT priority, location_id, date, weather_grid_id FROM ({_REGION_GRID})),
    y AS (SELECT z.*, r.temp, r.rh_ma03 FROM z LEFT JOIN rolled r USING (weather_grid_id, date))
    SELECT priority, v AS variable, count(*) AS n, count(*) - count(x) AS missing, round(avg(x), 4) AS mean,
    round(stddev_samp(x), 4) AS sd, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS median,
    round(quantile_cont(x, 0.75), 4) AS p75
    FROM (SELECT priority, unnest(['temp', 'rh_ma03']) AS v, unnest([temp, rh_ma03]) AS x FROM y) GROUP BY 1, 2""",
)
def describe(spark, sf):
    days = with_grid(spark, sf).select("priority", "location_id", "date", "weather_grid_id").distinct()
    rows = days.join(humid(spark, sf), ["weather_grid_id", "date"], "left")
    out = weather.describe(rows, ["priority"], ["temp", "rh_ma03"])
    names = ["mean", "sd", "p25", "median", "p75"]
    return out.select("priority", "variable", "n", "missing", *[F.round(c, 4).alias(c) for c in names])


@query(
    "K01_J05_calendar_join",
    """WITH e AS (SELECT event_id, cast(ts AS date) AS date FROM events)
    SELECT cast(date AS varchar) AS date, count(*) AS n, cast(date IN (date '2024-01-01') AS integer) AS holiday,
    cast(date = date '2024-01-01' AS integer) AS official_break, 0 AS adjusted_workday, isodow(date) AS weekday
    FROM e GROUP BY 1, date""",
)
def calendar_join(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(audit.n_rows())
    cal = calendar.calendar(spark, "2024-01-01", "2024-12-31")
    out = days.join(F.broadcast(cal), "date", "left")
    return out.select(iso("date"), "n", "holiday", "official_break", "adjusted_workday", "weekday")


@query(
    "K02_calendar_rules",
    """SELECT y AS year, s AS statutory_holiday_days, b AS official_break_days, w AS adjusted_workday_days,
    (SELECT count(*) FROM events WHERE year(ts) = y) AS n_events
    FROM (VALUES (2023, 11, 28, 7), (2024, 11, 30, 8), (2025, 13, 28, 5)) t(y, s, b, w)""",
)
def calendar_rules(spark, sf):
    cal = calendar.calendar(spark)
    totals = calendar.yearly_totals(cal)
    seen = table(spark, sf, "events").groupBy(F.year("ts").alias("year")).agg(audit.n_rows("n_events"))
    return totals.join(seen, "year", "left").fillna(0, ["n_events"]).join(
        calendar.rule_violations(cal).select(F.year("date").alias("year")), "year", "left_anti"
    )


# ---------------------------------------------------------------- coordinates


@query(
    "F27_parse_points",
    """SELECT event_id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE 112.5e0 + value / 1e2 END AS lon,
    CASE WHEN user_id % 9 = 0 THEN NULL ELSE 22.5e0 END AS lat,
    cast(CASE WHEN user_id % 9 = 0 THEN 0 ELSE value > 0 AND value / 1e2 + 112.5e0 < 114.7e0 END AS integer) AS in_box FROM events""",
)
def points(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("user_id") % 9 == 0, F.lit("12.x,")).otherwise(
            F.concat((F.lit(112.5) + F.col("value") / 1e2).cast("string"), F.lit(",22.5"))
        ).alias("text"),
    )
    p = geo.parse_point(F.col("text"))
    return rows.select(
        "event_id", p["lon"].alias("lon"), p["lat"].alias("lat"),
        geo.parse_point(F.col("text"), geo.STUDY_BOX).isNotNull().cast("int").alias("in_box"),
    )


@query("F28_datum_shift", "SELECT c_custkey AS location_id, 1 AS round_trip_ok FROM customer")
def datum(spark, sf):
    """Round trip within 1e-6 degrees for every location."""
    out = geo.datum_shift(
        locations(spark, sf).withColumnsRenamed({"longitude": "gx", "latitude": "gy"}), "gx", "gy"
    )
    return out.select("location_id", (F.col("shift_error") <= 1e-6).cast("int").alias("round_trip_ok"))
