"""Queries over ingest steps."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from matchstrata.catalog.base import query, table
from matchstrata.core import _ensure_checkpoint_dir
from matchstrata.operators import weather
from matchstrata.sources import readers, writers


@query(
    "S01_S02_alias_union",
    """SELECT year(o_orderdate) AS source_year, o_orderkey AS source_row, o_orderstatus AS sex,
    CASE WHEN year(o_orderdate) % 2 = 0 THEN o_orderpriority END AS review_status,
    CASE WHEN year(o_orderdate) % 2 = 1 THEN o_orderpriority END AS card_no FROM orders""",
)
def alias_union(spark, sf):
    """Yearly sources with two sorts of headers in turn; a present but null first alias still wins."""
    orders = table(spark, sf, "orders").withColumn("source_year", F.year("o_orderdate"))
    first = orders.filter("source_year % 2 = 1").select(
        "source_year",
        F.col("o_orderkey").alias("source_row"),
        F.col("o_orderstatus").alias("性别"),
        F.lit(None).cast("string").alias("审核状态"),
        F.lit("unused").alias("卡片状态"),
        F.col("o_orderpriority").alias("报告卡编号"),
    )
    second = orders.filter("source_year % 2 = 0").select(
        "source_year",
        F.col("o_orderkey").alias("source_row"),
        F.col("o_orderstatus").alias("性别"),
        F.col("o_orderpriority").alias("卡片状态"),
    )
    both = readers.aliased(first).unionByName(readers.aliased(second), allowMissingColumns=True)
    return both.select("source_year", "source_row", "sex", "review_status", "card_no")


@query(
    "S03_field_inventory",
    """SELECT 1995 AS year, row_number() OVER () AS position, column_name AS field, (SELECT count(*) FROM orders) AS rows
    FROM (SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name)""",
)
def inventory(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.agg(F.count(F.lit(1)).alias("rows"))
    return readers.field_inventory(spark, {1995: orders}).select("*", rows.scalar().alias("rows"))


@query(
    "S08_weather_flatten",
    """SELECT l_suppkey AS latitude, l_linenumber AS longitude, cast(cast(l_shipdate AS date) AS varchar) AS date, min(l_tax) AS low,
    count(DISTINCT l_tax) > 1 AS several FROM lineitem GROUP BY 1, 2, 3""".replace(
        "count(DISTINCT l_tax) > 1 AS several", "cast(count(DISTINCT l_tax) > 1 AS integer) AS conflict"
    ),
)
def weather_flatten(spark, sf):
    """Parallel day arrays per grid back to rows, with the conflict mark of repeated days."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    batches = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", "l_linenumber", "l_orderkey")
        .agg(F.collect_list(F.struct(day.alias("time"), "l_tax")).alias("d"))
        .select(
            F.col("l_suppkey").cast("double").alias("latitude"),
            F.col("l_linenumber").cast("double").alias("longitude"),
            F.struct(
                F.col("d.time").alias("time"),
                F.col("d.l_tax").alias("temp"),
                F.transform("d.l_tax", lambda _: F.lit(50.0)).alias("rh"),
            ).alias("daily"),
        )
    )
    out = weather.flatten_daily(batches)
    return out.select(
        F.col("latitude").cast("long").alias("latitude"),
        F.col("longitude").cast("int").alias("longitude"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("temp").alias("low"),
        "conflict",
    )


@query(
    "S09_published_files",
    """SELECT p_brand AS pollutant, cast(p_partkey AS varchar) AS record, 'X_D1K_' || y || '_' || p_partkey AS filename, p_size AS bytes
    FROM part, (VALUES (2022), (2024)) t(y)""",
)
def published(spark, sf):
    """Manifest rows from per-record JSON metadata."""
    body = F.to_json(
        F.struct(
            F.array(
                *[
                    F.struct(
                        F.concat(F.lit(name), F.col("p_partkey").cast("string")).alias("key"),
                        F.col("p_size").alias("size"),
                        F.lit("md5:0").alias("checksum"),
                        F.struct(F.lit("u").alias("self")).alias("links"),
                    )
                    for name in ("X_D1K_2022_", "X_D1K_2024_", "X_D1K_2019_", "X_M1K_2024_")
                ]
            ).alias("files")
        )
    )
    meta = table(spark, sf, "part").select(
        F.col("p_brand").alias("pollutant"), F.col("p_partkey").cast("string").alias("record"), body.alias("body")
    )
    return readers.published_files(meta).select("pollutant", "record", "filename", "bytes")


@query(
    "S07_A27_archive_coverage",
    """SELECT 'qty' AS pollutant, y AS year, n AS daily_files, CASE WHEN y = 1996 OR y = 2000 THEN 366 ELSE 365 END AS expected_days,
    cast(n = CASE WHEN y = 1996 OR y = 2000 THEN 366 ELSE 365 END AS integer) AS covered FROM (
    SELECT year(l_shipdate) AS y, count(DISTINCT cast(l_shipdate AS date)) AS n FROM lineitem GROUP BY 1) WHERE y BETWEEN 1995 AND 2001""",
)
def archive_coverage(spark, sf):
    """File dates read from names, against the calendar."""
    names = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.concat(F.lit("a/X_D1K_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("_V4.nc")).alias("name"),
    ).distinct()
    files = names.select(F.lit("qty").alias("pollutant"), "year", readers.date_of_name(F.col("name"), F.col("year")).alias("date"))
    return readers.coverage(files, list(range(1995, 2002)))


@query(
    "S10_content_drift",
    """SELECT doc_id AS filename, sha256(text) AS sha256 FROM documents WHERE lang = 'en' AND length(text) > 0""",
)
def drift(spark, sf):
    """Documents whose digest differs from the recorded one."""
    docs = table(spark, sf, "documents").filter("length(text) > 0").select(
        F.col("doc_id").alias("filename"), "lang", "text"
    )
    actual = docs.select(
        "filename",
        F.sha2(F.when(F.col("lang") == "en", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"),
    )
    expected = docs.select("filename", F.sha2("text", 256).alias("sha256"))
    return readers.drifted(actual, expected)


# ---------------------------------------------------------------- round trips through a scratch folder


def scratch(spark):
    """A new path in the shared folder of the session."""
    return f"{_ensure_checkpoint_dir(spark)}/trip-{uuid.uuid4().hex}"


@query(
    "S04_csv_round_trip",
    """SELECT lpad(cast(c_custkey AS varchar), 9, '0') AS id, c_name || ', "' || c_mktsegment || '"' AS name,
    CASE WHEN c_custkey % 7 <> 0 THEN cast(c_nationkey AS varchar) END AS nation FROM customer""",
)
def csv_round_trip(spark, sf):
    """Compressed CSV with leading zeros, quotes, separators and nulls: read back as text, nothing is lost."""
    rows = table(spark, sf, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"),
        F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("name"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).cast("string").alias("nation"),
    )
    path = scratch(spark)
    writers.write_once(rows, path, fmt="csv")
    return readers.read_csv(spark, path)


_INVENTORY = """SELECT l_returnflag AS pollutant, cast(l_shipdate AS date) AS date, count(*) AS valid_cells,
 sum(cast(l_quantity > 45 AS bigint)) AS missing_cells FROM {lineitem} GROUP BY 1, 2"""


@query("S05_inventory_lines", f"SELECT pollutant, cast(date AS varchar) AS date, 'p/' || pollutant AS path, valid_cells, cast(missing_cells AS bigint) AS missing_cells FROM ({_INVENTORY.format(lineitem='lineitem')})")
def inventory_lines(spark, sf):
    """A raster inventory written as JSON lines and scanned again."""
    rows = spark.sql(_INVENTORY, lineitem=table(spark, sf, "lineitem"))
    path = scratch(spark)
    rows.withColumn("path", F.concat(F.lit("p/"), "pollutant")).withColumn("variable", F.lit("v")).write.json(path)
    back = readers.read_inventory(spark, path)
    return back.select("pollutant", F.date_format("date", "yyyy-MM-dd").alias("date"), "path", "valid_cells", "missing_cells")


@query("S11_S12_write_once", "SELECT o_orderstatus AS status, count(*) AS n, sum(o_orderkey) AS keys, 1 AS second_refused FROM orders GROUP BY 1")
def written_once(spark, sf):
    """A versioned table: the first write is whole, a second one to the same path is refused and changes nothing."""
    orders, path = table(spark, sf, "orders"), scratch(spark)
    writers.write_once(orders, path, ["o_orderstatus"])
    refused = 0
    try:
        writers.write_once(orders.limit(1), path)
    except AnalysisException:
        refused = 1
    back = spark.read.schema(orders.schema).parquet(path)
    return back.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.lit(refused).alias("second_refused")
    )


@query("S13_parameters", "SELECT o_orderpriority AS priority, cast(min(o_orderdate) AS date)::varchar AS first, count(*) AS n FROM orders GROUP BY 1")
def parameters(spark, sf):
    """Parameters of a bounded number of groups, written as one JSON row and read by a later step."""
    found = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first"), F.count(F.lit(1)).alias("n"))
    path = scratch(spark)
    writers.write_parameters(spark, {r[0]: {"first": r[1], "n": r[2]} for r in found.collect()}, path)
    back = json.loads(json.dumps(writers.read_parameters(spark, path)))
    return spark.createDataFrame([(k, v["first"], v["n"]) for k, v in back.items()], "priority string, first string, n long")


@query("S14_scoped_snapshot", "SELECT o_orderkey, o_custkey, 1 AS other_scope_refused FROM orders")
def snapshot(spark, sf):
    """Rows kept with their scope: they load under it, and under no other."""
    path = scratch(spark)
    writers.write_snapshot(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), path, "exploratory")
    refused = 0
    try:
        writers.read_snapshot(spark, path, "formal")
    except writers.ContractError:
        refused = 1
    return writers.read_snapshot(spark, path, "exploratory").withColumn("other_scope_refused", F.lit(refused))


@query("S15_staging", "SELECT 'nation' AS name, n_nationkey AS key FROM nation UNION ALL SELECT 'region', r_regionkey FROM region")
def staging(spark, sf):
    """Named result tables copied into a staging folder."""
    target = scratch(spark)
    writers.stage(spark, {n: f"{sf}/{n}.parquet" for n in ("nation", "region")}, target)
    parts = [spark.read.parquet(f"{target}/{n}").select(F.lit(n).alias("name"), F.col(f"{n[0]}_{n}key").alias("key")) for n in ("nation", "region")]
    return parts[0].unionByName(parts[1])
