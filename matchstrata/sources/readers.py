"""Scans of registry exports, caches, rasters, weather responses and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Target column -> header aliases, the first present one wins.
ALIASES = {
    "onset": ["发病日期"],
    "birth": ["出生日期"],
    "sex": ["性别"],
    "icd10": ["ICD10"],
    "diagnosis_text": ["诊断"],
    "report_date": ["报告日期"],
    "diagnosis_date": ["诊断日期"],
    "identity": ["身份证号"],
    "card_no": ["报告卡编号"],
    "review_status": ["审核状态", "卡片状态"],
    "duplicate_flag": ["是否重卡"],
    "first_onset_flag": ["是否首次发病"],
    "treatment": ["心绞痛治疗措施"],
    "addr_province": ["现住地址（省）", "现住址省"],
    "addr_city": ["现住地址（市）", "现住址市"],
    "addr_district": ["现住地址（区县）", "现住址区县"],
    "addr_street": ["现住地址（街道/乡）", "现住址街道"],
    "addr_community": ["现住地址（居委会/村）", "现住址居委会"],
    "addr_number": ["现住地址（门牌号）", "现住址号"],
}
ROW = "source_row"


def aliased(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """One column per target: the first present alias, even if its values are null."""
    have = set(df.columns)

    def pick(target: str, names: list[str]) -> Column:
        found = next((n for n in names if n in have), None)
        return (F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(target)

    out = [pick(t, names) for t, names in aliases.items()]
    for extra in ("source_year", ROW):
        if extra in have:
            out.append(F.col(extra))
    number = next((n for n in aliases.get("identity", []) if n in have), None)
    stored = number is not None and dict(df.dtypes)[number] in ("int", "bigint", "double", "float")
    return df.select(*out, F.lit(int(stored)).alias("identity_is_number"))


def drop_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with at least one value among the data columns."""
    return df.na.drop("all", subset=columns)


def registry_sources(spark: SparkSession, sources: list[dict], aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Yearly sources of a config list as one table.

    Each source has year, path, format ('parquet' or 'csv') and row_column, the column with the
    row number of the original file: event ids embed it, so it must come from the data.
    """
    parts = []
    for s in sources:
        reader = spark.read
        if s.get("format", "parquet") == "csv":
            raw = reader.option("header", True).option("encoding", "UTF-8").csv(s["path"])
        else:
            raw = reader.parquet(s["path"])
        data = [c for c in raw.columns if c != s["row_column"]]
        kept = drop_empty(raw, data).withColumn("source_year", F.lit(int(s["year"])))
        kept = kept.withColumn(ROW, F.col(s["row_column"]).cast("long"))
        parts.append(aliased(kept, aliases))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def field_inventory(spark: SparkSession, tables: dict[int, DataFrame]) -> DataFrame:
    """(year, position, field) of every source."""
    rows = [(y, i + 1, c) for y, df in tables.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "year int, position int, field string")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Header CSV, plain or gz, with an optional byte-order mark; all columns text.

    No inference: identifiers stored as numbers would lose digits.
    """
    schema = StructType([StructField(c, StringType()) for c in columns]) if columns else None
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    clean = [c.replace("﻿", "") for c in df.columns]
    return df.toDF(*clean)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Raster inventory, one JSON object per line."""
    schema = "pollutant string, date date, path string, variable string, valid_cells long, missing_cells long"
    return spark.read.schema(schema).json(path)


def raster_cells(spark: SparkSession, path: str, pollutants: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Tall raster table partitioned by pollutant and date (S07); filters prune partitions."""
    df = spark.read.parquet(path)
    if pollutants:
        df = df.filter(F.col("pollutant").isin(pollutants))
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df


def date_of_name(name: Column, year: Column) -> Column:
    """The year's 8-digit date in a file name that is no part of a longer number."""
    base = F.substring_index(name, "/", -1)
    runs = F.regexp_extract_all(base, F.lit(r"(?<!\d)(\d{8})(?!\d)"), F.lit(1))
    hit = F.get(F.filter(runs, lambda r: r.startswith(year.cast("string"))), F.lit(0))
    return F.try_to_date(hit, "yyyyMMdd")


def published_files(metadata: DataFrame, years: range = range(2022, 2026)) -> DataFrame:
    """Download manifest rows from record metadata: daily 1-km files of the years.

    ``metadata``: pollutant, record, body (JSON with a ``files`` list).
    """
    schema = "files array<struct<key:string, size:bigint, checksum:string, links:struct<self:string>>>"
    files = metadata.select("pollutant", "record", F.explode(F.from_json("body", schema)["files"]).alias("f"))
    wanted = F.lit(False)
    for y in years:
        wanted = wanted | F.col("f.key").contains(f"_{y}_")
    return files.filter(F.col("f.key").contains("_D1K_") & wanted).select(
        "pollutant",
        "record",
        F.col("f.key").alias("filename"),
        F.col("f.size").alias("bytes"),
        F.col("f.checksum").alias("checksum"),
        F.col("f.links.self").alias("url"),
    )


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and MD5 of every file below a path (S10). Files of 2 GB and more do not fit a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.substring_index("path", "/", -1).alias("filename"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        F.md5("content").alias("md5"),
    )


def drifted(actual: DataFrame, expected: DataFrame, key: str = "filename", digest: str = "sha256") -> DataFrame:
    """Expected files that are absent or whose digest differs."""
    found = actual.select(key, F.col(digest).alias("__actual"))
    return expected.join(found, key, "left").filter(~F.col(digest).eqNullSafe(F.col("__actual"))).drop("__actual")


def coverage(files: DataFrame, years: list[int]) -> DataFrame:
    """Per pollutant and year: daily files against the calendar.

    ``files``: pollutant, year, date. Covered means every day present and none twice.
    """
    per_day = files.groupBy("pollutant", "year", "date").agg(F.count(F.lit(1)).alias("n"))
    per_year = per_day.groupBy("pollutant", "year").agg(
        F.sum("n").alias("daily_files"),
        F.count_if(F.year("date") == F.col("year")).alias("days_present"),
        F.count_if(F.col("n") > 1).alias("repeated_days"),
        F.count_if(F.col("date").isNull() | (F.year("date") != F.col("year"))).alias("foreign_days"),
    )
    length = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date("year", F.lit(1), F.lit(1)))
    ok = (F.col("days_present") == length) & (F.col("repeated_days") == 0) & (F.col("foreign_days") == 0)
    return per_year.filter(F.col("year").isin(years)).select(
        "pollutant", "year", "daily_files", length.alias("expected_days"), ok.cast("int").alias("covered")
    )
