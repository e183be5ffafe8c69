"""Readers and sinks."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from matchstrata.core import ContractError
from matchstrata.sources import readers, writers


def test_sources_aliases_and_empty_rows(spark, tmp_path):
    a = spark.createDataFrame([(2, "男", None, "x"), (3, None, None, None)], "row long, `性别` string, `审核状态` string, `卡片状态` string")
    a.write.parquet(str(tmp_path / "a"))
    (tmp_path / "b.csv").write_text("row,性别,卡片状态\n2,女,已终审\n", encoding="utf-8")
    cfg = [
        {"year": 2023, "path": str(tmp_path / "a"), "row_column": "row"},
        {"year": 2024, "path": str(tmp_path / "b.csv"), "format": "csv", "row_column": "row"},
    ]
    rows = readers.registry_sources(spark, cfg).orderBy("source_year").collect()
    assert [(r["source_year"], r["source_row"], r["sex"], r["review_status"]) for r in rows] == [
        (2023, 2, "男", None), (2024, 2, "女", "已终审"),
    ]


def test_csv_with_mark_and_gz(spark, tmp_path):
    p = tmp_path / "x.csv.gz"
    with gzip.open(p, "wt", encoding="utf-8-sig") as f:
        f.write("id,v\n007,1\n")
    df = readers.read_csv(spark, str(p))
    assert df.columns == ["id", "v"] and df.first()["id"] == "007"


def test_write_once_parameters_and_snapshot(spark, tmp_path):
    df = spark.range(3)
    writers.write_once(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        writers.write_once(df, str(tmp_path / "t"))
    writers.write_parameters(spark, {"knots": [1.5, 2.5]}, str(tmp_path / "p"))
    assert writers.read_parameters(spark, str(tmp_path / "p")) == {"knots": [1.5, 2.5]}
    writers.write_snapshot(df, str(tmp_path / "s"), "exploratory")
    assert writers.read_snapshot(spark, str(tmp_path / "s"), "exploratory").count() == 3
    with pytest.raises(ContractError):
        writers.read_snapshot(spark, str(tmp_path / "s"), "formal")
    writers.stage(spark, {"one": str(tmp_path / "t")}, str(tmp_path / "staged"))
    assert spark.read.parquet(str(tmp_path / "staged/one")).count() == 3


def test_hashes_and_drift(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.bin").write_bytes(b"abc")
    got = readers.content_hashes(spark, str(tmp_path / "f"))
    digest = hashlib.sha256(b"abc").hexdigest()
    assert got.first()["sha256"] == digest and got.first()["md5"] == hashlib.md5(b"abc").hexdigest()
    want = spark.createDataFrame([("a.bin", digest), ("b.bin", "0")], "filename string, sha256 string")
    assert [r["filename"] for r in readers.drifted(got, want).collect()] == ["b.bin"]


def test_raster_layout_prunes_partitions(spark, tmp_path):
    cells = spark.createDataFrame([("PM25", "2023-01-01", 0, 0, 12), ("O3", "2023-01-01", 0, 0, 65535)], "pollutant string, date string, lat_idx int, lon_idx int, raw int")
    writers.write_raster(cells.withColumn("date", F.col("date").cast("date")), str(tmp_path / "r"))
    df = readers.raster_cells(spark, str(tmp_path / "r"), ["PM25"], "2023-01-01")
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "pollutant" in plan.split("PartitionFilters")[1]


def test_date_of_name_needs_the_year(spark):
    df = spark.createDataFrame([("x/X_D1K_20230105_V4.nc", 2023), ("x/120230105.nc", 2023), ("x/20240105.nc", 2023)], "n string, y int")
    got = [r[0] for r in df.select(readers.date_of_name(F.col("n"), F.col("y"))).collect()]
    assert str(got[0]) == "2023-01-05" and got[1:] == [None, None]



def test_inventory_lines(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"pollutant":"PM25","date":"2023-01-01","path":"p","variable":"v","valid_cells":3,"missing_cells":1}\n')
    r = readers.read_inventory(spark, str(tmp_path / "i.jsonl")).first()
    assert r["pollutant"] == "PM25" and str(r["date"]) == "2023-01-01" and r["missing_cells"] == 1
