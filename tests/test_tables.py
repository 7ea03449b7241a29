import math
import os
from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark import schemas, session
from tidemark.operators import profiling
from tidemark.sources import tables


def test_missing_file_gives_typed_empty(spark, tmp_path):
    df = tables.read_table(spark, f"{tmp_path}/none", schemas.RV_DAILY)
    assert df.count() == 0 and df.columns[:3] == ["symbol", "date", "RV"]


def test_write_and_read_range(spark, tmp_path):
    rows = [("a", datetime(2024, 1, n), math.nan if n == 3 else float(n)) for n in range(1, 6)]
    schema = "symbol string, open_time timestamp, close double"
    path = f"{tmp_path}/bars"
    for _ in range(2):  # the second write replaces the first
        tables.write_table(spark.createDataFrame(rows, schema), path)
    got = tables.read_table(spark, path, schema, "open_time", "2024-01-02", "2024-01-05").where("symbol = 'a'")
    assert [r["close"] for r in got.orderBy("open_time").collect()] == [2.0, None, 4.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "GreaterThanOrEqual(open_time" in plan


def test_profiles(spark, tmp_path):
    rows = [(date(2024, 1, 1), 1.0), (date(2024, 1, 3), math.nan), (None, None), (date(2024, 1, 2), 1.0)]
    spark.createDataFrame(rows, "date date, v double").write.parquet(f"{tmp_path}/full")
    spark.createDataFrame([], "date date, v double").write.parquet(f"{tmp_path}/empty")
    spark.createDataFrame([("x",)], "published_at string").write.parquet(f"{tmp_path}/untimed")
    names = ("full", "empty", "untimed", "absent")
    entries = [{"file": f"{tmp_path}/{n}", "source": "s", "asset": "a", "frequency": "1d"} for n in names]
    profiles = profiling.profile_files(spark, entries)
    got = {r["file"].split("/")[-1]: r for r in profiles.collect()}
    full = got["full"]
    assert (full["date_from"], full["date_to"]) == ("2024-01-01T00:00:00", "2024-01-03T00:00:00")
    assert full["missing_pct"] == {"date": 0.25, "v": 0.5} and full["columns"] == ["date", "v"]
    assert (full["rows"], full["status"], full["error"]) == (4, "OK", None)
    empty = got["empty"]
    assert (empty["rows"], empty["status"], empty["date_from"], empty["missing_pct"]) == (0, "OK", None, {})
    assert got["untimed"]["date_from"] == got["untimed"]["date_to"] == "Unknown"
    assert got["absent"]["status"] == "FAILED" and got["absent"]["error"]
    report = {r["file"]: r for r in profiling.quality_report(profiles).collect()}
    assert report["full"]["worst_missing_pct"] == 50.0 and report["absent"]["rows"] == 0
    profiling.write_manifest(profiles, f"{tmp_path}/manifest")
    assert spark.read.json(f"{tmp_path}/manifest").count() == 4


def test_iso_coverage_of_instants(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 5, 0, 0, 250000),)], "timestamp timestamp")
    assert profiling.profile(df, "f").first()["date_from"] == "2024-01-01T05:00:00.250000+00:00"


def test_enforce_schema(spark):
    df = spark.createDataFrame(
        [("1", "2.5", "2024-01-01 10:00:00", "k"), ("x", "y", "z", "k"), (None, None, None, "k")],
        "i string, f string, t string, other string",
    )
    schema = {"i": "int", "f": "float", "t": "datetime", "absent": "float"}
    got = profiling.enforce_schema(df, schema).collect()
    assert tuple(got[0]) == (1, 2.5, datetime(2024, 1, 1, 10), "k")
    assert tuple(got[1]) == tuple(got[2]) == (None, None, None, "k")
    assert {r["column"]: r["bad_cells"] for r in profiling.bad_cells(df, schema).collect()} == {"i": 1, "f": 1, "t": 1}


def test_scratch_is_deleted_and_the_rest_stays(spark):
    outer = session.stored(spark.range(3), "kept")
    with session.scratch(spark):
        inner = session.stored(spark.range(5), "inner")
        with session.scratch(spark):
            innermost = session.stored(spark.range(7), "innermost")
        assert inner.count() == 5 and not os.path.exists(innermost.inputFiles()[0].removeprefix("file://"))
    assert outer.count() == 3
    assert not any(os.path.exists(f.removeprefix("file://")) for f in inner.inputFiles())
