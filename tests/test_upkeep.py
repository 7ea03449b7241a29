"""Incremental upkeep, profiles from the writing pass, and mergeable sketches."""

import os
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import model, news, profiling
from tidemark.plans import testdata as data
from tidemark.plans.queries import QUERIES
from tidemark.sources import tables

BAR = "symbol string, open_time timestamp, close double"


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_merge_touches_only_its_months(spark, tmp_path):
    path, t = f"{tmp_path}/bars", datetime(2024, 1, 1)
    rows = {(s, t + timedelta(days=d)): float(d) for s in ("x", "y") for d in range(0, 90, 5)}
    frame = lambda rows: spark.createDataFrame([(*k, v) for k, v in rows.items()], BAR)
    assert tables.merge_rows(frame(rows), path).count() == 6
    before = _files(path)
    late = {("x", t + timedelta(days=31)): 500.0, ("x", t + timedelta(days=35)): -1.0, ("z", t + timedelta(days=40)): 7.0}
    touched = tables.merge_rows(frame(late).unionByName(spark.createDataFrame([("x", None, 1.0)], BAR)), path)
    assert {tuple(r) for r in touched.collect()} == {("x", "2024-02"), ("z", "2024-02")}
    after = _files(path)
    kept = {f for f in before if "symbol=x/month=2024-02" not in f}
    assert kept and all(after[f] == before[f] for f in kept)
    assert not any(f in after for f in set(before) - kept)
    want = {**rows, **late}
    got = tables.read_history(spark, "bars", path, BAR, "open_time")
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want and got.count() == len(want)
    part = tables.read_history(spark, "bars", path, BAR, "open_time", "2024-02-05", "2024-02-15")
    assert {(r[0], r[1]) for r in part.collect()} == {k for k in want if datetime(2024, 2, 5) <= k[1] < datetime(2024, 2, 15)}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters")[1].split("]")[0]


def test_merge_of_repeated_keys_and_start(spark, tmp_path):
    path, t = f"{tmp_path}/bars", datetime(2018, 12, 31)
    twice = [("x", t, 1.0), ("x", t, 3.0), ("x", t, 2.0), ("x", t + timedelta(days=1), 4.0)]
    tables.merge_rows(spark.createDataFrame(twice, BAR), path)
    got = tables.read_history(spark, "bars", path, BAR, "open_time", "2018-01-01").orderBy("open_time").collect()
    assert [r["close"] for r in got] == [3.0, 4.0]
    # Histories begin at their start unless asked otherwise.
    assert [r["close"] for r in tables.read_history(spark, "bars", path, BAR, "open_time").collect()] == [4.0]
    tables.merge_rows(spark.createDataFrame([], BAR), path)
    assert tables.read_history(spark, "bars", path, BAR, "open_time").count() == 1
    assert tables.read_history(spark, "bars", f"{tmp_path}/none", BAR, "open_time").count() == 0


def test_profile_of_the_writing_pass(spark, tmp_path):
    rows = [("x", datetime(2024, 1, 1, 5, 0, 0, 250000), 1.0), ("y", datetime(2024, 1, 3), float("nan")), ("x", None, None)]
    df = spark.createDataFrame(rows, BAR)
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    counted = df.mapInArrow(seen, df.schema)
    got = profiling.write_profiled(counted, f"{tmp_path}/t", "s", "a", "5m", file="f").first().asDict()
    assert ran.value == 3  # computed once, for the files
    want = profiling.profile(df, "f", "s", "a", "5m").first().asDict()
    assert {k: v for k, v in got.items() if k != "pull_timestamp"} == {k: v for k, v in want.items() if k != "pull_timestamp"}
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    none = profiling.write_profiled(df.limit(0), f"{tmp_path}/e", time="open_time").first()
    assert (none["rows"], none["status"], none["date_from"], none["missing_pct"]) == (0, "OK", None, {})


def test_merged_source_sketches(spark):
    n = 60_000
    events = spark.range(n).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 30).cast("int"))).alias("DATE"),
        F.when(F.col("id") % 10 != 0, (F.col("id") % 20_000).cast("string")).alias("SourceCommonName"),
    )
    exact = events.agg(F.count_distinct("SourceCommonName")).first()[0]
    days = news.source_sketches(events)
    row = news.source_diversity(days).first()
    assert days.count() == 30 and row["event_count"] == n
    assert abs(row["source_diversity"] - exact) <= 3 * 1.04 / 2**7 * exact
    whole = events.agg(F.hll_sketch_estimate(F.hll_sketch_agg("SourceCommonName", F.lit(news.SKETCH_BITS)))).first()[0]
    assert abs(whole - row["source_diversity"]) <= 0.01 * exact
    assert news.source_diversity(news.source_sketches(events.limit(0))).count() == 0


def test_source_diversity_is_exact_beyond_a_sketch(spark, tmp_path):
    """60,000 sources, each on two days of both weeks, and events without a source."""
    n = 240_000
    events = spark.range(n).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.floor(F.col("id") / 60_000).cast("int") * 4)).alias("ts"),
        F.when(F.col("id") % 60_000 != 0, F.col("id") % 60_000).alias("user_id"),
        F.lit("view").alias("event_type"),
        F.lit(1.0).alias("value"),
        F.lit('{"k": 1}').alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["span"]: (r["source_diversity"], r["event_count"]) for r in QUERIES["source_diversity_weekly"](spark, str(tmp_path)).collect()}
    assert got == {"2024-01-01": (59_999, 120_000), "2024-01-08": (59_999, 120_000)}
    assert news.exact_source_diversity(news.daily_sources(data.gkg(spark, str(tmp_path)).limit(0))).count() == 0


def test_merged_residual_sketches(spark):
    rng = np.random.default_rng(9)
    resid = {s: rng.normal(0, k, 3000) for k, s in enumerate(("x", "y"), 1)}
    rows = [(s, datetime(2015, 1, 1).date() + timedelta(days=i), 2.0, float(v)) for s, vs in resid.items() for i, v in enumerate(vs)]
    rows.append(("x", datetime(2030, 1, 1).date(), 2.0, None))
    f = spark.createDataFrame(rows, "symbol string, date date, pred_log_RV double, resid double")
    sketches = model.residual_sketches(f)
    assert sketches.count() == 2 * 99
    got = model.sketched_quantiles(f, sketches, probabilities=(0.05, 0.5, 0.95))
    assert got.count() == len(rows)
    for r in got.select("symbol", "q05", "q50", "q95").distinct().collect():
        for c, p in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95)):
            assert abs((resid[r["symbol"]] <= r[c] - 2.0 + 1e-9).mean() - p) <= 0.022
    assert model.sketched_quantiles(f.limit(0), model.residual_sketches(f.limit(0))).count() == 0
