"""Keyed state against the batch result and the step-wise stream; redelivered and late ticks."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.checkers import close_to
from tidemark.operators import vpin
from tidemark.operators.bars import tick_bars
from tidemark.plans import testdata
from tidemark.streaming import jobs
from tidemark.streaming.keyed import drain_keyed_vpin

BARS = "symbol string, open_time timestamp, close double, volume double"
TICKS = "symbol string, ts timestamp, tick_id bigint, price double, qty double"


def test_keyed_vpin_equals_batch_over_restarts(spark, sf_dir, tmp_path):
    """Bars that land in three portions, each in a run of its own and shuffled inside, with missing volumes."""
    hourly = testdata.hourly_bars(spark, sf_dir).select("symbol", "open_time", "close", "volume")
    hourly = hourly.withColumn("volume", F.when(F.hour("open_time") != 5, F.col("volume"))).cache()
    landed, out = f"{tmp_path}/landed", f"{tmp_path}/out"
    bounds = ["2024-01-01", "2024-01-09", "2024-01-10", "2024-02-01"]
    for start, end in zip(bounds, bounds[1:]):
        part = hourly.where((F.col("open_time") >= start) & (F.col("open_time") < end))
        part.repartition(5, F.hash("close")).write.mode("append").parquet(landed)
        drain_keyed_vpin(jobs.file_stream(spark, landed, BARS), out, f"{tmp_path}/state", 60.0)
    got = {(r["symbol"], r["bucket"]): r for r in spark.read.parquet(out).collect()}
    batch = vpin.bucket_vpin(vpin.volume_buckets(hourly, v_star=60.0)).collect()
    last = {s: max(r["bucket"] for r in batch if r["symbol"] == s) for s in {r["symbol"] for r in batch}}
    want = {(r["symbol"], r["bucket"]): r for r in batch if r["bucket"] != last[r["symbol"]]}
    assert set(got) == set(want) and len(got) > 500
    for k, w in want.items():
        assert got[k]["timestamp"] == w["timestamp"]
        for c in ("dP", "V_total", "sigma_dP", "V_buy", "V_sell", "VPIN"):
            assert close_to(got[k][c], w[c], 1e-8), (k, c)
    assert any(r["VPIN"] is not None for r in got.values())


def test_redelivered_ticks_count_once(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("s", t + timedelta(minutes=7 * i), i, 10.0 + i % 5, 1.0) for i in range(40)]
    again = [r for r in rows[20:] if r[2] % 3 == 0]
    closing = [("s", t + timedelta(days=2), 998, 1.0, 1.0)]
    late = [("s", t + timedelta(minutes=1), 999, 500.0, 1.0)]
    landed, out, counts = f"{tmp_path}/landed", f"{tmp_path}/out", []
    for part in (rows[:30] + again[:2], rows[30:] + again[3:], closing, late):
        spark.createDataFrame(part, TICKS).coalesce(1).write.mode("append").parquet(landed)
        ticks = jobs.file_stream(spark, landed, TICKS)
        bars = jobs.stream_bars(ticks, "1 hour", "3 hours", order=["ts", "tick_id"], trade_id="tick_id")
        counts.append(jobs.drain_to_parquet(bars, out, f"{tmp_path}/state"))
    batch = tick_bars(spark.createDataFrame(rows, TICKS), "1 hour", order=["ts", "tick_id"])
    got = spark.read.parquet(out).select(*batch.columns)
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0
    total = {k: sum(c[k] for c in counts) for k in counts[0]}
    assert total["input"] == len(rows) + len(again) - 1 + 2
    assert total["late"] == 1
    assert total["repeated"] == len(again) - 1
