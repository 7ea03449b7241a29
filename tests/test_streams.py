from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.checkers import close_to
from tidemark.operators import vpin
from tidemark.operators.bars import tick_bars
from tidemark.operators.depth import depth_imbalance
from tidemark.plans import testdata
from tidemark.streaming import jobs
from tidemark.streaming.vpin import drain_vpin, read_buckets

TICKS = "symbol string, ts timestamp, tick_id bigint, price double, qty double"


def _land(spark, folder, rows, schema=TICKS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_and_drops_late_ticks(spark, tmp_path):
    t, landed = datetime(2024, 1, 1), f"{tmp_path}/landed"
    rows = [("s", t + timedelta(minutes=7 * i), i, 10.0 + i % 5, 1.0) for i in range(60)]
    closing = [("s", t + timedelta(days=2), 998, 1.0, 1.0)]
    late = [("s", t + timedelta(minutes=1), 999, 500.0, 1.0)]
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    for part in (rows[:30], rows[30:], closing, late):
        _land(spark, landed, part)
        ticks = jobs.file_stream(spark, landed, TICKS)
        jobs.drain_to_parquet(jobs.stream_bars(ticks, "1 hour", "10 minutes", order=["ts", "tick_id"]), out, state)
    got = spark.read.parquet(out)
    batch = tick_bars(spark.createDataFrame(rows, TICKS), "1 hour", order=["ts", "tick_id"])
    assert got.count() == batch.count() == 7
    assert got.select(*batch.columns).exceptAll(batch).count() == 0


def test_depth_stream_equals_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "symbol string, timestamp timestamp, side string, level int, price double, quantity double"
    rows = [
        ("s", t + timedelta(minutes=m), side, k, 1.0, float(k + m)) for m in range(5) for side in ("bid", "ask") for k in range(3)
    ] + [("s", t + timedelta(days=1), "bid", 0, 1.0, 1.0)]
    _land(spark, f"{tmp_path}/landed", rows, schema)
    stream = jobs.stream_depth_imbalance(jobs.file_stream(spark, f"{tmp_path}/landed", schema), levels=2)
    jobs.drain_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out")
    batch = depth_imbalance(spark.createDataFrame(rows, schema), levels=2).where(F.col("timestamp") < "2024-01-02")
    assert got.count() == 5 and got.select(*batch.columns).exceptAll(batch).count() == 0


def test_book_stream_is_stateless(spark, sf_dir, tmp_path):
    books = testdata.landed_books(spark, sf_dir)
    books.write.parquet(f"{tmp_path}/landed")
    stream = jobs.stream_book_imbalance(spark.readStream.schema(books.schema).parquet(f"{tmp_path}/landed"))
    jobs.drain_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == books.count()


def _drained(spark, rows, folder, parts, partitions):
    """Buckets of hourly bars that land in ``parts`` portions and are written by ``partitions`` tasks."""
    schema, before = rows.schema, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        bounds = ["2024-01-01", *[f"2024-01-{d:02}" for d in parts], "2024-02-01"]
        for start, end in zip(bounds, bounds[1:]):
            part = rows.where((F.col("open_time") >= start) & (F.col("open_time") < end))
            part.repartition(partitions).write.mode("append").parquet(f"{folder}/landed")
            drain_vpin(jobs.file_stream(spark, f"{folder}/landed", schema), folder, f"{folder}/checkpoint", 60.0)
        return {(r["symbol"], r["bucket"]): r for r in read_buckets(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_vpin_stream_equals_batch(spark, sf_dir, tmp_path):
    """In one portion and in three, few and many partitions, with missing volumes; the open bucket stays open."""
    hourly = testdata.hourly_bars(spark, sf_dir).select("symbol", "open_time", "close", "volume")
    hourly = hourly.withColumn("volume", F.when(F.hour("open_time") != 5, F.col("volume"))).cache()
    one = _drained(spark, hourly, f"{tmp_path}/one", (), 3)
    three = _drained(spark, hourly, f"{tmp_path}/three", (9, 10), 20)
    batch = vpin.bucket_vpin(vpin.volume_buckets(hourly, v_star=60.0)).collect()
    last = {s: max(r["bucket"] for r in batch if r["symbol"] == s) for s in {r["symbol"] for r in batch}}
    want = {(r["symbol"], r["bucket"]): r for r in batch if r["bucket"] != last[r["symbol"]]}
    for got in (one, three):
        assert set(got) == set(want) and len(got) > 500
        for k, w in want.items():
            assert got[k]["timestamp"] == w["timestamp"]
            for c in ("dP", "V_total", "sigma_dP", "V_buy", "V_sell", "VPIN"):
                assert close_to(got[k][c], w[c], 1e-8), (k, c)
        assert any(r["VPIN"] is not None for r in got.values())
