from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.bars import log_returns, with_day
from tidemark.operators.scan import SEGMENT, carry_scan, cut_days, settle
from tidemark.plans import testdata
from tidemark.sources import tables

ORDER = ["open_time", *testdata.DAILY_TICK_TIES]


def _hot(spark, sf_dir):
    """A third of all rows on one day of one symbol."""
    hot = F.col("l_orderkey") % 3 == 0
    return (
        testdata.daily_ticks(spark, sf_dir)
        .withColumn("symbol", F.when(hot, "N").otherwise(F.col("symbol")))
        .withColumn("open_time", F.when(hot, F.lit("1998-06-01").cast("timestamp")).otherwise(F.col("open_time")))
    )


def _by_one_window(df):
    w = Window.partitionBy("symbol").orderBy(*ORDER)
    return df.select(
        *ORDER, "symbol",
        F.lag("close").over(w).alias("prev"),
        F.sum(F.col("volume").cast("decimal(38,8)")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.row_number().over(w).cast("bigint").alias("n"),
        F.sum("volume").over(Window.partitionBy("symbol")).alias("total"),
    )


def test_equals_one_window(spark, sf_dir):
    df = _hot(spark, sf_dir)
    want = _by_one_window(df)
    for segment_rows in (None, 100):
        got = settle(
            carry_scan(
                with_day(df), ["symbol"], "date", ORDER,
                previous={"prev": "close"},
                running={"cum": F.col("volume").cast("decimal(38,8)"), "n": F.lit(1).cast("bigint")},
                totals={"total": ("sum", F.col("volume"))},
                segment_rows=segment_rows,
            )
        ).select(*want.columns)
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == 0


def test_segments_follow_the_order_and_stay_small(spark, sf_dir):
    cut = cut_days(with_day(_hot(spark, sf_dir)), ["symbol"], "date", ORDER, 100)
    sizes = [r["count"] for r in cut.groupBy("symbol", "date", SEGMENT).count().collect()]
    assert max(sizes) <= 300 and sum(sizes) == 6000
    w = Window.partitionBy("symbol", "date").orderBy(*ORDER)
    falls = cut.withColumn("_b", F.lag(SEGMENT).over(w)).where(F.col("_b") > F.col(SEGMENT))
    assert falls.count() == 0


def test_copies_can_be_cut_by_their_position(spark, sf_dir, tmp_path):
    """A third of the rows are copies of one trade."""
    trades = testdata.daily_ticks(spark, sf_dir)
    copies = trades.limit(1).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("_n")
    trades.unionByName(copies).repartition(3).write.parquet(f"{tmp_path}/trades")
    stored = tables.with_row_position(spark.read.parquet(f"{tmp_path}/trades"))
    order = [*ORDER, *tables.ROW_POSITION]
    cut = cut_days(with_day(stored), ["symbol"], "date", order, 200)
    sizes = [r["count"] for r in cut.groupBy("symbol", "date", SEGMENT).count().collect()]
    assert max(sizes) <= 600 and sum(sizes) == 9000
    running = {"n": F.lit(1).cast("bigint")}
    numbered = carry_scan(with_day(stored), ["symbol"], "date", order, running=running, segment_rows=200)
    ends = numbered.groupBy("symbol").agg(F.count_distinct("n").alias("k"), F.max("n").alias("m"), F.count("*").alias("c"))
    assert all(r["k"] == r["m"] == r["c"] for r in ends.collect())


def test_unnamed_series_is_cut_too(spark, sf_dir):
    unnamed = _hot(spark, sf_dir).withColumn("symbol", F.nullif("symbol", F.lit("N")))
    cut = cut_days(with_day(unnamed), ["symbol"], "date", ORDER, 100)
    sizes = [r["count"] for r in cut.groupBy("symbol", "date", SEGMENT).count().collect()]
    assert max(sizes) <= 300 and sum(sizes) == 6000
    assert cut.where("symbol is null").agg(F.max(SEGMENT)).first()[0] > 10


def test_small_days_are_left_alone(spark, sf_dir):
    cut = cut_days(with_day(testdata.daily_ticks(spark, sf_dir)), ["symbol"], "date", ORDER)
    assert cut.select(SEGMENT).distinct().collect() == [(0,)]


def test_one_null_return_per_series(spark, sf_dir):
    got = log_returns(testdata.hourly_bars(spark, sf_dir))
    nulls = got.where(F.col("log_ret").isNull()).groupBy("symbol").count().collect()
    assert sorted(r["count"] for r in nulls) == [1] * 5
