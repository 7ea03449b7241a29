"""VPIN over a stream of closed bars.

The whole-sample bucket size looks ahead, so a stream needs a given ``v_star``. Each
micro-batch of closed bars is one batch step: bars are ordered by event time, buckets
that are complete are scored with the last ones of the batches before, and what the next
step needs is written beside them: per series the open bucket, the cumulative volume and
the last buckets that rolling frames reach back to. A series' bars come in event-time
order from one micro-batch to the next, as ``stream_bars`` emits them; how they are
spread over partitions and files inside one has no bearing on the result. A step that
runs again after a failure starts from the same state and overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import with_day
from ..operators.scan import SEGMENT_ROWS, carry_scan, settle
from ..operators.vpin import BUCKETS_PER_DAY, SIGMA_ROWS, VOLUME_TYPE, bucket_vpin
from ..session import stored
from ..sources.tables import read_table

HISTORY = SIGMA_ROWS + BUCKETS_PER_DAY  # buckets that a new one's frames reach back to
NUMBERED_AT_ONCE = 1_000_000  # buckets of a step that one task numbers
STATE = (
    "symbol string, bucket bigint, first double, last double, V_total double, timestamp timestamp, "
    f"cum {VOLUME_TYPE}, closed boolean"
)
BUCKETS = (
    "symbol string, bucket bigint, timestamp timestamp, dP double, V_total double, sigma_dP double, "
    "V_buy double, V_sell double, VPIN double"
)


def advance(bars: DataFrame, state: DataFrame, v_star: float) -> tuple[DataFrame, DataFrame]:
    """(scored buckets that these bars complete, state after them). A missing volume counts as none."""
    zero = F.lit(0).cast(VOLUME_TYPE)
    exact = F.coalesce(F.col("volume").cast(VOLUME_TYPE), zero)
    scanned = settle(
        carry_scan(
            with_day(bars, "open_time"), ("symbol",), "date", ["open_time"],
            running={"_cum": exact, "_pos": F.lit(1).cast("bigint")}, segment_rows=SEGMENT_ROWS,
        )
    )
    so_far = state.groupBy(F.col("symbol").alias("_symbol")).agg(F.max("cum").alias("_so_far"))
    cum = (F.col("_cum") + F.coalesce("_so_far", zero)).cast(VOLUME_TYPE)
    placed = scanned.join(so_far, F.col("symbol").eqNullSafe(F.col("_symbol")), "left").withColumn("cum", cum)
    placed = placed.withColumn("bucket", F.floor(F.col("cum").cast("double") / F.lit(float(v_star))).cast("bigint"))
    new = placed.groupBy("symbol", "bucket").agg(
        F.min_by("close", "_pos").alias("first"), F.max_by("close", "_pos").alias("last"),
        F.sum("volume").alias("V_total"), F.max("open_time").alias("timestamp"), F.max("cum").alias("cum"),
    )
    opened = state.where(~F.col("closed")).select(*new.columns)
    whole = new.unionByName(opened).groupBy("symbol", "bucket").agg(
        F.min_by("first", "timestamp").alias("first"), F.max_by("last", "timestamp").alias("last"),
        F.sum("V_total").alias("V_total"), F.max("timestamp").alias("timestamp"), F.max("cum").alias("cum"),
    )
    newest = whole.groupBy(F.col("symbol").alias("_symbol")).agg(F.max("bucket").alias("_newest"))
    split = stored(
        whole.join(newest, F.col("symbol").eqNullSafe(F.col("_symbol")))
        .withColumn("closed", F.col("bucket") < F.col("_newest")).drop("_symbol", "_newest"),
        "vpin-step",
    )
    fresh = split.where("closed").withColumn("_fresh", F.lit(True))
    line = fresh.unionByName(state.where("closed").withColumn("_fresh", F.lit(False)))
    priced = line.withColumn("dP", F.col("last") - F.col("first")).withColumn("V_star", F.lit(float(v_star)))
    # A backlog may close very many buckets at once; they are then numbered in segments.
    scored = bucket_vpin(priced, many=fresh.count() > NUMBERED_AT_ONCE).where("_fresh")
    latest = Window.partitionBy("symbol").orderBy(F.desc("bucket"))
    # Few rows each: a state's share, and from a step those near the end of a series.
    kept = line.withColumn("_age", F.row_number().over(latest)).where(F.col("_age") <= HISTORY)
    after = kept.select(*split.columns).unionByName(split.where(~F.col("closed")))
    names = [c.split()[0] for c in BUCKETS.split(", ")]
    return scored.select(*names), after.select(*split.columns)


def drain_vpin(bars: DataFrame, path: str, checkpoint: str, v_star: float) -> None:
    """Score what the bar stream emits now, then stop; a rerun continues from the checkpoint.

    Buckets go to ``path``/buckets, the state after each step to ``path``/state.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = stored(batch.select("symbol", "open_time", "close", "volume"), "vpin-bars")
        state = read_table(spark, f"{path}/state/{number - 1}", STATE)
        scored, after = advance(now, state, v_star)
        scored.write.mode("overwrite").parquet(f"{path}/buckets/step={number}")
        after.write.mode("overwrite").parquet(f"{path}/state/{number}")

    query = (
        bars.writeStream.foreachBatch(step).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The buckets that ``drain_vpin`` has written so far."""
    return read_table(spark, f"{path}/buckets", BUCKETS).drop("step")
