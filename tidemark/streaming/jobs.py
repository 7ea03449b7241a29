"""Structured Streaming forms of the bar and depth jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.bars import tick_bars
from ..operators.depth import book_imbalance, depth_imbalance


def stream_bars(
    ticks: DataFrame,
    interval: str = "5 minutes",
    delay: str = "10 minutes",
    by: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
    trade_id: str | None = None,
) -> DataFrame:
    """Bars of a tick stream, each emitted once when the watermark has passed its end.

    Ticks later than ``delay`` are dropped. State is one row per open (series, interval).
    With ``trade_id`` a tick that is delivered again counts once: of a series' ticks with one
    id only the first is taken, as long as the repeats lie within ``delay`` of it. That
    adds a row of state per tick, which goes with the watermark.
    """
    marked = ticks.withWatermark("ts", delay)
    if trade_id:
        marked = marked.dropDuplicatesWithinWatermark([*by, trade_id])
    return tick_bars(marked, interval, by, order)


def stream_book_imbalance(
    snapshots: DataFrame, by: Sequence[str] = ("symbol", "timestamp"), levels: int | None = None
) -> DataFrame:
    """Imbalance of landed snapshots as they arrive; stateless."""
    return book_imbalance(snapshots, by, levels)


def stream_depth_imbalance(
    depth: DataFrame,
    delay: str = "1 minute",
    by: Sequence[str] = ("symbol",),
    levels: int | None = None,
) -> DataFrame:
    """Imbalance of a stream of level rows; a snapshot closes with the watermark."""
    return depth_imbalance(depth.withWatermark("timestamp", delay), [*by, "timestamp"], levels)


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> dict[str, int]:
    """Process what is there in append mode, then stop; a rerun continues from the checkpoint.

    Returns how many rows came in (``input``), came too late for the watermark (``late``)
    and were dropped as repeats (``repeated``).
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return drained_counts(query.recentProgress)


def drained_counts(progress: Sequence) -> dict[str, int]:
    counts = {"input": 0, "late": 0, "repeated": 0}
    for step in progress:
        counts["input"] += step["numInputRows"]
        for operator in step["stateOperators"]:
            counts["late"] += operator["numRowsDroppedByWatermark"]
            counts["repeated"] += operator["customMetrics"].get("numDroppedDuplicateRows", 0)
    return counts


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files that land in a folder.

    A bound on the files of a trigger spreads a backlog over micro-batches; order between
    files then has to come from event time and a watermark.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
