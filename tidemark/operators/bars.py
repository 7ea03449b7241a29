"""Ticks to bars, and log returns along a series of bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_ratio
from .scan import carry_scan, order_key, settle


def bar_aggregates(order: Sequence[str], has_side: bool) -> list[Column]:
    """Open, high, low, close, volume and counts of the ticks in one interval."""
    key = order_key(order)
    notional = F.col("price") * F.col("qty")
    out = [
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("qty").alias("volume"),
        F.sum(notional).alias("quote_asset_volume"),
        F.count(F.lit(1)).alias("number_of_trades"),
    ]
    if has_side:
        taker_buys = ~F.col("is_buyer_maker")
        out += [
            F.coalesce(F.sum(F.when(taker_buys, F.col("qty"))), F.lit(0.0)).alias("taker_buy_base_vol"),
            F.coalesce(F.sum(F.when(taker_buys, notional)), F.lit(0.0)).alias("taker_buy_quote_vol"),
        ]
    return out


def tick_bars(
    ticks: DataFrame,
    interval: str = "5 minutes",
    by: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Bars of ``interval``; an interval without ticks gives no bar.

    Also takes a watermarked stream. Ticks are folded before the shuffle, so one busy
    symbol or interval costs no more than the others. With a single order column the
    fold is a hash aggregate; with a tie-breaker Spark sorts each map partition first.
    """
    return (
        ticks.groupBy(*by, F.window("ts", interval).alias("open_time"))
        .agg(*bar_aggregates(order, "is_buyer_maker" in ticks.columns))
        .withColumn("open_time", F.col("open_time.start"))
        .withColumn("interval", F.lit(interval))
    )


def with_day(df: DataFrame, time: str = "open_time", name: str = "date") -> DataFrame:
    """Add the calendar day; a row without a time belongs to none and is left out."""
    return df.where(F.col(time).isNotNull()).withColumn(name, F.to_date(time))


def log_returns(
    bars: DataFrame,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    ties: Sequence[str] = (),
    price: str = "close",
    segment_rows: int | None = None,
) -> DataFrame:
    """``log_ret = ln(close / previous close)``; NULL at the first bar of a series."""
    scanned = carry_scan(
        with_day(bars, time, "_day"), by, "_day", [time, *ties],
        previous={"_prev": price}, segment_rows=segment_rows,
    )
    return settle(scanned).withColumn("log_ret", log_ratio(price, "_prev")).drop("_prev", "_day")


def daily_log_returns(
    daily: DataFrame, by: Sequence[str] = ("symbol",), day: str = "date", price: str = "close"
) -> DataFrame:
    """The same for one row per (series, day): few enough for a plain window."""
    before = F.lag(price).over(Window.partitionBy(*by).orderBy(day))
    return daily.withColumn("log_ret", log_ratio(F.col(price), before))
