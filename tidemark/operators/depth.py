"""Order-book imbalance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..schemas import BOOK, BOOK_LEVELS
from .scan import carry_scan, order_key, settle


def _imbalance(bid: Column, ask: Column) -> Column:
    return ratio(bid - ask, bid + ask)


def depth_imbalance(
    depth: DataFrame, by: Sequence[str] = ("symbol", "timestamp"), levels: int | None = None
) -> DataFrame:
    """(bid - ask) / (bid + ask) quantity per snapshot from rows of one level each.

    Levels count from 0, the best quote. An empty book gives NULL.
    """
    rows = depth if levels is None else depth.where(F.col("level") < levels)
    side = F.col("side")
    sums = rows.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(side == "bid", F.col("quantity"))), F.lit(0.0)).alias("bid_qty"),
        F.coalesce(F.sum(F.when(side == "ask", F.col("quantity"))), F.lit(0.0)).alias("ask_qty"),
    )
    return sums.withColumn("imbalance", _imbalance(F.col("bid_qty"), F.col("ask_qty")))


def book_imbalance(
    landed: DataFrame, by: Sequence[str] = ("symbol", "timestamp"), levels: int | None = None
) -> DataFrame:
    """The same straight from landed snapshots, which hold a whole book per row.

    Sums the quantities inside the row, so neither rows nor a shuffle arise; also runs on
    a stream without state.
    """
    depth = BOOK_LEVELS if levels is None else levels

    def quantity(quotes: str) -> Column:
        return F.aggregate(
            F.slice(F.coalesce(F.col(quotes), F.array().cast("array<array<string>>")), 1, depth),
            F.lit(0.0),
            lambda total, q: total + F.get(q, F.lit(1)).cast("double"),
        )

    book = landed.withColumn("payload", F.from_json("payload", BOOK))
    return book.select(
        *by, quantity("payload.bids").alias("bid_qty"), quantity("payload.asks").alias("ask_qty")
    ).withColumn("imbalance", _imbalance(F.col("bid_qty"), F.col("ask_qty")))


def book_from_updates(
    updates: DataFrame,
    every: str = "1 hour",
    levels: int = BOOK_LEVELS,
    by: Sequence[str] = ("symbol",),
    time: str = "ts",
    ties: Sequence[str] = (),
) -> DataFrame:
    """The best ``levels`` quotes a side at each sampling time, from single changes of a book.

    An update sets the quantity at (side, price); 0 takes the level away, and of several
    the last one counts (``ties`` order those of one time). Sampling times are the
    multiples of ``every``, up to the first one from the newest update on; an update
    belongs to the first sampling time that is not before it. An update without a time,
    side, price or quantity says nothing and is left out.

    A level's updates between two sampling times are folded to the last before the shuffle,
    so busy levels cost one row a sample. How long each of those rows stands comes from an
    ordered scan in falling time, in segments of a day; no task holds a level's or a day's
    whole history. Only what stands at a sampling time is spread over it, and of that the
    best levels are kept.
    """
    step = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00' + interval {every})")
    micros = F.unix_micros(F.col(time))
    sound = [F.col(c).isNotNull() for c in (time, "side", "price", "quantity")]
    level = [*by, "side", "price"]
    last = (
        updates.where(reduce(and_, sound))
        .withColumn("_slot", micros + F.pmod(-micros, step))
        .groupBy(*level, "_slot")
        .agg(F.max_by("quantity", order_key([time, *ties])).alias("quantity"))
    )
    falling = last.withColumns({"_back": -F.col("_slot"), "_day": F.floor(-F.col("_slot") / 86_400_000_000)})
    following = settle(carry_scan(falling, level, "_day", ["_back"], previous={"_next": "_slot"}))
    newest = updates.where(reduce(and_, sound)).agg(F.max(micros + F.pmod(-micros, step))).first()[0]
    until = F.coalesce(F.col("_next") - step, F.lit(newest).cast("bigint"))
    standing = following.where(F.col("quantity") > 0).withColumn("_at", F.explode(F.sequence("_slot", until, step)))
    best_first = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    line = Window.partitionBy(*by, "_at", "side").orderBy(best_first)
    ranked = standing.withColumn("level", F.row_number().over(line) - 1).where(F.col("level") < levels)
    return ranked.select(*by, F.timestamp_micros("_at").alias("timestamp"), "side", "level", "price", "quantity")


def book_summary(levels: DataFrame, by: Sequence[str] = ("symbol", "timestamp")) -> DataFrame:
    """Imbalance, best quotes, spread and number of levels of each book of level rows."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    quantity = lambda side: F.coalesce(F.sum(F.when(side, F.col("quantity"))), F.lit(0.0))
    books = levels.groupBy(*by).agg(
        quantity(bid).alias("bid_qty"), quantity(ask).alias("ask_qty"),
        F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"),
        F.count(F.lit(1)).alias("n_levels"),
    )
    spread = F.col("best_ask") - F.col("best_bid")
    return books.withColumns({"spread": spread, "imbalance": _imbalance(F.col("bid_qty"), F.col("ask_qty"))})
