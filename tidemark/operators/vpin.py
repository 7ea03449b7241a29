"""Volume-synchronised probability of informed trading.

Rows go whole into the volume bucket in which their cumulative volume ends; buckets are
classified into buying and selling volume, and the imbalance is averaged over the last
50 buckets. Rolling frames count bucket rows, because bucket numbers may skip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import norm_cdf, or_zero, zero_to
from ..session import stored
from .bars import with_day
from .panel import day_spine
from .scan import SEGMENT_ROWS, carry_scan, settle, trailing_blocks

# Fixed values of the measure.
BUCKETS_PER_DAY = 50
SIGMA_ROWS = 250
SIGMA_FLOOR = 1e-10

# Cumulative volume is added up without rounding, so bucket edges do not depend on the
# order or the grouping of the additions.
VOLUME_TYPE = "decimal(38,8)"


def volume_buckets(
    bars: DataFrame,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    ties: Sequence[str] = (),
    price: str = "close",
    volume: str = "volume",
    v_star: float | None = None,
    segment_rows: int | None = None,
) -> DataFrame:
    """One row per (series, bucket): price change, volume, time of the last row, v_star.

    The bucket size is the mean daily volume of the whole sample over 50, at least 1.
    That looks ahead; give ``v_star`` for a causal size. ``is_buyer_maker``, where
    present, yields the exact buying volume as ``V_taker``. Takes bars or ticks; for
    ticks pass ``segment_rows``.
    """
    exact = F.coalesce(F.col(volume).cast(VOLUME_TYPE), F.lit(0).cast(VOLUME_TYPE))
    scanned = settle(
        carry_scan(
            with_day(bars, time), by, "date", [time, *ties],
            running={"_cum": exact, "_pos": F.lit(1).cast("bigint")},
            totals={
                "_volume": ("sum", F.col(volume)),
                "_from": ("min", F.col(time)),
                "_to": ("max", F.col(time)),
            },
            segment_rows=segment_rows,
        )
    )
    if v_star is None:
        seconds = (F.unix_micros("_to") - F.unix_micros("_from")) / F.lit(1e6)
        days = F.greatest(F.floor(seconds / 86400), F.lit(1))
        size = F.greatest(F.col("_volume") / days / BUCKETS_PER_DAY, F.lit(1.0))
    else:
        size = F.lit(float(v_star))
    bucketed = scanned.withColumn("V_star", size).withColumn(
        "bucket", F.floor(F.col("_cum").cast("double") / F.col("V_star")).cast("bigint")
    )
    taker = []
    if "is_buyer_maker" in bars.columns:
        bought = F.when(~F.col("is_buyer_maker"), F.col(volume)).otherwise(0.0)
        taker = [F.sum(bought).alias("V_taker")]
    return bucketed.groupBy(*by, "bucket").agg(
        (F.max_by(price, "_pos") - F.min_by(price, "_pos")).alias("dP"),
        F.sum(volume).alias("V_total"),
        F.max(time).alias("timestamp"),
        F.max("V_star").alias("V_star"),
        *taker,
    )


def bucket_vpin(
    buckets: DataFrame,
    by: Sequence[str] = ("symbol",),
    signed_trades: bool = False,
    many: bool = False,
    block_rows: int = 20_000,
) -> DataFrame:
    """Add sigma, buying and selling volume and VPIN to each bucket.

    Buckets are numbered and split into overlapping blocks, so the rolling windows of a
    long series run in parallel. With the sample's own bucket size a series has about 50
    buckets a day, and one task numbers them with ease. A given, small ``v_star`` may
    yield as many as there are rows: ``many`` then stores the buckets and numbers them
    with an ordered scan.
    """
    if many:
        dated = with_day(stored(buckets, "buckets"), "timestamp")
        one = F.lit(1).cast("bigint")
        scanned = carry_scan(dated, by, "date", ["bucket"], running={"_row": one}, segment_rows=SEGMENT_ROWS)
        numbered = settle(scanned).drop("date")
    else:
        line = Window.partitionBy(*by).orderBy("bucket")
        numbered = buckets.withColumn("_row", F.row_number().over(line).cast("bigint"))
    reach = SIGMA_ROWS + BUCKETS_PER_DAY
    frame, _, own = trailing_blocks(numbered, by, "_row", reach, max(block_rows, reach))

    if signed_trades:
        bought = F.col("V_taker")
    else:
        frame = _trailing(frame, by, SIGMA_ROWS, {
            "n": F.count("dP"), "mean": F.avg("dP"), "var": F.var_pop("dP")
        })
        n1, n2 = F.col("_front_n"), F.col("_back_n")
        apart = F.coalesce(F.col("_front_mean") - F.col("_back_mean"), F.lit(0.0))
        m2 = or_zero(F.col("_front_var") * n1) + or_zero(F.col("_back_var") * n2)
        m2 = m2 + or_zero(apart * apart * n1 * n2 / F.nullif(n1 + n2, F.lit(0)))
        n = n1 + F.coalesce(n2, F.lit(0))
        frame = frame.withColumn("sigma_dP", zero_to(F.sqrt(F.when(n > 1, m2 / (n - 1))), SIGMA_FLOOR))
        bought = F.col("V_total") * norm_cdf(F.col("dP") / F.col("sigma_dP"))
    frame = frame.withColumn("V_buy", bought).withColumn("V_sell", F.col("V_total") - F.col("V_buy"))
    imbalance = F.abs(F.col("V_buy") - F.col("V_sell"))
    kept = [*frame.columns]
    # Where sigma came from windows, the rows already lie block by block.
    measures = {"n": F.count(imbalance), "sum": F.sum(imbalance)}
    frame = _trailing(frame, by, BUCKETS_PER_DAY, measures, dealt=not signed_trades)
    full = F.col("_front_n") + F.coalesce("_back_n", F.lit(0)) == BUCKETS_PER_DAY
    total = or_zero("_front_sum") + or_zero("_back_sum")
    vpin = F.when(full, total / (BUCKETS_PER_DAY * F.col("V_star")))
    plain = [c for c in kept if not c.startswith(("_front_", "_back_")) and c not in ("_block", "_row")]
    return frame.withColumn("VPIN", vpin).where(own).select(*plain, "VPIN")


# Chunks of so few rows are added up from each row to their end anew, which saves a sort.
SHORT_CHUNK = 64


def _trailing(
    frame: DataFrame, by: Sequence[str], rows: int, measures: dict[str, Column], dealt: bool = False
) -> DataFrame:
    """Aggregates over the last ``rows`` rows, in two parts to be merged: O(1) work per row.

    Rows are numbered by ``_row`` and fall into chunks of ``rows``. A row's frame is the
    front of its own chunk, up to itself, and the back of the chunk before, from the row
    that is ``rows - 1`` rows earlier; both are running aggregates of a chunk. Without
    such a row the back part is NULL. Front and look-back share one sort, as chunks follow
    the rows' order. ``dealt`` says that the rows lie block by block already.
    """
    chunked = frame.drop(*[f"_{part}_{m}" for part in ("front", "back") for m in measures]).withColumn(
        "_chunk", F.floor(F.col("_row") / rows)
    )
    chunk = Window.partitionBy(*by, "_block", "_chunk")
    line = Window.partitionBy(*by, "_block").orderBy("_chunk", "_row")
    front = chunk.orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    back = chunk.orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    if rows <= SHORT_CHUNK:
        back = chunk.orderBy("_row").rowsBetween(0, Window.unboundedFollowing)
    out = chunked if dealt else chunked.repartition(*by, "_block")
    out = out.withColumns({f"_rest_{m}": c.over(back) for m, c in measures.items()})
    out = out.withColumns({f"_front_{m}": c.over(front) for m, c in measures.items()})
    before = F.lag("_chunk", rows - 1).over(line) < F.col("_chunk")
    reached = {f"_back_{m}": F.lag(f"_rest_{m}", rows - 1).over(line) for m in measures}
    out = out.withColumns({**reached, "_before": before})
    return out.withColumns({c: F.when(F.col("_before"), F.col(c)) for c in reached}).drop(
        "_chunk", "_before", *[f"_rest_{m}" for m in measures]
    )


def vpin_daily(
    bars: DataFrame,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    ties: Sequence[str] = (),
    price: str = "close",
    volume: str = "volume",
    v_star: float | None = None,
    signed_trades: bool = False,
    segment_rows: int | None = None,
) -> DataFrame:
    """The last VPIN of each calendar day; days without a bucket are there, with NULL."""
    buckets = volume_buckets(bars, by, time, ties, price, volume, v_star, segment_rows)
    scored = bucket_vpin(buckets, by, signed_trades, many=v_star is not None)
    daily = scored.groupBy(*by, F.to_date("timestamp").alias("date")).agg(
        F.max_by("VPIN", F.when(F.col("VPIN").isNotNull(), F.col("bucket"))).alias("VPIN")
    )
    return day_spine(daily, by)
