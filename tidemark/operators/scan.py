"""Ordered scans (previous row, running sum, row number) over long series.

A plain ``Window.partitionBy(series)`` puts a whole series into one task. Here a series
is cut into segments that follow its order: one per day, and a day that is too large for
one task is cut further at sampled order keys. A first pass reduces every segment to one
row (a partial aggregate, so little is shuffled); a window over those few rows tells each
segment what came before it. That knowledge travels as one extra *seed* row per segment,
which sorts first in its segment. The row-level window then needs no join and no
broadcast, and the data itself is shuffled once, on (series, day, segment).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEGMENT = "_segment"
IS_ROW = "_is_row"

# One task sorts this many rows comfortably, and spills beyond.
SEGMENT_ROWS = 4_000_000
# Up to so many cut points of all days together are broadcast: about 2.5 MB for plain keys.
# More of them, in a far larger table, are joined by a shuffle; segments never grow.
BROADCAST_CUTS = 50_000
# Sampled keys per kept cut point; more give more even segments.
OVERSAMPLE = 8


def order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def segment_window(by: Sequence[str], day: str, order: Sequence[str]) -> WindowSpec:
    """The window in which the rows of a scanned frame already lie."""
    return Window.partitionBy(*by, day, SEGMENT).orderBy(IS_ROW, *order)


def cut_days(
    df: DataFrame, by: Sequence[str], day: str, order: Sequence[str], rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Add the segment number: 0 everywhere, except in days of more than ``rows`` rows.

    Runs one small job to measure the days. Only if there are too large ones are keys
    sampled from them. The sample is chosen by a hash of the key and the cut points
    depend on nothing but the data, so a recomputed task finds the same segments.
    ``order`` has to identify a row within its series.
    """
    days = df.groupBy(*by, day).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = days.agg(F.sum("_n"), F.max("_n")).first()
    limit = rows
    few = (total or 0) / limit <= BROADCAST_CUTS
    if (largest or 0) <= limit:
        return df.withColumn(SEGMENT, F.lit(0))

    # At most total / limit days are that large, and about OVERSAMPLE times as many keys
    # are sampled. The joins are null-safe, as a missing series name may be the largest series.
    large = days.where(F.col("_n") > limit)
    sampled = (
        df.select(*by, day, *[c for c in order if c not in by])
        .join(*_on(large, [*by, day], [], few), "left_semi")
        .where(F.pmod(F.xxhash64(*order), F.lit(max(limit // OVERSAMPLE, 1))) == 0)
        .groupBy(*by, day)
        .agg(F.sort_array(F.collect_set(order_key(order))).alias("_keys"))
    )
    cuts = sampled.withColumn(
        "_cuts", F.filter("_keys", lambda _, i: (i + 1) % OVERSAMPLE == 0)
    ).where(F.size("_cuts") > 0)
    halvings = F.sequence(F.floor(F.log2(F.size("_cuts"))).cast("int"), F.lit(0), F.lit(-1))
    steps = F.transform(halvings, lambda b: F.call_function("shiftleft", F.lit(1), b))
    cuts = cuts.withColumn("_steps", steps)
    return (
        df.join(*_on(cuts, [*by, day], ["_cuts", "_steps"], few), "left")
        .withColumn(SEGMENT, _count_at_or_below("_cuts", "_steps", order_key(order)))
        .select(*df.columns, SEGMENT)
    )


def _on(small: DataFrame, keys: Sequence[str], values: Sequence[str], few: bool) -> tuple[DataFrame, Column]:
    """The small side of a null-safe equi-join, with its keys renamed, and the condition."""
    named = small.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *values)
    return F.broadcast(named) if few else named, reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    )


def _count_at_or_below(cuts: str, steps: str, key: Column) -> Column:
    """How many of the sorted cut points are <= key, by bisection in falling powers of two."""
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda n, step: F.when(F.get(F.col(cuts), n + step - 1) <= key, n + step).otherwise(n),
    )
    return F.when(F.col(cuts).isNull(), F.lit(0)).otherwise(found)


def carry_scan(
    df: DataFrame,
    by: Sequence[str],
    day: str,
    order: Sequence[str],
    *,
    previous: Mapping[str, str] | None = None,
    running: Mapping[str, Column] | None = None,
    totals: Mapping[str, tuple[str, Column]] | None = None,
    latest: Mapping[str, Column] | None = None,
    segment_rows: int | None = None,
) -> DataFrame:
    """Add order-dependent columns to ``df``.

    previous      {new: column}: the value one row earlier in the series
    latest        {new: expression}: its last value that is not NULL, up to and including the row
    running       {new: expression}: sum up to and including the row; exact only for
                  integer and decimal expressions, whose sum has no rounding
    totals        {new: ("sum" | "min" | "max", expression)} over the whole series
    segment_rows  None if a day is known to be small (bars on a time grid), otherwise
                  the number of rows above which a day is cut

    ``day`` has to be a function of ``order`` that never decreases along it. The result
    keeps the helper columns of ``segment_window``, so that later windows over it cost
    no further shuffle or sort; ``settle`` drops them.
    """
    previous, running, totals, latest = previous or {}, running or {}, totals or {}, latest or {}
    if segment_rows is None:
        cut = df.withColumn(SEGMENT, F.lit(0))
    else:
        cut = cut_days(df, by, day, order, segment_rows)

    key = order_key(order)
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    summary = cut.groupBy(*by, day, SEGMENT).agg(
        *[F.max_by(c, key).alias(f"_last_{new}") for new, c in previous.items()],
        *[F.sum(e).alias(f"_sum_{new}") for new, e in running.items()],
        *[fold[how](e).alias(f"_part_{new}") for new, (how, e) in totals.items()],
        *[F.max_by(e, F.when(e.isNotNull(), key)).alias(f"_known_{new}") for new, e in latest.items()],
    )

    series = Window.partitionBy(*by)
    so_far = series.orderBy(day, SEGMENT)
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    seeds = summary.select(
        *by,
        day,
        SEGMENT,
        F.lit(0).alias(IS_ROW),
        *[F.lag(f"_last_{new}").over(so_far).alias(f"_src_{new}") for new in previous],
        *[F.sum(f"_sum_{new}").over(earlier).alias(f"_src_{new}") for new in running],
        *[fold[how](f"_part_{new}").over(series).alias(f"_src_{new}") for new, (how, _) in totals.items()],
        *[F.last(f"_known_{new}", ignorenulls=True).over(earlier).alias(f"_src_{new}") for new in latest],
    )
    rows = cut.select(
        "*",
        F.lit(1).alias(IS_ROW),
        *[F.col(c).alias(f"_src_{new}") for new, c in previous.items()],
        *[e.alias(f"_src_{new}") for new, e in (*running.items(), *latest.items())],
    )

    within = segment_window(by, day, order)
    until = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = rows.unionByName(seeds, allowMissingColumns=True).withColumns(
        {
            **{new: F.lag(f"_src_{new}").over(within) for new in previous},
            **{new: F.sum(f"_src_{new}").over(until) for new in running},
            **{new: F.first(f"_src_{new}").over(until) for new in totals},
            **{new: F.last(f"_src_{new}", ignorenulls=True).over(until) for new in latest},
        }
    )
    helpers = [f"_src_{new}" for new in (*previous, *running, *totals, *latest)]
    return scanned.where(F.col(IS_ROW) == 1).drop(*helpers)


def settle(df: DataFrame) -> DataFrame:
    return df.drop(SEGMENT, IS_ROW)


def trailing_blocks(
    df: DataFrame, by: Sequence[str], position: str, reach: int, block_rows: int = 1_000_000
) -> tuple[DataFrame, WindowSpec, Column]:
    """Split a numbered series into blocks for windows that look back a fixed number of rows.

    ``position`` numbers the rows of a series 1, 2, ... without gaps. Every block also
    gets copies of the ``reach`` rows before it. Returns the frame, the window to build
    trailing frames on, and the condition that tells a block's own rows from the copies.
    """
    if reach > block_rows:
        raise ValueError("a block must be longer than the reach of its windows")
    block = F.floor((F.col(position) - 1) / block_rows)
    offset = F.col(position) - 1 - block * block_rows
    blocks = F.when(offset >= block_rows - reach, F.array(block, block + 1)).otherwise(F.array(block))
    split = df.withColumn("_block", F.explode(blocks))
    own = F.col("_block") == block
    return split, Window.partitionBy(*by, "_block").orderBy(position), own
