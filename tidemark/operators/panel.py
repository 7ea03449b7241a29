"""Panels of series on a common time key: spine, outer join, forward fill, as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_spine(daily: DataFrame, by: Sequence[str] = ("symbol",), day: str = "date") -> DataFrame:
    """Every calendar day between a series' first and last one; added days hold NULL.

    Works on tables of one row per (series, day). Each row brings along the empty days
    up to its successor, so no join is needed.
    """
    series = Window.partitionBy(*by).orderBy(day)
    upto = F.coalesce(F.date_sub(F.lead(day).over(series), 1), F.col(day))
    spanned = daily.withColumn("_upto", upto).withColumn(
        "_day", F.explode(F.sequence(F.col(day), F.col("_upto")))
    )
    own = F.col("_day") == F.col(day)
    others = [c for c in daily.columns if c not in (*by, day)]
    return spanned.select(
        *by, F.col("_day").alias(day), *[F.when(own, F.col(c)).alias(c) for c in others]
    )


def outer_panel(
    long: DataFrame, ids: Sequence[str], key: str = "date", series: str = "series", value: str = "value"
) -> DataFrame:
    """n series outer-joined on the time key, one column each.

    A pivot over a stated list: one shuffle for all series, folded before it, instead
    of one join per series. A series that delivered nothing still has its column; of
    several values for one key the largest counts, so reruns agree.
    """
    return long.groupBy(key).pivot(series, list(ids)).agg(F.max(value))


def complete_panel(long: DataFrame, ids: Sequence[str], **names: str) -> DataFrame:
    """The outer panel without the rows in which any series is missing: an inner join."""
    return outer_panel(long, ids, **names).na.drop("any", subset=list(ids))


def melt(panel: DataFrame, ids: Sequence[str], key: str = "date") -> DataFrame:
    return panel.unpivot(key, list(ids), "series", "value")


def filled_panel(long: DataFrame, ids: Sequence[str], key: str = "date") -> DataFrame:
    """The outer panel with each series carried forward; leading gaps stay NULL.

    Filled in long form, so each series has its own task; a series has one row per day
    that occurs anywhere in the panel.
    """
    dense = melt(outer_panel(long, ids, key), ids, key)
    series = Window.partitionBy("series").orderBy(key)
    return outer_panel(dense.withColumn("value", F.last("value", ignorenulls=True).over(series)), ids, key)


def asof_panel(
    spine: DataFrame,
    long: DataFrame,
    ids: Sequence[str],
    max_age_days: int | None = None,
    day: str = "date",
) -> DataFrame:
    """Attach market-wide series to a daily spine: the latest value on or before the day.

    Each observation is spread over the days on which it is the latest, which makes a
    table of one row per calendar day however large the spine is. The spine is read once
    and joins that table on the day; days past its end look up its last one.
    """
    observed = (
        long.where(F.col("value").isNotNull() & F.col("series").isin(*ids))
        .groupBy("series", day)
        .agg(F.max("value").alias("value"))
    )
    ordered = Window.partitionBy("series").orderBy(day)
    until = F.date_sub(F.lead(day).over(ordered), 1)
    if max_age_days is None:
        end = observed.agg(F.max(day)).scalar()
        until = F.coalesce(until, end)
        at = F.least(F.col(day), end)
    else:
        until = F.least(until, F.date_add(day, max_age_days))
        at = F.col(day)
    spread = observed.withColumn("_until", until).select(
        "series", "value", F.explode(F.sequence(day, "_until")).alias("_at")
    )
    wide = outer_panel(spread, ids, "_at")
    return spine.withColumn("_at", at).join(wide, "_at", "left").drop("_at")


def asof_daily(
    spine: DataFrame,
    feature: DataFrame,
    value: str,
    by: Sequence[str] = ("symbol",),
    max_age_days: int | None = None,
    day: str = "date",
) -> DataFrame:
    """Attach a per-series daily feature as of each day of the spine.

    Both sides have one row per (series, day) at most, so the pairing is an aggregate on
    that key and the lookup a window over the days of a series.
    """
    kept = [c for c in spine.columns if c not in (*by, day)]
    tagged = spine.withColumn("_wanted", F.lit(True))
    both = (
        tagged.unionByName(feature.select(*by, day, value), allowMissingColumns=True)
        .groupBy(*by, day)
        .agg(
            *[F.max(c).alias(c) for c in (*kept, "_wanted")],
            F.first(value, ignorenulls=True).alias(value),
        )
    )
    series = Window.partitionBy(*by).orderBy(day)
    latest = F.last(value, ignorenulls=True).over(series)
    if max_age_days is not None:
        seen = F.last(F.when(F.col(value).isNotNull(), F.col(day)), ignorenulls=True).over(series)
        latest = F.when(F.datediff(day, seen) <= max_age_days, latest)
    return both.withColumn(value, latest).where("_wanted").drop("_wanted")


def term_structure(closes: DataFrame) -> DataFrame:
    """Three index closes per day to a term-structure row; incomplete days are dropped."""
    # The three index tickers and their column names.
    legs = {"^VIX": "VIX", "^VIX9D": "VIX9D", "^VIX3M": "VX3M"}
    panel = complete_panel(closes, list(legs), series="ticker", value="close").withColumnsRenamed(legs)
    return panel.withColumns(
        {
            "term_slope": F.col("VX3M") - F.col("VIX9D"),
            "contango": (F.col("VX3M") > F.col("VIX")).cast("int"),
        }
    )
