"""One pass from bars to daily realized-variance and microstructure measures.

Both families need the same returns on the same (series, day) groups, so one aggregate
computes them all; ``realized_daily`` and ``micro_daily`` select from it and Catalyst
prunes what they do not use.

The bars are read and shuffled once, on (series, day, segment); a segment is a day or,
if the day is too large for one task, a part of it (see ``scan``). Inside a segment all
returns but the first are known, and the segment is reduced to one row of moments plus
its edges: first and last price, first and last return. Everything that crosses an edge
(the return over midnight, the return pairs around a seam) is added afterwards on those
few rows. Second moments are merged around the day's mean, so nothing cancels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bars import EPS, bar_imbalance, buy_volume_proxy, garman_klass, parkinson
from ..functions.columns import log_ratio, or_zero, ratio
from .bars import with_day
from .scan import IS_ROW, SEGMENT, cut_days, segment_window


def daily_measures(
    bars: DataFrame,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    ties: Sequence[str] = (),
    segment_rows: int | None = None,
) -> DataFrame:
    """All intraday measures, one row per (series, date).

    ``segment_rows`` may stay None for bars on a time grid, whose number per day is
    bounded. For ticks give the row count above which one day is cut.
    """
    order = [time, *ties]
    dated = with_day(bars, time)
    if segment_rows is None:
        cut = dated.withColumn(SEGMENT, F.lit(0))
    else:
        cut = cut_days(dated, by, "date", order, segment_rows)
    return _merge_segments(_reduce_segments(cut.withColumn(IS_ROW, F.lit(1)), by, order), by)


def _reduce_segments(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    within = segment_window(by, "date", order)
    has_volume = "volume" in rows.columns
    volume = F.col("volume") if has_volume else F.lit(None).cast("double")
    imbalance = bar_imbalance(buy_volume_proxy(), "volume") if has_volume else volume

    placed = rows.withColumns(
        {
            "_pos": F.row_number().over(within),
            "_c1": F.lag("close", 1).over(within),
            "_c2": F.lag("close", 2).over(within),
        }
    )
    pos = F.col("_pos")
    returns = placed.withColumns(
        {
            "_r": F.when(pos > 1, or_zero(log_ratio("close", "_c1"))),
            "_q": F.when(pos > 2, or_zero(log_ratio("_c1", "_c2"))),
            "_obi": imbalance,
        }
    )
    r, q, obi = F.col("_r"), F.col("_q"), F.col("_obi")
    paired = F.when(q.isNotNull(), r)
    return returns.groupBy(*by, "date", SEGMENT).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("open", pos).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", pos).alias("close"),
        F.sum(volume).alias("volume"),
        F.min_by("close", pos).alias("first_close"),
        F.min_by(volume, pos).alias("first_volume"),
        F.min_by(r, F.when(pos > 1, pos)).alias("second_r"),
        F.max_by(r, F.when(pos > 1, pos)).alias("final_r"),
        or_zero(F.sum(r * r)).alias("r2"),
        or_zero(F.sum(r * r * r)).alias("r3"),
        or_zero(F.sum(r * r * r * r)).alias("r4"),
        or_zero(F.sum(F.abs(r) / (volume + EPS))).alias("illiq"),
        F.count(volume).alias("illiq_n"),
        or_zero(F.sum(F.abs(r) * F.abs(q))).alias("bipower"),
        F.count(q).alias("pairs"),
        or_zero(F.avg(paired)).alias("mean_x"),
        or_zero(F.avg(q)).alias("mean_y"),
        or_zero(F.covar_pop(r, q) * F.count(q)).alias("comoment"),
        F.count(obi).alias("obi_n"),
        F.avg(obi).alias("obi_mean"),
        F.var_pop(obi).alias("obi_var"),
        F.sum(obi * obi).alias("obi_sq"),
        F.sum(F.abs(obi)).alias("obi_abs"),
    )


def _add_pair(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Add the return pair (x, y) to each row's pair moments where both exist."""
    present = x.isNotNull() & y.isNotNull()
    n, mx, my = F.col("pairs"), F.col("mean_x"), F.col("mean_y")

    def where_present(new: Column, old: str) -> Column:
        return F.when(present, new).otherwise(F.col(old))

    return df.withColumns(
        {
            "bipower": where_present(F.col("bipower") + F.abs(x) * F.abs(y), "bipower"),
            "comoment": where_present(
                F.col("comoment") + (x - mx) * (y - my) * n / (n + 1), "comoment"
            ),
            "mean_x": where_present(mx + (x - mx) / (n + 1), "mean_x"),
            "mean_y": where_present(my + (y - my) / (n + 1), "mean_y"),
            "pairs": where_present(n + 1, "pairs"),
        }
    )


def _merge_segments(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Supply what crosses the segment edges, then fold the segments of a day.

    All windows and the final aggregate are satisfied by one shuffle on the series; a
    series has one row per day here, or a few for a day that was cut.
    """
    series = Window.partitionBy(*by).orderBy("date", SEGMENT)
    day = Window.partitionBy(*by, "date")
    r0 = F.col("_r0")
    edged = segments.withColumn(
        "_r0", or_zero(log_ratio("first_close", F.lag("close").over(series)))
    ).withColumns(
        {
            "r2": F.col("r2") + r0 * r0,
            "r3": F.col("r3") + r0 * r0 * r0,
            "r4": F.col("r4") + r0 * r0 * r0 * r0,
            "illiq": F.col("illiq") + or_zero(F.abs(r0) / (F.col("first_volume") + EPS)),
            "_seam": F.lag(F.coalesce("final_r", r0)).over(day.orderBy(SEGMENT)),
        }
    )
    paired = _add_pair(_add_pair(edged, F.col("second_r"), r0), r0, F.col("_seam"))

    def day_mean(mean: str, weight: str) -> Column:
        return ratio(F.sum(F.col(mean) * F.col(weight)).over(day), F.sum(weight).over(day))

    centred = paired.withColumns(
        {
            "_mx": day_mean("mean_x", "pairs"),
            "_my": day_mean("mean_y", "pairs"),
            "_mo": day_mean("obi_mean", "obi_n"),
        }
    )
    comoment = F.sum(
        F.col("comoment")
        + F.col("pairs") * (F.col("mean_x") - F.col("_mx")) * (F.col("mean_y") - F.col("_my"))
    )
    obi_n = F.sum("obi_n")
    obi_spread = F.sum(
        F.col("obi_n") * (F.col("obi_var") + F.pow(F.col("obi_mean") - F.col("_mo"), F.lit(2.0)))
    )
    return centred.groupBy(*by, "date").agg(
        F.sum("n").alias("n"),
        F.min_by("open", SEGMENT).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", SEGMENT).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("r2").alias("r2"),
        F.sum("r3").alias("r3"),
        F.sum("r4").alias("r4"),
        F.sum("bipower").alias("bipower"),
        F.when(F.sum("n") > 2, comoment / F.greatest(F.sum("pairs") - 1, F.lit(1)))
        .otherwise(F.lit(0.0)).alias("autocov"),
        ratio(F.sum("illiq"), F.sum("illiq_n")).alias("illiq"),
        F.max("_mo").alias("obi_mean"),
        ratio(F.sum("obi_sq"), obi_n).alias("obi_sq"),
        F.when(obi_n > 0, F.sqrt(F.greatest(ratio(obi_spread, obi_n), F.lit(0.0)))).alias("obi_std"),
        ratio(F.sum("obi_abs"), obi_n).alias("obi_abs"),
    )


def realized_columns() -> list[Column]:
    """RV, bipower variation, jump and continuous parts, Parkinson and Garman-Klass."""
    rv = F.col("r2")
    bv = F.lit(math.pi / 2) * F.col("bipower")
    jump = F.greatest(rv - bv, F.lit(0.0))
    low, open_ = F.col("low"), F.col("open")
    return [
        rv.alias("RV"),
        bv.alias("BV"),
        jump.alias("J_t"),
        (rv - jump).alias("C_t"),
        F.when(low > 0, parkinson()).otherwise(0.0).alias("PK"),
        F.when((low > 0) & (open_ > 0), garman_klass()).otherwise(0.0).alias("GK"),
    ]


def micro_columns() -> list[Column]:
    """Imbalance moments, illiquidity, implied spread, realized skewness and kurtosis."""
    n, rv = F.col("n"), F.col("r2")
    return [
        F.col("obi_mean").alias("OBI_mean"),
        F.col("obi_sq").alias("OBI_sq"),
        F.col("obi_std").alias("OBI_std"),
        F.col("obi_abs").alias("OBI_abs"),
        (F.col("illiq") * 1e6).alias("ILLIQ"),
        (2 * F.sqrt(F.greatest(-F.col("autocov"), F.lit(0.0)))).alias("Roll"),
        (F.sqrt(n) * F.col("r3") / (F.pow(rv, F.lit(1.5)) + EPS)).alias("RS"),
        (n * F.col("r4") / (rv * rv + EPS)).alias("RK"),
    ]


def realized_daily(
    bars: DataFrame,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    ties: Sequence[str] = (),
    days_per_year: int = 365,
    segment_rows: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Daily realized measures with the heterogeneous-autoregressive lags.

    ``keep`` names further columns of ``daily_measures`` to hand through, like the close.
    """
    daily = daily_measures(bars, by, time, ties, segment_rows)
    return har_columns(daily.select(*by, "date", *keep, *realized_columns()), by, days_per_year)


def micro_daily(
    bars: DataFrame,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    ties: Sequence[str] = (),
    segment_rows: int | None = None,
) -> DataFrame:
    daily = daily_measures(bars, by, time, ties, segment_rows)
    return daily.select(*by, "date", *micro_columns())


def daily_features(
    bars: DataFrame,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    ties: Sequence[str] = (),
    days_per_year: int = 365,
    segment_rows: int | None = None,
) -> DataFrame:
    """Both families in one pass over the bars."""
    daily = daily_measures(bars, by, time, ties, segment_rows)
    return har_columns(
        daily.select(*by, "date", *realized_columns(), *micro_columns()), by, days_per_year
    )


def har_columns(
    daily: DataFrame, by: Sequence[str], days_per_year: int, zero_vol_is_null: bool = False
) -> DataFrame:
    """log_RV, its lag, its means over the previous 5 and 22 rows, and annual figures.

    The lags count rows, not calendar days, and a mean is NULL unless all its rows are
    there. One series has at most one row per calendar day, so the window is small.
    """
    series = Window.partitionBy(*by).orderBy("date")
    annual = F.col("RV") * days_per_year

    def full_mean(rows: int) -> Column:
        frame = series.rowsBetween(-rows, -1)
        return F.when(F.count("log_RV").over(frame) == rows, F.avg("log_RV").over(frame))

    return daily.withColumn("log_RV", F.ln(F.when(F.col("RV") > 0, F.col("RV")))).withColumns(
        {
            "RV_d": F.lag("log_RV").over(series),
            "RV_w": full_mean(5),
            "RV_m": full_mean(22),
            "RV_ann": annual,
            "vol_ann": F.sqrt(F.nullif(annual, F.lit(0.0)) if zero_vol_is_null else annual),
        }
    )


def daily_bar_realized(
    daily_bars: DataFrame, by: Sequence[str] = ("symbol",), days_per_year: int = 252
) -> DataFrame:
    """The form for assets with daily bars only: RV is the squared daily return.

    Takes ``log_ret`` as it is. The range estimators have no zero guard here; a price
    of zero gives NULL.
    """
    log_ret = F.col("log_ret")
    daily = daily_bars.select(
        *by, "date", parkinson().alias("PK"), garman_klass().alias("GK"), "log_ret",
        (log_ret * log_ret).alias("RV"),
    )
    return har_columns(daily, by, days_per_year, zero_vol_is_null=True)
