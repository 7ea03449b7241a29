"""Volatility-targeted positions, costs and strategy statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, ratio


def position_size(
    predicted_rv: Column | str, target_vol: float = 0.02, kelly_fraction: float = 0.25
) -> Column:
    """kelly_fraction * target_vol / sqrt(predicted RV); NULL unless that is positive."""
    rv = col(predicted_rv)
    return F.lit(kelly_fraction * target_vol) / F.when(rv > 0, F.sqrt(rv))


def net_returns(
    positions: DataFrame,
    by: Sequence[str] = ("symbol",),
    weight: str = "weight",
    ret: str = "ret",
    cost_bps: float = 5.0,
) -> DataFrame:
    """Yesterday's weight times today's return, less costs on the change of weight.

    A series starts from no position, and a missing weight is a closed one: closing
    costs, and the day's return on the position held until then counts.
    """
    held = F.coalesce(F.col(weight), F.lit(0.0))
    before = F.coalesce(F.lag(held).over(Window.partitionBy(*by).orderBy("date")), F.lit(0.0))
    return (
        positions.withColumn("_before", before)
        .withColumn("gross_ret", F.col("_before") * F.col(ret))
        .withColumn("cost", F.lit(cost_bps * 1e-4) * F.abs(held - F.col("_before")))
        .withColumn("net_ret", F.col("gross_ret") - F.col("cost"))
        .drop("_before")
    )


def strategy_summary(
    returns: DataFrame, by: Sequence[str] = ("symbol",), ret: str = "net_ret", days_per_year: int = 365
) -> DataFrame:
    mean, sd = F.avg(ret), F.stddev_samp(ret)
    return returns.groupBy(*by).agg(
        F.count(ret).alias("days"),
        mean.alias("mean_ret"),
        sd.alias("std_ret"),
        (ratio(mean, sd) * math.sqrt(days_per_year)).alias("sharpe"),
        ratio(F.count_if(F.col(ret) > 0), F.count(ret)).alias("hit_rate"),
    )
