"""Forecast comparison: loss functions, Diebold-Mariano test, model confidence set.

Losses come one row per (series, model, day), so a series is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, norm_cdf, ratio, safe_ln


def squared_error(actual: Column | str, predicted: Column | str) -> Column:
    e = col(actual) - col(predicted)
    return e * e


def qlike(actual: Column | str, predicted: Column | str) -> Column:
    """a/f - ln(a/f) - 1 on variances; NULL where one of them is not positive."""
    q = ratio(actual, predicted)
    return q - safe_ln(q) - 1


def diebold_mariano(
    pairs: DataFrame,
    loss1: Column | str,
    loss2: Column | str,
    by: Sequence[str] = ("symbol",),
    horizon: int = 1,
) -> DataFrame:
    """Test of equal accuracy per series; a negative statistic favours the first forecast.

    The long-run variance takes the autocovariances up to ``horizon - 1``. Days that lack
    either loss are left out.
    """
    series = Window.partitionBy(*by)
    ordered = series.orderBy("date")
    diff = pairs.select(*by, "date", (col(loss1) - col(loss2)).alias("_d")).where(F.col("_d").isNotNull())
    centred = diff.withColumn("_e", F.col("_d") - F.avg("_d").over(series))
    lagged = centred.withColumns({f"_e{k}": F.lag("_e", k).over(ordered) for k in range(1, horizon)})
    n = F.count(F.lit(1))
    spectrum = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, horizon):
        spectrum = spectrum + 2 * F.coalesce(F.sum(F.col("_e") * F.col(f"_e{k}")), F.lit(0.0))
    variance = spectrum / n / n
    stats = lagged.groupBy(*by).agg(
        n.alias("n"),
        F.avg("_d").alias("mean_diff"),
        ratio(F.avg("_d"), F.sqrt(F.when(variance > 0, variance))).alias("dm_stat"),
    )
    return stats.withColumn("p_value", 2 * norm_cdf(-F.abs("dm_stat")))


def bootstrap_means(
    losses: DataFrame, by: Sequence[str], replicates: int, block: int, seed: int
) -> DataFrame:
    """Each model's mean loss and ``boot``, its means under a circular block bootstrap.

    All models of a series see the same blocks of days. A block's start comes from a
    digest of (seed, series, replicate, block number), so a recomputed task, or another
    program, draws the same. The sums of the blocks that start on each day are windows;
    a model's sums are then gathered into one row. That is one value per calendar day, so
    the array is bounded, and the draws need neither a join nor a shuffle of their own.
    ``block`` must not exceed the number of days.
    """
    by = list(by)
    line = Window.partitionBy(*by, "model")
    numbered = losses.withColumns(
        {"_at": F.row_number().over(line.orderBy("date")) - 1, "_n": F.count(F.lit(1)).over(line)}
    )
    # The first rows appear again after the last ones: blocks wrap around.
    places = F.array(F.col("_at").cast("bigint"), F.col("_at") + F.col("_n"))
    ring = numbered.withColumn(
        "_at", F.explode(F.filter(places, lambda at: at < F.col("_n") + block - 1))
    )
    ahead = line.orderBy("_at").rowsBetween(0, block - 1)
    lines = (
        ring.withColumn("_sum", F.sum("loss").over(ahead))
        .where(F.col("_at") < F.col("_n"))
        .groupBy(*by, "model")
        .agg(
            F.avg("loss").alias("mean_loss"),
            F.transform(
                F.sort_array(F.collect_list(F.struct("_at", "_sum"))), lambda x: x["_sum"]
            ).alias("_sums"),
        )
    )
    n = F.size("_sums")
    blocks = F.ceil(n / block).cast("int")

    def replicate_mean(r: Column) -> Column:
        def drawn(b: Column) -> Column:
            text = F.concat_ws("|", F.lit(str(seed)), *by, r.cast("string"), b.cast("string"))
            number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")
            return F.get("_sums", (number % n).cast("int"))

        numbers = F.sequence(F.lit(0), blocks - 1)
        return F.aggregate(numbers, F.lit(0.0), lambda total, b: total + drawn(b)) / (blocks * block)

    boot = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), replicate_mean)
    return lines.select(*by, "model", "mean_loss", boot.alias("boot"))


def model_confidence_set(
    losses: DataFrame,
    by: Sequence[str] = ("symbol",),
    alpha: float = 0.05,
    replicates: int = 500,
    block: int = 10,
    seed: int = 1,
) -> DataFrame:
    """The T-max confidence set of Hansen, Lunde and Nason per series.

    ``losses`` has (series, model, date, loss); days on which a model lacks a loss are
    left out for all. Only the elimination runs in Python, on one replicates x models
    table per series, whose size the parameters fix.
    """
    by = list(by)
    whole = Window.partitionBy(*by)
    aligned = (
        losses.where(F.col("loss").isNotNull()).select(*by, "model", "date", "loss")
        .withColumns(
            {
                "_models": F.size(F.collect_set("model").over(whole)),
                "_here": F.count(F.lit(1)).over(Window.partitionBy(*by, "date")),
            }
        )
        .where(F.col("_here") == F.col("_models"))
    )
    boot = bootstrap_means(aligned, by, replicates, block, seed)

    # Nested, so that the workers need not have this package installed.
    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("model")
        names, mean, boot = list(rows["model"]), rows["mean_loss"].to_numpy(), np.stack(rows["boot"])
        left, out, p_so_far = list(range(len(names))), [], 0.0
        while len(left) > 1:
            gap = mean[left] - mean[left].mean()
            noise = boot[left] - mean[left][:, None]
            noise = noise - noise.mean(axis=0)
            sd = np.sqrt((noise**2).mean(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(sd > 0, gap / sd, np.where(gap == 0, 0.0, np.sign(gap) * np.inf))
                t_boot = np.where(sd[:, None] > 0, noise / sd[:, None], 0.0)
            p_so_far = max(p_so_far, float((t_boot.max(axis=0) >= t.max()).mean()))
            worst = left.pop(int(t.argmax()))
            out.append((names[worst], mean[worst], p_so_far))
        out.append((names[left[0]], mean[left[0]], 1.0))
        result = pd.DataFrame(out, columns=["model", "mean_loss", "p_value"])
        result = result.assign(eliminated=range(1, len(out) + 1), in_set=result["p_value"] >= alpha)
        return pd.concat([pd.DataFrame({c: [k] * len(out) for c, k in zip(by, keys)}), result], axis=1)

    types = {f.name: f.dataType.simpleString() for f in losses.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in by)
    schema += ", model string, mean_loss double, p_value double, eliminated bigint, in_set boolean"
    return boot.groupBy(*by).applyInPandas(run, schema)
