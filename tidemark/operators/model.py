"""Linear volatility forecasts from the heterogeneous-autoregressive lags.

All frames here have one row per (series, day), so the windows and groups by series are
bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

TARGET = "log_RV"
LAGS = ("RV_d", "RV_w", "RV_m")


def _det(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _fit_terms(
    fold: Callable[[Column], Column], train_until: str | None
) -> tuple[dict[str, Column], dict[str, Column]]:
    """The moments of the complete rows, and the coefficients in terms of those.

    ``fold`` makes an aggregate what the caller needs: a group's or a window's. Centred
    moments merge exactly across partitions; the 3 x 3 normal equations are solved by
    Cramer's rule as plain columns, and a singular system gives NULL.
    """
    names = (*LAGS, TARGET)
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    if train_until:
        complete = complete & (F.col("date") <= F.lit(train_until).cast("date"))
    x = {c: F.when(complete, F.col(c)) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = {"n": fold(F.count(x[TARGET]))}
    moments |= {f"_mean_{c}": fold(F.avg(x[c])) for c in names}
    moments |= {f"_cov_{a}_{b}": fold(F.covar_pop(x[a], x[b])) for a, b in pairs}

    def cov(a: str, b: str) -> Column:
        return F.col(f"_cov_{a}_{b}" if (a, b) in pairs else f"_cov_{b}_{a}")

    return moments, _solved({c: F.col(f"_mean_{c}") for c in names}, cov)


def _solved(mean: dict[str, Column], cov: Callable[[str, str], Column]) -> dict[str, Column]:
    """Coefficients and r2 from means and covariances; the intercept builds on the slopes' columns."""
    system = [[cov(a, b) for b in LAGS] for a in LAGS]
    right = [cov(a, TARGET) for a in LAGS]
    slopes = {}
    for j, lag in enumerate(LAGS):
        swapped = [[right[i] if k == j else system[i][k] for k in range(3)] for i in range(3)]
        slopes[f"b_{lag}"] = ratio(_det(swapped), _det(system))
    intercept, explained = mean[TARGET], F.lit(0.0)
    for lag in LAGS:
        intercept = intercept - F.col(f"b_{lag}") * mean[lag]
        explained = explained + F.col(f"b_{lag}") * cov(lag, TARGET)
    return {**slopes, "b_0": intercept, "r2": ratio(explained, cov(TARGET, TARGET))}


COEFFICIENTS = ("n", "b_0", *[f"b_{lag}" for lag in LAGS], "r2")


def _with_coefficients(df: DataFrame, coefficients: dict[str, Column]) -> DataFrame:
    slopes = {k: v for k, v in coefficients.items() if k not in ("b_0", "r2")}
    return df.withColumns(slopes).withColumns({k: coefficients[k] for k in ("b_0", "r2")})


def _predicted(df: DataFrame) -> DataFrame:
    log_rv = F.col("b_0")
    for lag in LAGS:
        log_rv = log_rv + F.col(f"b_{lag}") * F.col(lag)
    return df.withColumn("pred_log_RV", log_rv).withColumns(
        {"pred_RV": F.exp("pred_log_RV"), "resid": F.col(TARGET) - F.col("pred_log_RV")}
    )


def har_fit(
    daily: DataFrame, by: Sequence[str] = ("symbol",), train_until: str | None = None
) -> DataFrame:
    """Least squares of log_RV on a constant and the three lags, one row per series.

    ``train_until`` (a day, inclusive) keeps later rows out of the fit.
    """
    moments, coefficients = _fit_terms(lambda c: c, train_until)
    grouped = daily.groupBy(*by).agg(*[c.alias(name) for name, c in moments.items()])
    return _with_coefficients(grouped, coefficients).select(*by, *COEFFICIENTS)


def har_forecast(
    daily: DataFrame, by: Sequence[str] = ("symbol",), train_until: str | None = None
) -> DataFrame:
    """Predicted log_RV and RV of each day from the lags known before it, and the residual.

    The fit is a window aggregate over the series. The rows already lie together from
    making the lags, so this adds neither a second pass over the data nor a join.
    """
    series = Window.partitionBy(*by)
    moments, coefficients = _fit_terms(lambda c: c.over(series), train_until)
    fitted = _with_coefficients(daily.withColumns(moments), coefficients)
    return _predicted(fitted).drop(*moments, *COEFFICIENTS)


def har_forecast_rolling(
    daily: DataFrame, by: Sequence[str] = ("symbol",), rows: int | None = None, min_fit: int = 60
) -> DataFrame:
    """Each day's forecast from a fit on the days before it only, with ``n`` and the coefficients.

    rows     how many of the series' rows before the day are fitted; None: all
    min_fit  complete rows that a fit needs; with fewer there is no forecast

    Moments are running sums over the series, so a fit costs a row the same whatever its
    window: a window is the difference of the sums at its two ends, and each row solves its
    own 3 x 3 system. Values enter as differences from the series' first complete row, which
    keeps the sums small and changes no coefficient.
    """
    names = (*LAGS, TARGET)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    line = Window.partitionBy(*by).orderBy("date")
    so_far = line.rowsBetween(Window.unboundedPreceding, -1)
    until_now = line.rowsBetween(Window.unboundedPreceding, 0)
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    first = F.first(F.when(complete, F.struct(*names)), ignorenulls=True).over(until_now)
    apart = daily.withColumn("_first", first).withColumns(
        {f"_x_{c}": F.when(complete, F.col(c) - F.col("_first")[c]) for c in names}
    )
    x = {c: F.col(f"_x_{c}") for c in names}
    terms = {"n": F.when(complete, F.lit(1)), **{f"_s_{c}": x[c] for c in names}}
    terms |= {f"_s_{a}_{b}": x[a] * x[b] for a, b in pairs}
    summed = apart.withColumns({k: F.coalesce(F.sum(e).over(so_far), F.lit(0)) for k, e in terms.items()})
    if rows is not None:
        summed = summed.withColumns({k: F.col(k) - F.lag(k, rows, 0).over(line) for k in terms})
    n = F.when(F.col("n") >= min_fit, F.col("n"))
    moments = {f"_m_{c}": F.col(f"_s_{c}") / n for c in names}
    centred = summed.withColumns(moments).withColumns(
        {f"_c_{a}_{b}": F.col(f"_s_{a}_{b}") / n - F.col(f"_m_{a}") * F.col(f"_m_{b}") for a, b in pairs}
    )

    def cov(a: str, b: str) -> Column:
        return F.col(f"_c_{a}_{b}" if (a, b) in pairs else f"_c_{b}_{a}")

    mean = {c: F.col(f"_m_{c}") + F.col("_first")[c] for c in names}
    fitted = _predicted(_with_coefficients(centred, _solved(mean, cov)))
    return fitted.select(*daily.columns, *COEFFICIENTS, "pred_log_RV", "pred_RV", "resid")


def apply_fit(daily: DataFrame, fit: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """The same from coefficients that were fitted and stored before, such as on other days."""
    return _predicted(daily.join(fit.select(*by, *COEFFICIENTS), list(by), "left")).drop(*COEFFICIENTS)


def forecast_quantiles(
    forecasts: DataFrame,
    by: Sequence[str] = ("symbol",),
    probabilities: Sequence[float] = (0.1, 0.5, 0.9),
) -> DataFrame:
    """Forecast plus the series' residual percentiles: ``q10``, ``q50``, ``q90`` by default."""
    series = Window.partitionBy(*by)
    bands = {
        f"q{round(p * 100):02d}": F.col("pred_log_RV") + F.percentile("resid", F.lit(p)).over(series)
        for p in probabilities
    }
    return forecasts.withColumns(bands).where(F.col("pred_log_RV").isNotNull())


# Size of a quantile sketch. Ranks are off by 1.33 / 200^0.9 of all rows or so, about 1.1 %, at most twice that in practice.
SKETCH_SIZE = 200


def residual_sketches(forecasts: DataFrame, by: Sequence[str] = ("symbol",), size: int = SKETCH_SIZE) -> DataFrame:
    """Per (series, month) a mergeable quantile sketch of the residuals, of bounded size."""
    month = F.to_date(F.date_trunc("month", "date")).alias("month")
    known = forecasts.where(F.col("resid").isNotNull())
    return known.groupBy(*by, month).agg(F.kll_sketch_agg_double("resid", F.lit(size)).alias("resids"))


def sketched_quantiles(
    forecasts: DataFrame,
    sketches: DataFrame,
    by: Sequence[str] = ("symbol",),
    probabilities: Sequence[float] = (0.1, 0.5, 0.9),
) -> DataFrame:
    """``forecast_quantiles`` from stored sketches: months merge to any span, and no window holds all residuals.

    A quantile is a residual whose rank is nearest, not a value between two; ranks are
    accurate to the sketch's error.
    """
    merged = sketches.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.kll_merge_agg_double("resids").alias("_all"))
    at = [F.kll_sketch_get_quantile_double("_all", F.lit(float(p))).alias(f"_q{round(p * 100):02d}") for p in probabilities]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    joined = forecasts.where(F.col("pred_log_RV").isNotNull()).join(merged.select(*[f"_by_{c}" for c in by], *at), same)
    bands = {f"q{round(p * 100):02d}": F.col("pred_log_RV") + F.col(f"_q{round(p * 100):02d}") for p in probabilities}
    return joined.withColumns(bands).select(*forecasts.columns, *bands)


def stress_regime(
    index: DataFrame, by: Sequence[str] = ("series",), value: str = "value", rows: int = 252
) -> DataFrame:
    """High where the index exceeds its mean over the ``rows`` rows before, else Low."""
    before = Window.partitionBy(*by).orderBy("date").rowsBetween(-rows, -1)
    trailing = F.avg(value).over(before)
    regime = F.when(F.col(value) > F.col("trailing_mean"), "High").when(
        F.col(value) <= F.col("trailing_mean"), "Low"
    )
    return index.withColumn("trailing_mean", trailing).withColumn("regime", regime)


def variance_risk_premium(realized: DataFrame, implied: DataFrame) -> DataFrame:
    """Implied minus realized annual variance on days that have both."""
    both = realized.join(implied.select("date", "dvol_close"), "date")
    return both.withColumn("vrp", F.pow(F.col("dvol_close") / 100, F.lit(2.0)) - F.col("RV_ann"))
