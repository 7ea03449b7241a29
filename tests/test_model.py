import hashlib
import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tests.checkers import close_to, phi
from tidemark.operators import evaluate, model, sizing

LAGS = list(model.LAGS)


def day(i):
    return date(2020, 1, 1) + timedelta(days=i)


@pytest.fixture(scope="module")
def daily(spark):
    rng, rows = random.Random(5), []
    for s in ("a", "b"):
        for i in range(120):
            x = [rng.gauss(-8, 1) for _ in range(3)]
            y = 0.3 + 0.5 * x[0] + 0.2 * x[1] - 0.1 * x[2] + rng.gauss(0, 0.3)
            holes = i in (3, 50)
            rows.append((s, day(i), None if holes else y, *(None if i < 2 else v for v in x)))
    return spark.createDataFrame(rows, "symbol string, date date, log_RV double, RV_d double, RV_w double, RV_m double").cache()


def test_fit_equals_least_squares(daily):
    fits = {r["symbol"]: r for r in model.har_fit(daily).collect()}
    for s in ("a", "b"):
        rows = [r for r in daily.where(F.col("symbol") == s).collect() if None not in tuple(r)]
        x = np.array([[1.0] + [r[c] for c in LAGS] for r in rows])
        y = np.array([r["log_RV"] for r in rows])
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        fit = fits[s]
        assert fit["n"] == len(rows) == 116
        assert np.allclose([fit["b_0"]] + [fit[f"b_{c}"] for c in LAGS], beta, rtol=1e-8)
        resid = y - x @ beta
        assert fit["r2"] == pytest.approx(1 - resid @ resid / ((y - y.mean()) @ (y - y.mean())))


def test_fit_equals_spark_ml(daily):
    one = daily.where("symbol = 'a'").dropna()
    ml = LinearRegression(featuresCol="x", labelCol="log_RV", solver="normal").fit(
        VectorAssembler(inputCols=LAGS, outputCol="x").transform(one)
    )
    fit = model.har_fit(one).first()
    assert np.allclose([fit[f"b_{c}"] for c in LAGS], ml.coefficients.toArray(), rtol=1e-6)
    assert fit["b_0"] == pytest.approx(ml.intercept, rel=1e-6)


def test_forecast_forms_agree(daily):
    cutoff = day(80).isoformat()
    direct = model.har_forecast(daily, train_until=cutoff)
    applied = model.apply_fit(daily, model.har_fit(daily, train_until=cutoff))
    assert direct.columns == applied.columns
    a = {(r["symbol"], r["date"]): r["pred_log_RV"] for r in direct.collect()}
    b = {(r["symbol"], r["date"]): r["pred_log_RV"] for r in applied.collect()}
    assert set(a) == set(b) and all(close_to(a[k], b[k]) for k in a)
    assert a["a", day(1)] is None and a["a", day(50)] is not None


def test_singular_fit_is_null(spark):
    rows = [("s", day(i), float(i), 1.0, 1.0, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "symbol string, date date, log_RV double, RV_d double, RV_w double, RV_m double")
    assert model.har_fit(df).first()["b_RV_d"] is None


def test_quantiles(daily):
    f = model.har_forecast(daily)
    got = model.forecast_quantiles(f).where("symbol = 'a'").orderBy("date").first()
    resid = [r["resid"] for r in f.where("symbol = 'a' and resid is not null").collect()]
    for q in (10, 50, 90):
        assert got[f"q{q}"] == pytest.approx(got["pred_log_RV"] + np.percentile(resid, q))


@pytest.mark.parametrize("horizon", [1, 3])
def test_diebold_mariano(spark, horizon):
    rng = random.Random(9)
    rows = [("s", day(i), rng.random(), rng.random() + 0.05) for i in range(60)] + [("s", day(99), None, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, l1 double, l2 double")
    got = evaluate.diebold_mariano(df, "l1", "l2", horizon=horizon).first()
    d = [a - b for _, _, a, b in rows if a is not None]
    n, m = len(d), sum(d) / len(d)
    e = [x - m for x in d]
    gamma = [sum(e[t] * e[t - k] for t in range(k, n)) / n for k in range(horizon)]
    stat = m / math.sqrt((gamma[0] + 2 * sum(gamma[1:])) / n)
    assert got["n"] == n and got["dm_stat"] == pytest.approx(stat)
    assert got["p_value"] == pytest.approx(2 * (1 - phi(abs(stat))))


def test_losses(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (1.0, 0.0)], "a double, f double")
    got = df.select(evaluate.qlike("a", "f").alias("q"), evaluate.squared_error("a", "f").alias("s")).collect()
    assert [r["q"] for r in got] == [pytest.approx(2 - math.log(2) - 1), None, None]
    assert [r["s"] for r in got] == [1.0, 1.0, 1.0]


def test_confidence_set(spark):
    """Against a loop over the same draws; the bad model leaves, equal ones stay."""
    rng, n, block, reps = random.Random(3), 90, 7, 60
    noise = [rng.gauss(1, 0.3) for _ in range(n)]
    table = {
        "good": noise,
        "same": [x + rng.gauss(0, 0.1) for x in noise],
        "worse": [x + 1 + rng.gauss(0, 0.1) for x in noise],
    }
    rows = [("s", m, day(i), x) for m, part in table.items() for i, x in enumerate(part)]
    rows.append(("s", "good", day(n), 1.0))  # a day the others lack
    losses = spark.createDataFrame(rows, "symbol string, model string, date date, loss double")
    got = {r["model"]: r for r in evaluate.model_confidence_set(losses, replicates=reps, block=block, seed=4).collect()}

    blocks = -(-n // block)
    starts = [
        (r, int(hashlib.md5(f"4|s|{r}|{b}".encode()).hexdigest()[:12], 16) % n)
        for r in range(reps) for b in range(blocks)
    ]
    means = {m: sum(x) / n for m, x in table.items()}
    boot = {m: [0.0] * reps for m in table}
    for r, at in starts:
        for m, x in table.items():
            boot[m][r] += sum(x[(at + j) % n] for j in range(block)) / (blocks * block)
    left, p, order = sorted(table), 0.0, []
    while len(left) > 1:
        level = sum(means[m] for m in left) / len(left)
        noise = {m: [boot[m][r] - means[m] for r in range(reps)] for m in left}
        centre = [sum(noise[m][r] for m in left) / len(left) for r in range(reps)]
        zeta = {m: [noise[m][r] - centre[r] for r in range(reps)] for m in left}
        sd = {m: math.sqrt(sum(z * z for z in zeta[m]) / reps) for m in left}
        t = {m: (means[m] - level) / sd[m] for m in left}
        top = max(t.values())
        p = max(p, sum(max(zeta[m][r] / sd[m] for m in left) >= top for r in range(reps)) / reps)
        worst = max(left, key=lambda m: t[m])
        order.append((worst, p))
        left.remove(worst)
    order.append((left[0], 1.0))
    assert [(m, pytest.approx(got[m]["p_value"])) for m, _ in order] == [(m, p) for m, p in order]
    assert [got[m]["eliminated"] for m, _ in order] == [1, 2, 3]
    assert not got["worse"]["in_set"] and got[left[0]]["in_set"]


def test_sizing_and_costs(spark):
    rows = [("s", day(0), 0.04, 0.1), ("s", day(1), 0.0, 0.2), ("s", day(2), 0.01, -0.1)]
    df = spark.createDataFrame(rows, "symbol string, date date, pred double, ret double")
    sized = df.withColumn("weight", sizing.position_size("pred"))
    assert [r["weight"] for r in sized.orderBy("date").collect()] == [pytest.approx(0.025), None, pytest.approx(0.05)]
    flat = sized.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    got = sizing.net_returns(flat, cost_bps=10).orderBy("date").collect()
    assert [r["net_ret"] for r in got] == [
        pytest.approx(-0.025 * 1e-3), pytest.approx(0.025 * 0.2 - 0.025 * 1e-3), pytest.approx(-0.05 * 1e-3)
    ]
    summary = sizing.strategy_summary(sizing.net_returns(flat, cost_bps=10)).first()
    x = np.array([r["net_ret"] for r in got])
    assert summary["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(365))
    assert summary["hit_rate"] == pytest.approx(1 / 3) and summary["days"] == 3


def test_stress_regime_and_premium(spark):
    index = spark.createDataFrame([("v", day(i), float(x)) for i, x in enumerate((10, 12, 11, 5))], "series string, date date, value double")
    got = model.stress_regime(index, rows=2).orderBy("date").collect()
    assert [r["regime"] for r in got] == [None, "High", "Low", "Low"]
    rv = spark.createDataFrame([("s", day(0), 0.2), ("s", day(1), 0.2)], "symbol string, date date, RV_ann double")
    iv = spark.createDataFrame([(day(0), 50.0)], "date date, dvol_close double")
    assert [r["vrp"] for r in model.variance_risk_premium(rv, iv).collect()] == [pytest.approx(0.05)]
