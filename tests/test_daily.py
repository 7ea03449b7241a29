import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.checkers import close_to, daily_loop, har_loop
from tidemark.operators import daily, vpin
from tidemark.plans import testdata

SCHEMA = "symbol string, open_time timestamp, open double, high double, low double, close double, volume double"
MEASURES = (
    "RV BV J_t C_t PK GK OBI_mean OBI_sq OBI_std OBI_abs ILLIQ Roll RS RK".split()
)


def bar(t, o, h, low, c, v):
    return {"t": t, "open": float(o), "high": float(h), "low": float(low), "close": float(c), "volume": float(v)}


def random_bars(seed, days=30, per_day=12):
    rng, price, out = random.Random(seed), 100.0, []
    for d in range(days):
        if d % 11 == 5:
            continue  # a day without bars
        for k in range(1 if d % 7 == 3 else per_day):
            o = price
            c = o * math.exp(rng.gauss(0, 0.02))
            h, low = max(o, c) * (1 + rng.random() / 50), min(o, c) * (1 - rng.random() / 50)
            if rng.random() < 0.05:
                h = low = c
            out.append(bar(datetime(2024, 1, 1) + timedelta(days=d, hours=k), o, h, low, c, float(rng.randrange(0, 50))))
            price = c
    return out


def frame(spark, series):
    rows = [
        (s, b["t"], b["open"], b["high"], b["low"], b["close"], b["volume"]) for s, bars in series.items() for b in bars
    ]
    return spark.createDataFrame(rows, SCHEMA)


def compare(df, series):
    got = {(r["symbol"], r["date"]): r for r in df.collect()}
    want = {(s, d): m for s, bars in series.items() for d, m in daily_loop(bars).items()}
    assert set(got) == set(want)
    for key, measures in want.items():
        for name in MEASURES:
            assert close_to(got[key][name], measures[name]), (key, name, got[key][name], measures[name])
    return got


@pytest.mark.parametrize("segment_rows", [None, 1_000_000, 5])
def test_against_plain_loop(spark, segment_rows):
    series = {"A": random_bars(1), "B": random_bars(2, days=45)}
    got = compare(daily.daily_features(frame(spark, series), segment_rows=segment_rows), series)
    for s in series:
        days = sorted(d for k, d in got if k == s)
        log_rv = [got[s, d]["log_RV"] for d in days]
        for d, lags in zip(days, har_loop(log_rv)):
            for name, want in zip(("RV_d", "RV_w", "RV_m"), lags):
                assert close_to(got[s, d][name], want)
            assert close_to(got[s, d]["RV_ann"], got[s, d]["RV"] * 365)
            assert close_to(got[s, d]["vol_ann"], math.sqrt(got[s, d]["RV"] * 365))


def test_edge_days(spark):
    t = datetime(2024, 3, 1)
    series = {
        "one": [bar(t, 10, 12, 9, 11, 5.0), bar(t + timedelta(days=1), 11, 11, 10, 10.5, 5.0)],
        "two": [bar(t, 10, 12, 9, 11, 5.0), bar(t + timedelta(hours=1), 11, 13, 10, 12, 0.0)],
        "flat": [bar(t + timedelta(hours=h), 7, 7, 7, 7, 3.0) for h in range(5)],
        "growth": [bar(t + timedelta(hours=h), 2.0**h, 2.0**h, 2.0**h, 2.0**h, 3.0) for h in range(6)],
    }
    got = compare(daily.daily_features(frame(spark, series)), series)
    day1, day2 = t.date(), t.date() + timedelta(days=1)
    one = got["one", day2]
    assert one["BV"] == one["Roll"] == one["OBI_std"] == one["C_t"] == 0
    assert one["J_t"] == one["RV"] == pytest.approx(math.log(10.5 / 11) ** 2)
    assert got["one", day1]["RV"] == 0
    assert got["two", day1]["Roll"] == 0
    flat = got["flat", day1]
    assert flat["RV"] == flat["RS"] == flat["RK"] == flat["vol_ann"] == 0
    assert flat["log_RV"] is None
    assert flat["OBI_mean"] == pytest.approx(-1)
    assert got["growth", day1]["Roll"] < 1e-7


def test_zero_price_gives_no_error(spark):
    t = datetime(2024, 3, 1)
    bars = [bar(t + timedelta(hours=h), p, p, p, p, 1.0) for h, p in enumerate((5.0, 0.0, 4.0))]
    row = daily.daily_features(frame(spark, {"z": bars})).first()
    assert (row["RV"], row["PK"], row["GK"]) == (0, 0, 0)


def test_null_close_counts_as_no_return(spark):
    t = datetime(2024, 3, 1)
    rows = [("n", t + timedelta(hours=h), p, p, p, p, 1.0) for h, p in enumerate((5.0, None, 4.0, 8.0))]
    row = daily.realized_daily(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["RV"] == pytest.approx(math.log(2) ** 2)


def test_cut_days_change_nothing(spark, sf_dir):
    trades = testdata.daily_ticks(spark, sf_dir)
    hot = trades.withColumn(
        "open_time",
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("1998-06-01").cast("timestamp")).otherwise(F.col("open_time")),
    )
    whole = daily.daily_features(hot, ties=testdata.DAILY_TICK_TIES)
    cut = daily.daily_features(hot, ties=testdata.DAILY_TICK_TIES, segment_rows=40)
    a = {(r["symbol"], r["date"]): r.asDict() for r in whole.collect()}
    b = {(r["symbol"], r["date"]): r.asDict() for r in cut.collect()}
    assert set(a) == set(b)
    for key in a:
        for name in (*MEASURES, "log_RV", "RV_m"):
            assert close_to(a[key][name], b[key][name], 1e-8), (key, name)


def test_invariants(spark, sf_dir):
    rows = daily.daily_features(testdata.hourly_bars(spark, sf_dir)).collect()
    for r in rows:
        assert r["J_t"] >= 0 and r["PK"] >= 0
        assert close_to(r["C_t"], min(r["RV"], r["BV"]), 1e-12)
        assert abs(r["OBI_mean"]) <= 1 and r["OBI_abs"] <= 1
    n = len({r["symbol"] for r in rows})
    assert [sum(r[c] is None for r in rows) for c in ("RV_d", "RV_w", "RV_m")] == [n, 5 * n, 22 * n]
    for name in ("RV", "BV", "J_t", "C_t", "PK", "GK", "RV_ann", "vol_ann", *MEASURES[6:]):
        assert all(r[name] is not None for r in rows)


def test_daily_bar_form(spark):
    rows = [
        ("e", datetime(2024, 1, d).date(), 10.0, 11.0, 9.0, c, lr)
        for d, c, lr in ((1, 10.0, None), (2, 10.0, 0.0), (3, 12.0, 0.18))
    ]
    schema = "symbol string, date date, open double, high double, low double, close double, log_ret double"
    got = daily.daily_bar_realized(spark.createDataFrame(rows, schema)).orderBy("date").collect()
    assert [r["RV"] for r in got] == [None, 0.0, pytest.approx(0.0324)]
    assert got[1]["vol_ann"] is None and got[1]["log_RV"] is None
    assert got[2]["vol_ann"] == pytest.approx(math.sqrt(0.0324 * 252))
    assert got[2]["PK"] == pytest.approx(math.log(11 / 9) ** 2 / (4 * math.log(2)))


def test_empty_input_gives_typed_empty_output(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for segment_rows in (None, 100):
        features = daily.daily_features(empty, segment_rows=segment_rows)
        assert features.count() == 0 and dict(features.dtypes)["RV"] == "double"
        scores = vpin.vpin_daily(empty, segment_rows=segment_rows)
        assert scores.count() == 0 and scores.dtypes == [("symbol", "string"), ("date", "date"), ("VPIN", "double")]
