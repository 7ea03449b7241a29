import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.checkers import close_to, phi, vpin_loop
from tidemark.functions.columns import norm_cdf
from tidemark.operators import vpin

SCHEMA = "symbol string, ts timestamp, tick_id bigint, price double, qty double"
TICK = {"time": "ts", "ties": ("tick_id",), "price": "price", "volume": "qty"}


def walk(seed, n, minutes, big=0.0):
    rng, t, p, out = random.Random(seed), datetime(2024, 1, 1), 100.0, []
    for _ in range(n):
        t += timedelta(minutes=rng.randrange(0, minutes))
        p += rng.choice((-1.0, 0.0, 0.5, 1.0))
        out.append((t, p, float(5000 if rng.random() < big else rng.randrange(0, 30))))
    return out


def frame(spark, series):
    rows = [(s, t, i, p, v) for s, part in series.items() for i, (t, p, v) in enumerate(part)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("segment_rows", [None, 50])
def test_against_plain_loop(spark, segment_rows):
    series = {
        "A": walk(1, 3000, 20),
        "jumps": walk(2, 2000, 20, big=0.01),  # rows above the bucket size: numbers skip
        "gap": walk(3, 1500, 10) + [(t + timedelta(days=40), p, v) for t, p, v in walk(4, 1500, 10)],
        "short": walk(5, 40, 10),
    }
    rows = vpin.vpin_daily(frame(spark, series), segment_rows=segment_rows, **TICK).collect()
    got = {(r["symbol"], r["date"]): r["VPIN"] for r in rows}
    want = {(s, d): v for s, part in series.items() for d, v in vpin_loop(part).items()}
    assert set(got) == set(want)
    for key in want:
        assert close_to(got[key], want[key], 1e-8), (key, got[key], want[key])
    assert all(v is None for (s, _), v in got.items() if s == "short")
    assert all(v is None or v >= 0 for v in got.values())
    assert any(v is None for (s, d), v in got.items() if s == "gap" and d.month == 2)


def test_given_bucket_size_in_blocks(spark):
    series = {"A": walk(7, 4000, 3), "B": walk(8, 900, 3)}
    buckets = vpin.volume_buckets(frame(spark, series), v_star=20.0, **TICK)
    whole = vpin.bucket_vpin(buckets)
    a = {(r["symbol"], r["bucket"]): r for r in whole.collect()}
    for blocks in (vpin.bucket_vpin(buckets, many=m, block_rows=320) for m in (False, True)):
        b = {(r["symbol"], r["bucket"]): r for r in blocks.collect()}
        assert set(a) == set(b) and len(a) == blocks.count() > 700
        for k in a:
            assert close_to(a[k]["VPIN"], b[k]["VPIN"]) and close_to(a[k]["sigma_dP"], b[k]["sigma_dP"])
    daily = {r["date"]: r["VPIN"] for r in vpin.vpin_daily(frame(spark, series), v_star=20.0, **TICK)
             .where("symbol = 'A'").collect()}
    for d, v in vpin_loop(series["A"], 20.0).items():
        assert close_to(daily[d], v, 1e-8)


def test_bucket_size_is_at_least_one_and_one_day_counts_as_one(spark):
    t = datetime(2024, 1, 1)
    rows = [("s", t + timedelta(minutes=i), i, 10.0, 1.0) for i in range(20)]
    sizes = vpin.volume_buckets(spark.createDataFrame(rows, SCHEMA), **TICK).select("V_star").distinct().collect()
    assert [r[0] for r in sizes] == [1.0]


def test_taker_side(spark):
    rows = [("s", datetime(2024, 1, 1, 0, i), i, 10.0, 4.0, i % 2 == 0) for i in range(4)]
    ticks = spark.createDataFrame(rows, SCHEMA + ", is_buyer_maker boolean")
    got = vpin.volume_buckets(ticks, v_star=100.0, **TICK).first()
    assert (got["V_total"], got["V_taker"]) == (16.0, 8.0)


def test_normal_distribution(spark):
    z = [x / 100 for x in range(-4000, 4001)]
    df = spark.createDataFrame([(x,) for x in z], "z double").select("z", norm_cdf("z").alias("p"))
    assert max(abs(r["p"] - phi(r["z"])) for r in df.collect()) < 1e-15
    assert spark.range(1).select(norm_cdf(F.lit(None).cast("double")).alias("p")).first()["p"] is None
