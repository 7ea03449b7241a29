"""As-of scans, the sampled book, refits and lexicon tables against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.checkers import close_to
from tidemark.operators import asof, depth, model, news

T = datetime(2024, 1, 1)
ROWS = "symbol string, ts timestamp, id bigint, a double, b string"


def _ticks(seed, n, symbols=("x", "y", None)):
    """Times with many ties, over days, in any order; two in three values missing."""
    rng = random.Random(seed)
    rows = [
        (rng.choice(symbols), T + timedelta(minutes=30 * rng.randrange(200)), i, rng.choice([None, None, float(i)]), rng.choice([None, None, f"v{i}"]))
        for i in range(n)
    ]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment_rows", [None, 5, 10**6])
def test_last_known_equals_loop(spark, segment_rows):
    rows = _ticks(1, 200)
    frame = spark.createDataFrame([*rows, ("x", None, -1, 1.0, "no time")], ROWS).repartition(7, "id")
    for age in (None, "90 minutes"):
        got = asof.last_known(frame, ["a", "b"], ties=["id"], max_age=age, segment_rows=segment_rows)
        assert got.columns == frame.columns
        want, seen = {}, {}
        for s, t, i, a, b in sorted(rows, key=lambda r: (r[1], r[2])):
            for c, v in (("a", a), ("b", b)):
                if v is not None:
                    seen[s, c] = (t, v)
            young = lambda c: seen[s, c][1] if (s, c) in seen and (age is None or t - seen[s, c][0] <= timedelta(minutes=90)) else None  # noqa: B023, E731
            want[i] = (young("a"), young("b"))
        assert {r["id"]: (r["a"], r["b"]) for r in got.collect()} == want


@pytest.mark.parametrize("same_time", [True, False])
@pytest.mark.parametrize("segment_rows", [None, 7])
def test_asof_equals_loop(spark, segment_rows, same_time):
    left, right = _ticks(2, 80), _ticks(3, 120)
    frames = [spark.createDataFrame(rows, ROWS) for rows in (left, right)]
    got = asof.asof_match(
        frames[0].withColumnRenamed("a", "own"), frames[1], ["a", "id"], right_ties=["id"], max_age="5 hours",
        same_time=same_time, segment_rows=segment_rows,
    )
    assert got.columns == ["symbol", "ts", "id", "own", "b", "asof_ts", "asof_a", "asof_id"]
    want = {}
    for s, t, i, a, _ in left:
        before = [r for r in right if r[0] == s and (r[1] < t or (same_time and r[1] == t))]
        best = max(before, key=lambda r: (r[1], r[2]), default=None)
        best = best if best and t - best[1] <= timedelta(hours=5) else None
        want[i] = (a, best and best[1], best and best[3], best and best[2])
    assert {r["id"]: (r["own"], r["asof_ts"], r["asof_a"], r["asof_id"]) for r in got.collect()} == want
    assert asof.asof_match(frames[0], frames[1].limit(0), ["a"]).where("asof_ts is not null").count() == 0
    assert asof.asof_match(frames[0].limit(0), frames[1], ["a"]).count() == 0


def test_asof_shuffles_once_and_broadcasts_nothing(spark, capsys):
    frames = [spark.createDataFrame(_ticks(k, 50), ROWS) for k in (4, 5)]
    asof.asof_match(*frames, ["a"], right_ties=["id"], segment_rows=None).explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and "Join" not in plan


def test_sampled_book_equals_loop(spark):
    rng = random.Random(6)
    updates = [
        (rng.choice("xy"), T + timedelta(minutes=10 * rng.randrange(300)), i, rng.choice(["bid", "ask"]), float(rng.randrange(8)), float(rng.choice([0, 0, 1, 2, 3])))
        for i in range(300)
    ]
    schema = "symbol string, ts timestamp, id bigint, side string, price double, quantity double"
    odd = [("x", None, 900, "bid", 1.0, 9.0), ("x", T, 901, None, 1.0, 9.0), ("x", T, 902, "bid", None, 9.0), ("x", T, 903, "bid", 1.0, None)]
    frame = spark.createDataFrame([*updates, *odd], schema).repartition(5, "id")
    got = depth.book_from_updates(frame, "1 hour", 2, ties=["id"])
    newest = max(u[1] for u in updates)
    want, at = set(), T
    while at < newest + timedelta(hours=1):
        book = {}
        for s, t, i, side, price, quantity in sorted(updates, key=lambda u: (u[1], u[2])):
            if t <= at:
                book[s, side, price] = quantity
        for s in "xy":
            for side in ("bid", "ask"):
                live = sorted((p for (s2, side2, p), q in book.items() if (s2, side2) == (s, side) and q > 0), reverse=side == "bid")
                want |= {(s, at, side, k, p, book[s, side, p]) for k, p in enumerate(live[:2])}
        at += timedelta(hours=1)
    assert {tuple(r) for r in got.collect()} == want
    summary = depth.book_summary(got).where("symbol = 'x'").orderBy("timestamp").first()
    first = min(t for s, t, *_ in want if s == "x")
    bids = [q for s, t, side, _, _, q in want if (s, t, side) == ("x", first, "bid")]
    assert summary["timestamp"] == first and summary["bid_qty"] == sum(bids)
    assert depth.book_from_updates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [None, 40])
def test_rolling_fit_equals_refits(spark, rows):
    rng = np.random.default_rng(7)
    days = []
    for s in ("x", "y"):
        x = rng.normal(-9, 1, (90, 3))
        y = 0.5 + x @ [0.3, 0.2, 0.4] + rng.normal(0, 0.3, 90)
        for i in range(90):
            lags = [None if rng.random() < 0.05 else float(v) for v in x[i]]
            days.append((s, (T + timedelta(days=i)).date(), None if i % 17 == 5 else float(y[i]), *lags))
    frame = spark.createDataFrame(days, "symbol string, date date, log_RV double, RV_d double, RV_w double, RV_m double")
    got = {(r["symbol"], r["date"]): r for r in model.har_forecast_rolling(frame, rows=rows, min_fit=20).collect()}
    assert len(got) == len(days)
    forecasts = 0
    for s in ("x", "y"):
        mine = [d for d in days if d[0] == s]
        for i, d in enumerate(mine):
            fit = [r for r in mine[max(0, i - rows) if rows else 0 : i] if None not in r[2:]]
            row = got[s, d[1]]
            assert row["n"] == (len(fit) if len(fit) >= 20 else row["n"])
            if len(fit) < 20:
                assert row["pred_log_RV"] is None and row["b_0"] is None
                continue
            beta = np.linalg.lstsq(np.array([[1, *r[3:]] for r in fit]), np.array([r[2] for r in fit]), rcond=None)[0]
            assert close_to(row["b_0"], beta[0], 1e-6) and close_to(row["b_RV_w"], beta[2], 1e-6)
            if None not in d[3:]:
                forecasts += 1
                assert close_to(row["pred_log_RV"], beta @ [1, *d[3:]], 1e-8)
    assert forecasts > 80
    assert model.har_forecast_rolling(frame.limit(0)).count() == 0


def test_large_lexicon_table_both_ways(spark, monkeypatch):
    """50,000 words, sent to tasks and met by a shuffle."""
    words = spark.range(50_000).select(
        F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"),
        (F.col("id") % 3 - 1).cast("int").alias("weight"),
    )
    lexicon = words.unionByName(spark.createDataFrame([(None, 1), ("wb", None), ("wb", -5)], news.LEXICON))
    docs = spark.createDataFrame(
        [(1, "Wc wc, wb wa wd! wzz"), (2, None), (3, ""), (None, "wjjjj we"), (4, "wf wf")], "doc_id bigint, text string"
    ).withColumn("word", F.lit("clash"))
    want = {1: (2, 1), 2: (0, 0), 3: (0, 0), None: (1, 0), 4: (2, 0)}
    for limit in (1 << 24, 0):
        monkeypatch.setattr(news, "BROADCAST_LEXICON", limit)
        got = news.with_lexicon(docs, lexicon).collect()
        hits = {r["doc_id"]: (r["pos"], r["neg"]) for r in got}
        assert hits[1][0] == 2 and {k: hits[k] for k in (2, 3)} == {k: want[k] for k in (2, 3)} and len(got) == 5
        weight = lambda w: int(w.translate(str.maketrans("abcdefghij", "0123456789"))) % 3 - 1
        for r in docs.collect():
            ws = [w for w in (r["text"] or "").lower().replace(",", " ").replace("!", " ").split() if w != "wzz"]
            weights = [weight(w[1:]) for w in ws]
            assert hits[r["doc_id"]] == (sum(w > 0 for w in weights), sum(w < 0 for w in weights))


def test_large_lexicon_does_not_sort_occurrences(spark, monkeypatch, capsys):
    """Their sort took a task's memory for every word of every text."""
    monkeypatch.setattr(news, "BROADCAST_LEXICON", 0)
    lexicon = spark.range(1000).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).alias("weight"))
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("w1 w2 w1").alias("text"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        news.with_lexicon(docs, lexicon).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = capsys.readouterr().out
    assert plan.count("ShuffledHashJoin") == 2 and "Sort " not in plan and "SortMergeJoin" not in plan


def test_sentiment_function_of_sql(spark):
    news.register_sentiment(spark, positive=("good", "o'neil"), negative=("bad",))
    got = spark.sql("select get_sentiment_score(t) as s from values ('Good, GOOD? bad.'), ('x'), (null), ('O') as v(t)").collect()
    assert [r["s"] for r in got] == [0.25, 0.0, 0.0, 0.0]


def test_sentiment_splits_a_text_once(spark, capsys):
    docs = spark.createDataFrame([("a good day",)], "text string")
    news.with_sentiment(docs).explain("extended")
    plan = capsys.readouterr().out.split("Physical Plan")[1]
    assert plan.count("split(") == 1
