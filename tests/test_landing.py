import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import depth, news
from tidemark.sources import landing

T0 = 1_704_067_200_000  # 2024-01-01 00:00 UTC in ms


def landed(spark, *documents, **context):
    rows = [(*context.values(), d if isinstance(d, str) else json.dumps(d)) for d in documents]
    return spark.createDataFrame(rows, [*context, "payload"])


def kline(ms, close):
    return [ms, "1.5", "2.5", "1.0", close, "10", ms + 299_999, "15", 7, "4", "6", "0"]


def test_klines(spark):
    pages = landed(
        spark, [kline(T0, "2.0"), kline(T0 + 300_000, "4.0")], [kline(T0 + 86_400_000, "2.0")], "no json",
        symbol="BTCUSDT",
    )
    got = landing.klines(pages).orderBy("open_time").collect()
    assert [r["open_time"] for r in got][:2] == [datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 5)]
    assert [r["log_ret"] for r in got] == [None, pytest.approx(0.6931471805599453), pytest.approx(-0.6931471805599453)]
    assert (got[0]["number_of_trades"], got[0]["taker_buy_quote_vol"]) == (7, 6.0)
    want = {c.split()[0] for c in schemas.BARS.split(", ")} - {"interval"}
    assert set(got[0].asDict()) == want


def test_malformed_price_stops_the_load(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        landing.klines(landed(spark, [kline(T0, "n/a")], symbol="S")).collect()


def test_agg_trades(spark):
    doc = [{"a": 1, "p": "3.5", "q": "0.25", "f": 10, "l": 12, "T": T0 + 1, "m": True, "M": False}]
    row = landing.agg_trades(landed(spark, doc, [], symbol="S")).first()
    assert row.asDict() == {
        "symbol": "S", "agg_trade_id": 1, "price": 3.5, "qty": 0.25, "first_trade_id": 10, "last_trade_id": 12,
        "timestamp": datetime(2024, 1, 1, 0, 0, 0, 1000), "is_buyer_maker": True,
    }


def test_depth_and_imbalance(spark):
    book = {"bids": [[str(10 - i), "2"] for i in range(25)], "asks": [[str(11 + i), "1"] for i in range(3)]}
    books = landed(spark, book, {"bids": [], "asks": []}, {}, symbol="S").withColumn(
        "timestamp", F.lit("2024-01-01").cast("timestamp")
    )
    rows = landing.depth(books.limit(1))
    assert rows.groupBy("side").count().orderBy("side").collect() == [("ask", 3), ("bid", 20)]
    assert rows.where("level = 0").orderBy("side").select("price").collect() == [(11.0,), (10.0,)]
    assert depth.depth_imbalance(rows).first()["imbalance"] == pytest.approx((40 - 3) / 43)
    assert depth.depth_imbalance(rows, levels=3).first()["imbalance"] == pytest.approx((6 - 3) / 9)
    got = [r["imbalance"] for r in depth.book_imbalance(books).collect()]
    assert got == [pytest.approx(37 / 43), None, None]


def test_vol_index_and_options(spark):
    index = landing.vol_index(landed(spark, {"result": {"data": [[T0, 50, 55, 45, 52.5], [T0 + 86_400_000, 1, 2, 3, 4]]}}))
    assert tuple(index.orderBy("timestamp").first()) == (datetime(2024, 1, 1), 50.0, 55.0, 45.0, 52.5)
    doc = {"result": [{"instrument_name": "C", "mark_iv": 60.1, "mark_price": 0.1, "estimated_delivery_price": 9.5}, {}]}
    rows = landing.option_chain(landed(spark, doc, {"result": []})).drop("timestamp").collect()
    assert [tuple(r) for r in rows] == [("C", 60.1, 0.1, 9.5), (None, None, None, None)]


def test_crypto_news(spark):
    doc = {
        "results": [
            {"id": 1, "published_at": "2024-01-01T05:00:00Z", "title": "t", "kind": "news",
             "source": {"domain": "d"}, "votes": {"positive": 1, "negative": 2, "toxic": 4}},
            {"id": 2, "published_at": "2024-01-01T05:00:00Z", "title": "u", "kind": "news"},
        ],
        "next": None,
    }
    pages = landed(spark, doc, currency="BTC").unionByName(landed(spark, doc, currency="ETH"))
    got = landing.crypto_news(pages).orderBy("id", "currencies").collect()
    assert len(got) == 4
    assert [r["panic_score"] for r in got] == [1.5, 1.5, 0.0, 0.0]
    assert got[2]["votes_lol"] == 0 and got[2]["source_domain"] is None
    assert got[0]["published_at"] == datetime(2024, 1, 1, 5)
    assert set(got[0].asDict()) == {c.split()[0] for c in schemas.CRYPTO_NEWS.split(", ")}


def test_news(spark):
    doc = {"articles": [{"publishedAt": "2024-01-01T05:00:00Z", "source": {"name": "n"}, "title": "t", "url": "u"}]}
    row = landing.news(landed(spark, doc, {"articles": []}, asset="SPX")).first()
    assert tuple(row) == ("SPX", datetime(2024, 1, 1, 5), "n", "t", None, "u", None)


def test_fear_and_greed(spark):
    doc = {"fear_and_greed_historical": {"data": [{"x": float(T0), "y": 44.5, "rating": "fear"}]}}
    assert tuple(landing.equity_fear_greed(landed(spark, doc, {})).first()) == (44.5, "fear", datetime(2024, 1, 1))
    doc = {"data": [{"value": "40", "value_classification": "Fear", "timestamp": str(T0 // 1000), "time_until_update": "5"},
                    {"value": "41", "value_classification": "Fear", "timestamp": str(T0 // 1000 + 86400)}]}
    got = landing.crypto_fear_greed(landed(spark, doc)).orderBy("date").collect()
    assert (got[0]["value"], got[0]["time_until_update"], got[1]["time_until_update"]) == (40.0, "5", None)
    assert got[1]["date"] == datetime(2024, 1, 2)


def test_daily_ohlcv(spark):
    rows = [("A", datetime(2024, 1, 2), 1.0, 2.0), ("A", datetime(2024, 1, 1), 1.0, 1.0), ("B", datetime(2024, 1, 1), 1.0, 3.0)]
    vendor = spark.createDataFrame(rows, "Ticker string, Date timestamp, `Adj Close` double, `Close|A` double")
    got = landing.daily_ohlcv(vendor).orderBy("ticker", "date")
    assert got.columns == ["ticker", "date", "adj_close", "close", "log_ret"]
    assert [r["log_ret"] for r in got.collect()] == [None, pytest.approx(0.6931471805599453), None]
    no_close = landing.daily_ohlcv(vendor.drop("Close|A"))
    assert no_close.columns == ["ticker", "date", "adj_close"]


def test_event_news(spark):
    rows = [
        ("-2.5,1", "X;CRISISLEX_T", "s1"), (None, "ECONXBANKRUPTCY", "s1"), ("", "crypto", "s2"), ("bad,3", "A_BITCOIN_B", None),
        ("4", None, "s3"),
    ]
    gkg = spark.createDataFrame(rows, "V2Tone string, Themes string, SourceCommonName string").withColumn(
        "DATE", F.lit("2024-01-01 23:59:59").cast("timestamp")
    )
    row = news.event_news_daily(gkg, "2024-01-01", "2024-01-01").first().asDict()
    assert (row["event_count"], row["avg_tone"], row["negative_share"]) == (5, 0.75, 0.2)
    assert (row["crisis_count"], row["crypto_count"], row["source_diversity"]) == (2, 1, 3)
    assert news.event_news_daily(gkg, "2024-01-02").count() == 0


def test_sentiment(spark):
    texts = spark.createDataFrame([("Good, GOOD? bad.",), ("nothing",), (None,)], "text string")
    got = [r["score"] for r in texts.withColumns(news.sentiment_columns()).collect()]
    assert got == [0.25, 0.0, 0.0]


def test_documents_in_a_folder(spark, tmp_path):
    for symbol, name, text in (("A", "1.json", '[{"a": 1, "p": "2.5", "q": "1", "T": 0, "m": true}]'), ("A", "2.json", "no json"), ("B", "3.json", "[]")):
        folder = tmp_path / f"symbol={symbol}"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(text)
    landed = landing.read_landed(spark, str(tmp_path))
    counts = {r["symbol"]: (r["documents"], r["malformed"]) for r in landing.document_counts(landed, landing.AGG_TRADES).collect()}
    assert counts == {"A": (2, 1), "B": (1, 0)}
    assert [(r["symbol"], r["agg_trade_id"], r["price"]) for r in landing.agg_trades(landed).collect()] == [("A", 1, 2.5)]
