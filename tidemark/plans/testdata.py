"""The given tables as market data.

They hold orders and events, not prices; these mappings give them the shapes the
operators expect (ticks, daily ticks, news records, a panel, landed vendor payloads).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import tick_bars
from ..session import pin
from ..sources.tables import MACRO_SERIES

DAILY_TICK_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(table(spark, sf_dir, "events"))


def as_ticks(events: DataFrame) -> DataFrame:
    """``events`` as trades: the event type is the symbol, the value the price."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("tick_id"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_bars(ticks(spark, sf_dir), "1 hour", order=["ts", "tick_id"])


def daily_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as trades dated by day: a long history for the statistics.

    Within a day the ties give the order; a trade is a bar of one price.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("open_time"),
        *DAILY_TICK_TIES,
        *[price.alias(c) for c in ("open", "high", "low", "close")],
        F.col("l_quantity").alias("volume"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, high, low and close per day of the daily ticks."""
    key = F.struct(*DAILY_TICK_TIES)
    return (
        daily_ticks(spark, sf_dir)
        .groupBy("symbol", F.to_date("open_time").alias("date"))
        .agg(
            F.min_by("close", key).alias("open"),
            F.max("close").alias("high"),
            F.min("close").alias("low"),
            F.max_by("close", key).alias("close"),
        )
    )


def quotes_and_trades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``events`` as two streams of one account each: views are quotes, purchases and signups trades."""
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    quotes = events.where("event_type = 'view'").select("user_id", "ts", "event_id", F.col("value").alias("quote"))
    trades = events.where("event_type in ('purchase', 'signup')").select("user_id", "ts", F.col("event_id").alias("trade_id"), F.col("value").alias("price"))
    return quotes, trades


def gappy_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of which two in three lack a price and one in two a quantity."""
    return ticks(spark, sf_dir).select(
        "symbol", "ts", "tick_id",
        F.when(F.col("tick_id") % 3 == 0, F.col("price")).alias("price"),
        F.when(F.col("qty") % 2 == 0, F.col("qty")).alias("qty"),
    )


def book_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as changes of a book: one in ten takes its level away."""
    return _events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.when(F.col("user_id") % 2 == 0, "bid").otherwise("ask").alias("side"),
        F.floor("value").cast("double").alias("price"),
        F.when(F.col("k") % 10 == 0, 0.0).otherwise(F.col("k").cast("double")).alias("quantity"),
    )


def gkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as news-event records."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("DATE"),
        F.concat(
            F.round(F.col("value") - 50, 2).cast("string"), F.lit(","), F.get_json_object("props", "$.k")
        ).alias("V2Tone"),
        F.when(kind == "error", F.concat(F.lit("CRISISLEX_"), F.upper(kind)))
        .when(kind == "signup", "ECON_BANKRUPTCY")
        .when(kind == "purchase", "CRYPTO")
        .otherwise("OTHER").alias("Themes"),
        F.col("user_id").cast("string").alias("SourceCommonName"),
    )


PANEL_IDS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as five irregular daily series."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date"))
        .agg(F.avg("o_totalprice").alias("value"))
    )


def macro_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` dealt to the macro series by customer."""
    ids = F.array(*[F.lit(s) for s in MACRO_SERIES])
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.get(ids, (F.col("o_custkey") % len(MACRO_SERIES)).cast("int")).alias("series"), F.to_date("o_orderdate").alias("date"))
        .agg(F.max("o_totalprice").alias("value"))
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote counts per user and day from the event types."""
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").alias("date"))
        .agg(
            F.count_if(kind == "purchase").alias("votes_positive"),
            F.count_if(kind == "error").alias("votes_negative"),
            F.count_if(kind == "signup").alias("votes_toxic"),
        )
    )


# Landed vendor documents, one per source row, so that building them needs no shuffle.


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", _k())


def _text(*cols: Column) -> Column:
    return F.array(*[c.cast("string") for c in cols])


def landed_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per hourly bar, holding that bar."""
    c = F.col
    bar = _text(
        _ms("open_time"), c("open"), c("high"), c("low"), c("close"), c("volume"),
        _ms("open_time") + 3_599_999, c("quote_asset_volume"), c("number_of_trades"),
        c("taker_buy_base_vol"), c("taker_buy_quote_vol"), F.lit("0"),
    )
    return hourly_bars(spark, sf_dir).select("symbol", F.to_json(F.array(bar)).alias("payload"))


def landed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    trade = F.struct(
        F.col("event_id").alias("a"),
        F.col("value").cast("string").alias("p"),
        F.col("k").cast("string").alias("q"),
        (F.col("event_id") * 2).alias("f"),
        (F.col("event_id") * 2 + 1).alias("l"),
        _ms("ts").alias("T"),
        (F.col("user_id") % 2 == 0).alias("m"),
    )
    return _events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), F.to_json(F.array(trade)).alias("payload")
    )


def landed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_books(table(spark, sf_dir, "events"))


def as_books(events: DataFrame) -> DataFrame:
    """25 levels a side around the event's value; only 20 are to be used."""
    i = F.sequence(F.lit(0), F.lit(24))
    bids = F.transform(i, lambda j: _text(F.col("value") - j * 0.01, (F.col("k") + j) % 7 + 1))
    asks = F.transform(i, lambda j: _text(F.col("value") + (j + 1) * 0.01, (F.col("k") * (j + 1)) % 11 + 1))
    return events.withColumn("k", _k()).select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.to_json(F.struct(bids.alias("bids"), asks.alias("asks"))).alias("payload"),
    )


def landed_vol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_totalprice")
    candle = F.array(*[c.cast("double") for c in (_ms("o_orderdate"), o, o + 2, o - 1, o + 1)])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_json(F.struct(F.struct(F.array(candle).alias("data")).alias("result"))).alias("payload"),
    )


def landed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instruments per document; every fifth lacks its implied volatility."""
    base = F.col("p_retailprice")
    option = lambda side: F.struct(
        F.concat(F.lit(f"{side}-"), F.col("p_partkey").cast("string")).alias("instrument_name"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("double")).alias("mark_iv"),
        (base / 1000).alias("mark_price"),
        base.alias("estimated_delivery_price"),
    )
    return table(spark, sf_dir, "part").select(
        F.to_json(F.struct(F.array(option("C"), option("P")).alias("result"))).alias("payload")
    )


def landed_crypto_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a post returned for both currencies; clicks come without votes."""
    kind = F.col("event_type")
    post = F.struct(
        F.col("event_id").alias("id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.concat(kind, F.lit(" "), F.col("user_id").cast("string")).alias("title"),
        F.lit("news").alias("kind"),
        F.struct(F.concat(kind, F.lit(".example")).alias("domain")).alias("source"),
        F.when(
            kind != "click",
            F.struct(
                F.col("k").alias("positive"),
                (F.col("user_id") % 5).alias("negative"),
                F.when(kind != "view", F.col("user_id") % 3).alias("toxic"),
            ),
        ).alias("votes"),
    )
    return (
        _events(spark, sf_dir)
        .select(F.to_json(F.struct(F.array(post).alias("results"))).alias("payload"))
        .withColumn("currency", F.explode(F.array(F.lit("BTC"), F.lit("ETH"))))
    )


def landed_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k mod 3 articles per document, so some pages are empty."""
    article = lambda j: F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        F.struct(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("name")).alias("source"),
        F.concat(F.col("event_type"), F.lit(" "), j.cast("string")).alias("title"),
        F.when(F.col("k") % 2 == 0, F.lit("about")).alias("description"),
        F.concat(F.lit("u/"), F.col("event_id").cast("string"), F.lit("/"), j.cast("string")).alias("url"),
        F.lit(None).cast("string").alias("author"),
    )
    articles = F.slice(F.array(article(F.lit(0)), article(F.lit(1))), F.lit(1), (F.col("k") % 3).cast("int"))
    return _events(spark, sf_dir).select(
        F.upper("event_type").alias("asset"), F.to_json(F.struct(articles.alias("articles"))).alias("payload")
    )


def landed_equity_fear_greed(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(
        _ms("o_orderdate").cast("double").alias("x"),
        (F.col("o_totalprice") / 5000).alias("y"),
        F.lower("o_orderpriority").alias("rating"),
    )
    history = F.struct(F.struct(F.array(point).alias("data")).alias("fear_and_greed_historical"))
    return table(spark, sf_dir, "orders").select(F.to_json(history).alias("payload"))


def landed_crypto_fear_greed(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(
        F.col("k").cast("string").alias("value"),
        F.col("event_type").alias("value_classification"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
        F.when(F.col("k") > 90, F.col("event_id").cast("string")).alias("time_until_update"),
    )
    return _events(spark, sf_dir).select(F.to_json(F.struct(F.array(point).alias("data"))).alias("payload"))
