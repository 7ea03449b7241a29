"""Landed vendor payloads to typed tables.

Input is a frame with one JSON document per row in ``payload`` and the request's context
(symbol, currency, asset) in columns of its own. Each document is parsed once against a
declared schema and flattened in the same stage: no shuffle. Number casts are strict, as
a malformed price should stop a load; a document that is no JSON gives no rows, and
``document_counts`` tells how many there are. Several pages or symbols are simply several rows; nothing is deduplicated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import epoch_ms, epoch_seconds, iso_time, tidy_name
from ..operators.bars import daily_log_returns, log_returns
from ..schemas import BOOK, BOOK_LEVELS


AGG_TRADES = "array<struct<a:bigint,p:string,q:string,f:bigint,l:bigint,T:bigint,m:boolean>>"


def document_counts(landed: DataFrame, schema: str, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Documents, and how many of them are missing or don't parse as ``schema``; folded before the shuffle."""
    lost = F.from_json("payload", schema).isNull()
    return landed.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.count_if(lost).alias("malformed"))


def read_landed(spark: SparkSession, path: str, context: str = "symbol string") -> DataFrame:
    """Vendor documents in a folder, a file each, below folders that name their context (symbol=...)."""
    fields = T.StructType.fromDDL(context)
    files = spark.read.schema(f"value string, {context}").option("wholetext", True).text(path)
    return files.select(*fields.names, F.col("value").alias("payload"))


def _parsed(landed: DataFrame, schema: str) -> DataFrame:
    return landed.withColumn("payload", F.from_json("payload", schema))


def klines(landed: DataFrame, by: Sequence[str] = ("symbol",), returns: bool = True) -> DataFrame:
    """Pages of 12-element bar arrays; close time and the last, unused element go."""
    items = _parsed(landed, "array<array<string>>").withColumn("_k", F.explode("payload"))

    def at(i: int, kind: str) -> Column:
        return F.get("_k", F.lit(i)).cast(kind)

    # The positions in the vendor's array.
    doubles = {
        "open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "quote_asset_volume": 7,
        "taker_buy_base_vol": 9, "taker_buy_quote_vol": 10,
    }
    bars = items.select(
        *by,
        epoch_ms(at(0, "bigint")).alias("open_time"),
        *[at(i, "double").alias(name) for name, i in doubles.items()],
        at(8, "bigint").alias("number_of_trades"),
    )
    return log_returns(bars, by) if returns else bars


def agg_trades(landed: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    t = F.col("_t")
    return _parsed(landed, AGG_TRADES).withColumn("_t", F.explode("payload")).select(
        *by,
        t["a"].alias("agg_trade_id"),
        t["p"].cast("double").alias("price"),
        t["q"].cast("double").alias("qty"),
        t["f"].alias("first_trade_id"),
        t["l"].alias("last_trade_id"),
        epoch_ms(t["T"]).alias("timestamp"),
        t["m"].alias("is_buyer_maker"),
    )


def depth(
    landed: DataFrame, by: Sequence[str] = ("symbol", "timestamp"), levels: int = BOOK_LEVELS
) -> DataFrame:
    """Order-book snapshots to rows: bids and asks appended, best levels of each side."""

    def side(name: str, quotes: Column) -> Column:
        return F.transform(
            F.slice(quotes, 1, levels),
            lambda q, i: F.struct(
                F.lit(name).alias("side"),
                i.alias("level"),
                F.get(q, F.lit(0)).cast("double").alias("price"),
                F.get(q, F.lit(1)).cast("double").alias("quantity"),
            ),
        )

    book = _parsed(landed, BOOK)
    none = F.array().cast("array<struct<side:string,level:int,price:double,quantity:double>>")
    both = F.concat(
        F.coalesce(side("bid", F.col("payload.bids")), none),
        F.coalesce(side("ask", F.col("payload.asks")), none),
    )
    return book.select(*by, F.inline(both))


def vol_index(landed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Implied-volatility index candles ``[ms, open, high, low, close]``."""
    schema = "struct<result:struct<data:array<array<double>>>>"
    items = _parsed(landed, schema).withColumn("_k", F.explode("payload.result.data"))
    values = ("open", "high", "low", "dvol_close")
    return items.select(
        *by,
        epoch_ms(F.get("_k", F.lit(0))).alias("timestamp"),
        *[F.get("_k", F.lit(i + 1)).alias(name) for i, name in enumerate(values)],
    )


def option_chain(landed: DataFrame, pulled_at: Column | None = None) -> DataFrame:
    schema = (
        "struct<result:array<struct<instrument_name:string,mark_iv:double,mark_price:double,"
        "estimated_delivery_price:double>>>"
    )
    o = F.col("_o")
    return _parsed(landed, schema).withColumn("_o", F.explode("payload.result")).select(
        o["instrument_name"].alias("instrument_name"),
        o["mark_iv"].alias("mark_iv"),
        o["mark_price"].alias("mark_price"),
        o["estimated_delivery_price"].alias("underlying_price"),
        (F.current_timestamp() if pulled_at is None else pulled_at).alias("timestamp"),
    )


def daily_ohlcv(vendor: DataFrame, by: Sequence[str] = ("ticker",), date: str = "Date") -> DataFrame:
    """A vendor's daily table: tidy names, UTC date, log return where there is a close.

    A two-level header arrives as ``Close|TICKER``; its first level is the name.
    """
    tidy = [tidy_name(c.split("|")[0]) for c in vendor.columns]
    named = vendor.toDF(*tidy)
    day = tidy_name(date)
    dated = named.withColumn(day, F.to_date(F.col(day)))
    if "close" not in tidy:
        return dated
    return daily_log_returns(dated, by, day)


def crypto_news(landed: DataFrame, currency: str = "currency") -> DataFrame:
    """Posts per currency with their votes; a missing vote object counts as no votes."""
    # The vendor's vote names.
    votes = ("positive", "negative", "important", "liked", "disliked", "lol", "toxic")
    schema = (
        "struct<results:array<struct<id:bigint,published_at:string,title:string,kind:string,"
        f"source:struct<domain:string>,votes:struct<{','.join(v + ':bigint' for v in votes)}>>>>"
    )
    p = F.col("_p")
    flat = _parsed(landed, schema).withColumn("_p", F.explode("payload.results")).select(
        p["id"].alias("id"),
        iso_time(p["published_at"]).alias("published_at"),
        p["title"].alias("title"),
        F.col(currency).alias("currencies"),
        p["source"]["domain"].alias("source_domain"),
        *[F.coalesce(p["votes"][v], F.lit(0)).alias(f"votes_{v}") for v in votes],
        p["kind"].alias("kind"),
    )
    return flat.withColumn("panic_score", panic_score())


def panic_score(positive="votes_positive", negative="votes_negative", toxic="votes_toxic") -> Column:
    return (F.col(negative) + F.col(toxic)) / (F.col(positive) + F.col(negative) + 1)


def news(landed: DataFrame, asset: str = "asset") -> DataFrame:
    schema = (
        "struct<articles:array<struct<publishedAt:string,source:struct<name:string>,title:string,"
        "description:string,url:string,author:string>>>"
    )
    a = F.col("_a")
    return _parsed(landed, schema).withColumn("_a", F.explode("payload.articles")).select(
        F.col(asset).alias("asset"),
        iso_time(a["publishedAt"]).alias("published_at"),
        a["source"]["name"].alias("source_name"),
        *[a[c].alias(c) for c in ("title", "description", "url", "author")],
    )


def equity_fear_greed(landed: DataFrame) -> DataFrame:
    schema = "struct<fear_and_greed_historical:struct<data:array<struct<x:double,y:double,rating:string>>>>"
    d = F.col("_d")
    rows = _parsed(landed, schema).withColumn("_d", F.explode("payload.fear_and_greed_historical.data"))
    return rows.select(
        d["y"].alias("value"), d["rating"].alias("value_classification"), epoch_ms(d["x"]).alias("date")
    )


def crypto_fear_greed(landed: DataFrame) -> DataFrame:
    schema = (
        "struct<data:array<struct<value:string,value_classification:string,timestamp:string,"
        "time_until_update:string>>>"
    )
    d = F.col("_d")
    return _parsed(landed, schema).withColumn("_d", F.explode("payload.data")).select(
        d["value"].cast("double").alias("value"),
        *[d[c].alias(c) for c in ("value_classification", "timestamp", "time_until_update")],
        epoch_seconds(d["timestamp"]).alias("date"),
    )
