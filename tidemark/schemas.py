"""Declared schemas of the stored tables, in DDL."""

from __future__ import annotations

BARS = (
    "symbol string, interval string, open_time timestamp, open double, high double, low double, "
    "close double, volume double, quote_asset_volume double, number_of_trades bigint, "
    "taker_buy_base_vol double, taker_buy_quote_vol double, log_ret double"
)
AGG_TRADES = (
    "symbol string, agg_trade_id bigint, price double, qty double, first_trade_id bigint, "
    "last_trade_id bigint, timestamp timestamp, is_buyer_maker boolean"
)
DEPTH = "symbol string, timestamp timestamp, side string, level int, price double, quantity double"
DAILY_BARS = (
    "ticker string, date date, open double, high double, low double, close double, volume double, log_ret double"
)
VOL_INDEX = "timestamp timestamp, open double, high double, low double, dvol_close double"
OPTION_CHAIN = (
    "instrument_name string, mark_iv double, mark_price double, underlying_price double, timestamp timestamp"
)
SERIES = "date date, series string, value double"
CRYPTO_NEWS = (
    "id bigint, published_at timestamp, title string, currencies string, source_domain string, "
    "votes_positive bigint, votes_negative bigint, votes_important bigint, votes_liked bigint, "
    "votes_disliked bigint, votes_lol bigint, votes_toxic bigint, kind string, panic_score double"
)
NEWS = (
    "asset string, published_at timestamp, source_name string, title string, description string, "
    "url string, author string"
)
# One landed order-book snapshot: [price, quantity] pairs as text, best quote first.
BOOK = "struct<bids:array<array<string>>,asks:array<array<string>>>"
BOOK_LEVELS = 20
GKG = "DATE timestamp, V2Tone string, Themes string, SourceCommonName string"
EQUITY_FEAR_GREED = "value double, value_classification string, date timestamp"
CRYPTO_FEAR_GREED = (
    "value double, value_classification string, timestamp string, time_until_update string, date timestamp"
)
RV_DAILY = (
    "symbol string, date date, RV double, BV double, J_t double, C_t double, PK double, GK double, "
    "log_RV double, RV_d double, RV_w double, RV_m double, RV_ann double, vol_ann double"
)
OBI_DAILY = (
    "symbol string, date date, OBI_mean double, OBI_sq double, OBI_std double, OBI_abs double, "
    "ILLIQ double, Roll double, RS double, RK double"
)
VPIN_DAILY = "symbol string, date date, VPIN double"
