"""The registered queries again, as SQL for DuckDB on the same tables.

Written from the definitions, with plain windows over whole series where the Spark side
works in segments, so that the two share no method.
"""

from __future__ import annotations

from ..functions.columns import NORMAL_DENOMINATOR, NORMAL_NUMERATOR
from ..operators.news import NEGATIVE_WORDS, POSITIVE_WORDS
from ..sources.tables import MACRO_SERIES, SEARCH_TERMS
from .testdata import PANEL_IDS

ORACLES: dict[str, str] = {}

# Shared table expressions; ``sql`` puts in those a query names, in this order.
CTE: dict[str, str] = {}

CTE["ticks"] = """
  select event_type as symbol, ts, event_id as tick_id, value as price,
         cast(json_extract_string(props, '$.k') as double) as qty, user_id % 2 = 0 as is_buyer_maker
  from events"""

CTE["bars"] = """
  select symbol, date_trunc('hour', ts) as open_time,
         first(price order by ts, tick_id) as open, max(price) as high, min(price) as low,
         last(price order by ts, tick_id) as close, sum(qty) as volume,
         sum(price * qty) as quote_asset_volume, count(*) as number_of_trades,
         coalesce(sum(case when not is_buyer_maker then qty end), 0.0) as taker_buy_base_vol,
         coalesce(sum(case when not is_buyer_maker then price * qty end), 0.0) as taker_buy_quote_vol
  from ticks group by all"""

_TIES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

CTE["trades"] = f"""
  select l_returnflag as symbol, l_shipdate as open_time, {_TIES},
         l_extendedprice / l_quantity as open, l_extendedprice / l_quantity as high,
         l_extendedprice / l_quantity as low, l_extendedprice / l_quantity as close, l_quantity as volume
  from lineitem"""

CTE["daily_bars"] = f"""
  select symbol, cast(open_time as date) as date, first(close order by {_TIES}) as open,
         max(close) as high, min(close) as low, last(close order by {_TIES}) as close
  from trades group by all"""

CTE["panel"] = """
  select o_orderpriority as series, cast(o_orderdate as date) as date, avg(o_totalprice) as value
  from orders group by all"""

CTE["gkg"] = """
  select ts as DATE, concat(cast(round(value - 50, 2) as varchar), ',', json_extract_string(props, '$.k')) as V2Tone,
         case event_type when 'error' then 'CRISISLEX_ERROR' when 'signup' then 'ECON_BANKRUPTCY'
              when 'purchase' then 'CRYPTO' else 'OTHER' end as Themes,
         cast(user_id as varchar) as SourceCommonName
  from events"""


def _rv(source: str, ties: str = "") -> dict[str, str]:
    """Realized and microstructure measures per (symbol, day), by windows over whole series."""
    order = f"open_time{', ' + ties if ties else ''}"
    return {
        f"{source}_r": f"""
  select *, cast(open_time as date) as date,
         coalesce(ln(nullif(close, 0) / nullif(lag(close) over (partition by symbol order by {order}), 0)), 0) as r,
         volume * (close - low) / (high - low + 1e-10) as buy
  from {source}""",
        f"{source}_p": f"""
  select *, lag(r) over (partition by symbol, date order by {order}) as rp,
         (buy - (volume - buy)) / (buy + (volume - buy) + 1e-10) as obi
  from {source}_r""",
        f"{source}_d": f"""
  select symbol, date, count(*) as n, sum(r * r) as rv, coalesce(sum(abs(r) * abs(rp)), 0) * pi() / 2 as bv,
         first(open order by {order}) as o, max(high) as h, min(low) as l, last(close order by {order}) as c,
         sum(r * r * r) as r3, sum(r * r * r * r) as r4,
         avg(obi) as OBI_mean, avg(obi * obi) as OBI_sq, stddev_pop(obi) as OBI_std, avg(abs(obi)) as OBI_abs,
         avg(abs(r) / (volume + 1e-10)) * 1e6 as ILLIQ,
         case when count(*) > 2 then 2 * sqrt(greatest(-covar_samp(r, rp), 0)) else 0 end as Roll,
         sqrt(count(*)) * sum(r * r * r) / (pow(sum(r * r), 1.5) + 1e-10) as RS,
         count(*) * sum(r * r * r * r) / (sum(r * r) * sum(r * r) + 1e-10) as RK
  from {source}_p group by symbol, date""",
        f"{source}_rv": f"""
  select symbol, date, rv as RV, bv as BV, greatest(rv - bv, 0) as J_t, rv - greatest(rv - bv, 0) as C_t,
         case when l > 0 then pow(ln(h / l), 2) / (4 * ln(2)) else 0 end as PK,
         case when l > 0 and o > 0
              then 0.5 * pow(ln(h / l), 2) - (2 * ln(2) - 1) * pow(ln(nullif(c, 0) / o), 2) else 0 end as GK,
         ln(nullif(rv, 0)) as log_RV, OBI_mean, OBI_sq, OBI_std, OBI_abs, ILLIQ, Roll, RS, RK, c as close
  from {source}_d""",
        f"{source}_har": _har(f"{source}_rv", 365, "sqrt(RV * 365)"),
    }


def _har(source: str, days: int, vol: str) -> str:
    def mean(n: int) -> str:
        frame = f"(partition by symbol order by date rows between {n} preceding and 1 preceding)"
        return f"case when count(log_RV) over {frame} = {n} then avg(log_RV) over {frame} end"

    return f"""
  select *, lag(log_RV) over (partition by symbol order by date) as RV_d, {mean(5)} as RV_w, {mean(22)} as RV_m,
         RV * {days} as RV_ann, {vol} as vol_ann
  from {source}"""


CTE |= _rv("bars")
CTE["gappy"] = "select * replace (case when hour(open_time) % 5 <> 0 then volume end as volume) from bars"
CTE |= _rv("gappy")
CTE |= _rv("trades", _TIES)


def _phi(z: str) -> str:
    """The same published approximation of the normal distribution function."""
    x = f"least(abs({z}), 37.0)"

    def horner(coefficients: tuple[float, ...]) -> str:
        out = repr(coefficients[0]) + "::double"
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r}::double)"
        return out

    tail = f"exp(-{x} * {x} / 2) * {horner(NORMAL_NUMERATOR)} / {horner(NORMAL_DENOMINATOR)}"
    return f"case when {z} is null then null when {z} > 0 then 1 - {tail} else {tail} end"


def _vpin(
    name: str, source: str, time: str, ties: str, price: str, volume: str, v_star: str | None = None,
    signed: bool = False,
) -> dict[str, str]:
    order = time + ties
    size = v_star or (
        f"greatest((select sum({volume}) from {source} s where s.symbol = t.symbol)"
        f" / greatest((select date_diff('microsecond', min({time}), max({time})) // 86400000000"
        f" from {source} s where s.symbol = t.symbol), 1) / 50, 1.0)"
    )
    taker = f", sum(case when not is_buyer_maker then {volume} else 0.0 end) as V_taker" if signed else ""
    bought = "V_taker" if signed else f"V_total * ({_phi('dP / sigma_dP')})"
    return {
        f"{name}_sizes": f"select symbol, {size} as V_star from (select distinct symbol from {source}) t",
        f"{name}_cum": f"""
  select {source}.*, V_star, cast(floor(cast(
           sum(cast({volume} as decimal(38,8))) over (partition by symbol order by {order}
               rows between unbounded preceding and current row) as double) / V_star) as bigint) as bucket
  from {source} join {name}_sizes using (symbol)""",
        f"{name}_buckets": f"""
  select symbol, bucket, last({price} order by {order}) - first({price} order by {order}) as dP,
         sum({volume}) as V_total, max({time}) as timestamp, max(V_star) as V_star{taker}
  from {name}_cum group by symbol, bucket""",
        f"{name}_sigma": f"""
  select *, case when s = 0 then 1e-10 else s end as sigma_dP from (
    select *, stddev_samp(dP) over (partition by symbol order by bucket
              rows between 249 preceding and current row) as s from {name}_buckets)""",
        f"{name}_sides": f"select *, {bought} as V_buy from {name}_sigma",
        f"{name}_scored": f"""
  select *, V_total - V_buy as V_sell,
         case when count(V_buy) over w = 50 then sum(abs(V_buy - (V_total - V_buy))) over w / (50 * V_star) end as VPIN
  from {name}_sides window w as (partition by symbol order by bucket rows between 49 preceding and current row)""",
        f"{name}_last": f"""
  select symbol, cast(timestamp as date) as date,
         last(VPIN order by bucket) filter (VPIN is not null) as VPIN from {name}_scored group by all""",
        f"{name}_spine": f"""
  select symbol, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
  from {name}_last group by symbol""",
        f"{name}_daily": f"select symbol, date, VPIN from {name}_spine left join {name}_last using (symbol, date)",
    }


CTE |= _vpin("tv", "ticks", "ts", ", tick_id", "price", "qty")
CTE |= _vpin("sv", "ticks", "ts", ", tick_id", "price", "qty", "150.0", signed=True)
CTE |= _vpin("lv", "trades", "open_time", f", {_TIES}", "close", "volume")
CTE |= _vpin("bv", "bars", "open_time", "", "close", "volume")

CTE["fit_rows"] = """
  select * from trades_har where log_RV is not null and RV_d is not null and RV_w is not null and RV_m is not null"""
_XS = ("RV_d", "RV_w", "RV_m")
CTE["moments"] = "select symbol, count(*) as n, " + ", ".join(
    [f"avg({a}) as m_{a}" for a in (*_XS, "log_RV")]
    + [f"covar_pop({a}, {b}) as c_{a}_{b}" for a in (*_XS, "log_RV") for b in (*_XS, "log_RV")]
) + " from fit_rows group by symbol"


def _det(columns: list[list[str]]) -> str:
    (a, d, g), (b, e, h), (c, f, i) = columns
    return f"({a}*({e}*{i}-{f}*{h}) - {b}*({d}*{i}-{f}*{g}) + {c}*({d}*{h}-{e}*{g}))"


_COLS = [[f"c_{a}_{b}" for a in _XS] for b in _XS]
_RIGHT = [f"c_{a}_log_RV" for a in _XS]
CTE["slopes"] = "select *, " + ", ".join(
    f"{_det([_RIGHT if j == k else _COLS[j] for j in range(3)])} / {_det(_COLS)} as b_{_XS[k]}" for k in range(3)
) + " from moments"
CTE["fit"] = f"""
  select symbol, n, m_log_RV - {' - '.join(f'b_{x} * m_{x}' for x in _XS)} as b_0, b_RV_d, b_RV_w, b_RV_m,
         ({' + '.join(f'b_{x} * c_{x}_log_RV' for x in _XS)}) / c_log_RV_log_RV as r2
  from slopes"""
CTE["forecasts"] = """
  select h.*, b_0 + b_RV_d * RV_d + b_RV_w * RV_w + b_RV_m * RV_m as pred_log_RV,
         exp(b_0 + b_RV_d * RV_d + b_RV_w * RV_w + b_RV_m * RV_m) as pred_RV,
         log_RV - (b_0 + b_RV_d * RV_d + b_RV_w * RV_w + b_RV_m * RV_m) as resid
  from trades_har h join fit using (symbol) where RV_d is not null and RV_w is not null and RV_m is not null"""
# Refits for each day, over the rows before it: all of them, or the last 500.
CTE["days"] = "select *, row_number() over (partition by symbol order by date) as at from trades_har"
CTE["fit_days"] = """
  select * from days where log_RV is not null and RV_d is not null and RV_w is not null and RV_m is not null"""
for _name, _since in (("expanding", 0), ("rolling", 500)):
    CTE[f"{_name}_moments"] = "select d.symbol, d.date, count(f.at) as n, " + ", ".join(
        [f"case when count(f.at) >= 60 then avg(f.{a}) end as m_{a}" for a in (*_XS, "log_RV")]
        + [f"covar_pop(f.{a}, f.{b}) as c_{a}_{b}" for a in (*_XS, "log_RV") for b in (*_XS, "log_RV")]
    ) + " from days d left join fit_days f on f.symbol = d.symbol and f.at < d.at " + (
        f"and f.at >= d.at - {_since} " if _since else ""
    ) + "group by d.symbol, d.date"
    CTE[f"{_name}_slopes"] = CTE["slopes"].replace("from moments", f"from {_name}_moments")
    CTE[f"{_name}_forecasts"] = f"""
  select h.*, n, {', '.join(f'case when n >= 60 then b_{x} end as b_{x}' for x in _XS)},
         m_log_RV - {' - '.join(f'b_{x} * m_{x}' for x in _XS)} as b_0,
         m_log_RV + {' + '.join(f'b_{x} * (h.{x} - m_{x})' for x in _XS)} as pred_log_RV
  from trades_har h join {_name}_slopes s on s.symbol = h.symbol and s.date = h.date"""
CTE["returns"] = """
  select symbol, date, ln(nullif(close, 0) / nullif(lag(close) over (partition by symbol order by date), 0)) as ret
  from daily_bars"""
CTE["weights"] = """
  select symbol, date, pred_RV, 0.25 * 0.02 / sqrt(pred_RV) as weight, ret from forecasts join returns using (symbol, date)"""
CTE["net"] = """
  select *, before * ret as gross_ret, 5.0 * 1e-4 * abs(weight - before) as cost,
         before * ret - 5.0 * 1e-4 * abs(weight - before) as net_ret
  from (select *, coalesce(lag(weight) over (partition by symbol order by date), 0.0) as before from weights)"""
# The same with coefficients from the days up to one, and positions on the days after it.
_UNTIL = "1996-12-31"
CTE["fit_rows_oos"] = CTE["fit_rows"] + f" and date <= date '{_UNTIL}'"
for _name, _source in (("moments", "from fit_rows"), ("slopes", "from moments"), ("fit", "from slopes"), ("forecasts", "join fit")):
    CTE[f"{_name}_oos"] = CTE[_name].replace(_source, f"{_source}_oos")
CTE["weights_oos"] = CTE["weights"].replace("from forecasts", "from forecasts_oos") + f" where date > date '{_UNTIL}'"
CTE["net_oos"] = CTE["net"].replace("from weights", "from weights_oos")
CTE["texts"] = f"""
  select doc_id, source as asset, cast(date '2024-01-01' + cast(doc_id % 30 as integer) as date) as date,
         len(list_filter(w, lambda x: x in ({', '.join(f"'{x}'" for x in POSITIVE_WORDS)}))) as pos,
         len(list_filter(w, lambda x: x in ({', '.join(f"'{x}'" for x in NEGATIVE_WORDS)}))) as neg
  from (select *, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+') as w from documents)"""
CTE["lexicon"] = """
  select word, cast(length(word) % 3 - 1 as integer) as weight
  from (select distinct unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+')) as word from documents)
  where regexp_full_match(word, '[a-z]+')"""
CTE["lexicon_hits"] = """
  select doc_id, count(*) filter (weight > 0) as pos, count(*) filter (weight < 0) as neg
  from (select doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+')) as word from documents)
  join lexicon using (word) group by doc_id"""
CTE["gappy"] = """
  select symbol, ts, tick_id, case when tick_id % 3 = 0 then price end as price, case when qty % 2 = 0 then qty end as qty
  from ticks"""
CTE["quotes"] = "select user_id, ts, event_id, value as quote from events where event_type = 'view'"
CTE["deals"] = """
  select user_id, ts, event_id as trade_id, value as price from events where event_type in ('purchase', 'signup')"""
CTE["changes"] = """
  select event_type as symbol, ts, case when user_id % 2 = 0 then 'bid' else 'ask' end as side, floor(value) as price,
         case when k % 10 = 0 then 0.0::double else k::double end as quantity
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""
CTE["grid"] = """
  select unnest(generate_series(epoch_us(min(ts)) // 21600000000, (epoch_us(max(ts)) - 1) // 21600000000 + 1)) as g from changes"""
CTE["standing"] = """
  select symbol, g, side, price, arg_max(quantity, ts) as quantity
  from grid join changes c on epoch_us(c.ts) <= g * 21600000000 group by all"""
CTE["best"] = """
  select symbol, make_timestamp(g * 21600000000) as timestamp, side, price, quantity,
         row_number() over (partition by symbol, g, side order by case when side = 'bid' then -price else price end) - 1 as level
  from standing where quantity > 0"""
CTE["books"] = """
  select event_type as symbol, ts as timestamp, value, cast(json_extract_string(props, '$.k') as bigint) as k
  from events"""
CTE["levels"] = """
  select symbol, timestamp, 'bid' as side, j as level, value - j * 0.01::double as price, (k + j) % 7 + 1 as quantity
  from books, (select unnest(range(20)) as j)
  union all
  select symbol, timestamp, 'ask', j, value + (j + 1) * 0.01::double, (k * (j + 1)) % 11 + 1
  from books, (select unnest(range(20)) as j)"""
CTE["raw_text"] = """
  select event_id, concat(json_extract_string(props, '$.k'), case event_type when 'error' then 'x' else '' end) as k,
         case event_type when 'view' then 'soon' else cast(value as varchar) end as value,
         case event_type when 'click' then 'never' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as ts
  from events"""

# Column kinds, as ``shown`` on the Spark side treats them.
DAY, TIME, NUM, EXACT, INT = "day", "time", "num", "exact", "int"


def _cell(name: str, kind: str) -> str:
    c = f'"{name}"'
    return {
        DAY: f"strftime({c}, '%Y-%m-%d')",
        TIME: f"strftime({c}, '%Y-%m-%d %H:%M:%S')",
        NUM: f"cast(cast(round(cast({c} as double), 10) + 0.0 as real) as double)",
        EXACT: c,
        INT: f"cast({c} as bigint)",
    }[kind] + f" as {c}"


def oracle(name: str, body: str, **kinds: str) -> None:
    """Register SQL for a query; ``kinds`` are its columns. Only the needed CTEs go in."""
    chosen, text = [], body
    for cte in reversed(list(CTE)):
        if any(f"{before}{cte}{after}" in f" {text} ".replace("\n", " ") for before in " (," for after in " .),"):
            chosen.append(cte)
            text += " " + CTE[cte]
    ctes = ",\n".join(f"{c} as ({CTE[c]})" for c in reversed(chosen))
    cells = ", ".join(_cell(c, k) for c, k in kinds.items())
    ORACLES[name] = f"{'with ' + ctes if ctes else ''}\nselect {cells} from ({body}) q"


_P = {"open": EXACT, "high": EXACT, "low": EXACT, "close": EXACT, "volume": EXACT}
_BAR = {
    "symbol": EXACT, "open_time": TIME, **_P, "quote_asset_volume": NUM, "number_of_trades": INT,
    "taker_buy_base_vol": NUM, "taker_buy_quote_vol": NUM,
}
_KEY = {"symbol": EXACT, "date": DAY}


def _num(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, NUM)


_RV = _num("RV", "BV", "J_t", "C_t", "PK", "GK", "log_RV", "RV_d", "RV_w", "RV_m", "RV_ann", "vol_ann")
_OBI = _num("OBI_mean", "OBI_sq", "OBI_std", "OBI_abs")
_LIQ = _num("ILLIQ", "Roll", "RS", "RK")
_LOG_RET = "ln(nullif(close, 0) / nullif(lag(close) over (partition by symbol order by open_time), 0)) as log_ret"

oracle("bars_hourly", "select *, '1 hour' as interval from bars", **_BAR, interval=EXACT)
oracle("log_returns", f"select *, {_LOG_RET} from bars", symbol=EXACT, open_time=TIME, close=EXACT, log_ret=NUM)
oracle("rv_daily", "select * from bars_har ", **_KEY, **_RV)
oracle("har_features", "select * from trades_har ", **_KEY, **_RV)
oracle("har_features_cut", "select * from trades_har ", **_KEY, **_RV)
oracle("micro_with_gaps", "select * from gappy_rv ", **_KEY, **_OBI, **_LIQ)
CTE["two"] = """
  select symbol, '1h' as interval, open_time, close from bars
  union all
  select symbol, '1d', date_trunc('day', open_time), last(close order by open_time) from bars group by 1, 2, 3"""
oracle(
    "log_returns_by_interval",
    """select *, ln(nullif(close, 0) / nullif(lag(close) over (partition by symbol, interval order by open_time), 0)) as log_ret
       from two """,
    symbol=EXACT, interval=EXACT, open_time=TIME, close=EXACT, log_ret=NUM,
)
oracle(
    "rewritten_series",
    "select symbol, open_time, case when symbol = 'click' then close * 2 else close end as close from bars ",
    symbol=EXACT, open_time=TIME, close=EXACT,
)
oracle(
    "panel_missing_series",
    """select date, max(value) filter (series = '1-URGENT') as urgent, cast(null as double) as absent from panel group by date""",
    date=DAY, urgent=NUM, absent=NUM,
)
CTE["equity"] = """
  select symbol, date, pow(ln(high / nullif(low, 0)), 2) / (4 * ln(2)) as PK,
         0.5 * pow(ln(high / nullif(low, 0)), 2) - (2 * ln(2) - 1) * pow(ln(nullif(close, 0) / nullif(open, 0)), 2) as GK,
         ret as log_ret, ret * ret as RV, ln(nullif(ret * ret, 0)) as log_RV
  from daily_bars join returns using (symbol, date)"""
oracle(
    "equity_daily_rv", _har("equity ", 252, "sqrt(nullif(RV * 252, 0))"), **_KEY,
    **_num("PK", "GK", "log_ret", "RV", "log_RV", "RV_d", "RV_w", "RV_m", "RV_ann", "vol_ann"),
)
oracle("obi_daily", "select * from bars_rv ", **_KEY, **_OBI)
oracle("liquidity_daily", "select * from bars_rv ", **_KEY, **_LIQ)
oracle("tick_micro_daily", "select * from trades_rv ", **_KEY, **_OBI, **_LIQ)
oracle(
    "vpin_buckets", "select * from tv_scored ", symbol=EXACT, bucket=INT, timestamp=TIME,
    **_num("dP", "V_total", "V_star", "sigma_dP", "V_buy", "V_sell", "VPIN"),
)
oracle("vpin_daily", "select * from tv_daily ", **_KEY, VPIN=NUM)
oracle("vpin_bars_daily", "select * from bv_daily ", **_KEY, VPIN=NUM)
oracle("vpin_trades_daily", "select * from lv_daily ", **_KEY, VPIN=NUM)
oracle("vpin_signed_daily", "select * from sv_daily ", **_KEY, VPIN=NUM)

_WIDE = ", ".join(f"max(case when series = '{s}' then value end) as \"{s}\"" for s in PANEL_IDS)
CTE["wide"] = f"select date, {_WIDE} from panel group by date"
oracle(
    "macro_ffill",
    "select date, " + ", ".join(
        f'last_value("{s}" ignore nulls) over (order by date) as "{s}"' for s in PANEL_IDS
    ) + " from wide ",
    date=DAY, **_num(*PANEL_IDS),
)
_MACRO = ", ".join(f"max(o_totalprice) filter (o_custkey % 20 = {i}) as \"{m}\"" for i, m in enumerate(MACRO_SERIES))
CTE["macro"] = f"""
  select cast(o_orderdate as date) as date, {_MACRO} from orders group by 1"""
oracle(
    "macro_panel_filled",
    "select date, " + ", ".join(f'last_value("{m}" ignore nulls) over (order by date) as "{m}"' for m in MACRO_SERIES) + " from macro ",
    date=DAY, **_num(*MACRO_SERIES),
)
oracle(
    "source_diversity_weekly",
    """select cast(date_trunc('week', DATE) as date) as span, count(distinct SourceCommonName) as source_diversity,
              count(*) as event_count from gkg group by 1""",
    span=DAY, source_diversity=INT, event_count=INT,
)
oracle(
    "maintained_bars",
    """select symbol, open_time, case when symbol = 'click' and cast(open_time as date) = date '2024-01-05' then -close else close end as close
       from bars """,
    symbol=EXACT, open_time=TIME, close=EXACT,
)
oracle(
    "sketched_quantile_ranks",
    """select symbol, count(*) as n, 1 as q10_near, 1 as q50_near, 1 as q90_near from forecasts where log_RV is not null group by 1""",
    symbol=EXACT, n=INT, q10_near=INT, q50_near=INT, q90_near=INT,
)
oracle(
    "search_trends",
    "select cast(date_trunc('week', o_orderdate) as date) as date, " + ", ".join(
        f"nullif(count(*) filter (o_orderpriority = '{s}'), 0) as {t}"
        for s, t in zip(PANEL_IDS, SEARCH_TERMS)
    ) + " from orders group by 1",
    date=DAY, **dict.fromkeys(SEARCH_TERMS, INT),
)
oracle(
    "term_structure",
    """select date, "1-URGENT" as VIX, "2-HIGH" as VIX9D, "3-MEDIUM" as VX3M, "3-MEDIUM" - "2-HIGH" as term_slope,
       "3-MEDIUM" > "1-URGENT" as contango from wide
       where "1-URGENT" is not null and "2-HIGH" is not null and "3-MEDIUM" is not null""",
    date=DAY, **_num("VIX", "VIX9D", "VX3M", "term_slope"), contango=INT,
)
oracle(
    "calendar_spine",
    """select series, date, n from (
         select o_orderpriority as series,
                cast(unnest(generate_series(min(cast(o_orderdate as date)), max(cast(o_orderdate as date)), interval 1 day)) as date) as date
         from orders group by 1)
       left join (select o_orderpriority as series, cast(o_orderdate as date) as date, count(*) as n from orders group by all)
       using (series, date)""",
    series=EXACT, date=DAY, n=INT,
)
CTE["latest"] = """
  select s.symbol, s.date, p.series, case when s.date - p.date <= 3 then p.value end as value
  from (select symbol, date, unnest([{}]) as series from trades_rv) s
  asof left join panel p on s.series = p.series and s.date >= p.date""".format(", ".join(f"'{s}'" for s in PANEL_IDS))
oracle(
    "asof_features",
    f"select symbol, date, RV, {', '.join(chr(34) + s + chr(34) for s in PANEL_IDS)} from trades_rv "
    f"join (select symbol, date, {_WIDE} from latest group by symbol, date) using (symbol, date)",
    **_KEY, RV=NUM, **_num(*PANEL_IDS),
)


def _gkg(where: str) -> str:
    tone = "try_cast(string_split(V2Tone, ',')[1] as double)"
    return f"""
  select cast(DATE as date) as date, count(*) as event_count, avg({tone}) as avg_tone,
         count(*) filter ({tone} < 0) / count(*) as negative_share,
         count(*) filter (Themes like '%CRISISLEX%' or Themes like '%ECON_BANKRUPTCY%') as crisis_count,
         count(*) filter (Themes like '%CRYPTO%' or Themes like '%BITCOIN%') as crypto_count,
         count(distinct SourceCommonName) as source_diversity
  from gkg {where} group by 1"""


oracle(
    "gkg_daily", _gkg("where cast(DATE as date) between date '2024-01-05' and date '2024-01-25'"), date=DAY,
    event_count=INT, avg_tone=NUM, negative_share=NUM, crisis_count=INT, crypto_count=INT, source_diversity=INT,
)
CTE["seen_vpin"] = "select symbol, date, VPIN from tv_daily where VPIN is not null"
CTE["news_days"] = _gkg("")
oracle(
    "feature_matrix",
    """select h.*, case when h.date - v.date <= 2 then v.VPIN end as VPIN, avg_tone, crisis_count
       from bars_har h asof left join seen_vpin v on h.symbol = v.symbol and h.date >= v.date
       left join news_days e on e.date = h.date""",
    **_KEY, **_num("RV", "log_RV", "RV_d", "RV_w", "OBI_mean", "ILLIQ", "Roll", "VPIN", "avg_tone"), crisis_count=INT,
)
oracle(
    "panic_score",
    """select *, (votes_negative + votes_toxic) / (votes_positive + votes_negative + 1) as panic_score from (
         select user_id, cast(ts as date) as date, count(*) filter (event_type = 'purchase') as votes_positive,
                count(*) filter (event_type = 'error') as votes_negative,
                count(*) filter (event_type = 'signup') as votes_toxic
         from events group by all)""",
    user_id=INT, date=DAY, votes_positive=INT, votes_negative=INT, votes_toxic=INT, panic_score=NUM,
)
oracle(
    "doc_sentiment", "select *, (pos - neg) / (pos + neg + 1) as score from texts ",
    doc_id=INT, asset=EXACT, pos=INT, neg=INT, score=NUM,
)
oracle(
    "doc_sentiment_lexicon",
    """select d.doc_id, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg,
              (coalesce(pos, 0) - coalesce(neg, 0)) / (coalesce(pos, 0) + coalesce(neg, 0) + 1) as score
       from documents d left join lexicon_hits h on h.doc_id = d.doc_id""",
    doc_id=INT, pos=INT, neg=INT, score=NUM,
)
oracle("doc_sentiment_sql", "select doc_id, (pos - neg) / (pos + neg + 1) as score from texts ", doc_id=INT, score=NUM)
oracle(
    "last_known_ticks",
    """select symbol, tick_id, last_value(price ignore nulls) over w as price, last_value(qty ignore nulls) over w as qty
       from gappy window w as (partition by symbol order by ts, tick_id rows unbounded preceding)""",
    symbol=EXACT, tick_id=INT, price=EXACT, qty=EXACT,
)
oracle(
    "asof_quotes",
    """select trade_id, d.user_id, case when young then event_id end as asof_event_id,
              case when young then quote end as asof_quote, case when young then q_ts end as asof_ts
       from (select d.*, q.event_id, q.quote, q.ts as q_ts, q.ts + interval 3 days >= d.ts as young
             from deals d asof left join quotes q on d.user_id = q.user_id and d.ts >= q.ts) d""",
    trade_id=INT, user_id=INT, asof_event_id=INT, asof_quote=EXACT, asof_ts=TIME,
)
oracle(
    "asof_quotes_cut",
    """select trade_id, d.user_id % 2 as desk, price, event_id as asof_event_id, quote as asof_quote
       from deals d asof left join quotes q on d.user_id % 2 = q.user_id % 2 and d.ts >= q.ts""",
    trade_id=INT, desk=INT, price=EXACT, asof_event_id=INT, asof_quote=EXACT,
)
oracle(
    "book_levels_sampled", "select * from best where level < 10",
    symbol=EXACT, timestamp=TIME, side=EXACT, level=INT, price=EXACT, quantity=EXACT,
)
oracle(
    "book_summary_sampled",
    """select *, best_ask - best_bid as spread, (bid_qty - ask_qty) / nullif(bid_qty + ask_qty, 0) as imbalance from (
         select symbol, timestamp, coalesce(sum(quantity) filter (side = 'bid'), 0.0) as bid_qty,
                coalesce(sum(quantity) filter (side = 'ask'), 0.0) as ask_qty,
                max(price) filter (side = 'bid') as best_bid, min(price) filter (side = 'ask') as best_ask, count(*) as n_levels
         from best where level < 20 group by 1, 2)""",
    symbol=EXACT, timestamp=TIME, n_levels=INT, **_num("bid_qty", "ask_qty", "best_bid", "best_ask", "spread", "imbalance"),
)
oracle(
    "sentiment_daily",
    "select asset, date, avg((pos - neg) / (pos + neg + 1)) as sentiment, count(*) as texts from texts group by 1, 2",
    asset=EXACT, date=DAY, sentiment=NUM, texts=INT,
)

oracle("klines_normalize", f"select *, {_LOG_RET} from bars", **_BAR, log_ret=NUM)
oracle(
    "agg_trades_normalize",
    """select symbol, tick_id as agg_trade_id, price, qty, tick_id * 2 as first_trade_id, tick_id * 2 + 1 as last_trade_id,
       ts as timestamp, is_buyer_maker from ticks""",
    symbol=EXACT, agg_trade_id=INT, price=EXACT, qty=EXACT, first_trade_id=INT, last_trade_id=INT, timestamp=TIME,
    is_buyer_maker=INT,
)
oracle(
    "depth_flatten",
    """select symbol, side, level, count(*) as quotes, min(price) as min_price, max(price) as max_price,
       sum(quantity) as quantity from levels group by 1, 2, 3""",
    symbol=EXACT, side=EXACT, level=INT, quotes=INT, **_num("min_price", "max_price", "quantity"),
)


def _book(levels: int) -> str:
    return f"""select *, (bid_qty - ask_qty) / (bid_qty + ask_qty) as imbalance from (
       select symbol, timestamp, list_sum(list_transform(range({levels}), lambda j: (k + j) % 7 + 1)) as bid_qty,
              list_sum(list_transform(range({levels}), lambda j: (k * (j + 1)) % 11 + 1)) as ask_qty from books)"""


_IMBALANCE = {"symbol": EXACT, "timestamp": TIME, **_num("bid_qty", "ask_qty", "imbalance")}
oracle("depth_imbalance", _book(20), **_IMBALANCE)
oracle("book_imbalance_top5", _book(5), **_IMBALANCE)
oracle("stream_book_imbalance", _book(20), **_IMBALANCE)
oracle(
    "vol_index_normalize",
    """select o_orderkey, o_orderdate as timestamp, o_totalprice as open, o_totalprice + 2 as high,
       o_totalprice - 1 as low, o_totalprice + 1 as dvol_close from orders""",
    o_orderkey=INT, timestamp=TIME, **_num("open", "high", "low", "dvol_close"),
)
oracle(
    "option_chain_flatten",
    """select concat(side, '-', p_partkey) as instrument_name,
       case when p_partkey % 5 <> 0 then cast(p_size as double) end as mark_iv, p_retailprice / 1000 as mark_price,
       p_retailprice as underlying_price, timestamp '2024-01-31 00:00:00' as timestamp
       from part, (select unnest(['C', 'P']) as side)""",
    instrument_name=EXACT, **_num("mark_iv", "mark_price", "underlying_price"), timestamp=TIME,
)
oracle(
    "daily_ohlcv_normalize",
    "select symbol as ticker, b.*, close as adj_close, ret as log_ret from daily_bars b join returns using (symbol, date)",
    ticker=EXACT, date=DAY, **_num("open", "high", "low", "close", "adj_close", "log_ret"),
)
oracle(
    "crypto_news_flatten",
    """select *, (votes_negative + votes_toxic) / (votes_positive + votes_negative + 1) as panic_score from (
         select event_id as id, ts as published_at, concat(event_type, ' ', user_id) as title,
                unnest(['BTC', 'ETH']) as currencies, concat(event_type, '.example') as source_domain,
                case event_type when 'click' then 0 else cast(json_extract_string(props, '$.k') as bigint) end as votes_positive,
                case event_type when 'click' then 0 else user_id % 5 end as votes_negative,
                0 as votes_important, 0 as votes_liked, 0 as votes_disliked, 0 as votes_lol,
                case when event_type in ('click', 'view') then 0 else user_id % 3 end as votes_toxic, 'news' as kind
         from events)""",
    id=INT, published_at=TIME, title=EXACT, currencies=EXACT, source_domain=EXACT,
    **{f"votes_{v}": INT for v in ("positive", "negative", "important", "liked", "disliked", "lol", "toxic")},
    kind=EXACT, panic_score=NUM,
)
oracle(
    "news_flatten",
    """select upper(event_type) as asset, ts as published_at, concat('s', user_id) as source_name,
       concat(event_type, ' ', j) as title, case when k % 2 = 0 then 'about' end as description,
       concat('u/', event_id, '/', j) as url, cast(null as varchar) as author
       from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
            (select unnest([0, 1]) as j) where j < k % 3""",
    asset=EXACT, published_at=TIME, source_name=EXACT, title=EXACT, description=EXACT, url=EXACT, author=EXACT,
)
oracle(
    "equity_fear_greed",
    "select o_totalprice / 5000 as value, lower(o_orderpriority) as value_classification, o_orderdate as date from orders",
    value=NUM, value_classification=EXACT, date=TIME,
)
oracle(
    "crypto_fear_greed",
    """select k as value, event_type as value_classification, cast(cast(floor(epoch(ts)) as bigint) as varchar) as timestamp,
       case when k > 90 then cast(event_id as varchar) end as time_until_update, ts as date
       from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)""",
    value=NUM, value_classification=EXACT, timestamp=EXACT, time_until_update=EXACT, date=TIME,
)
oracle(
    "stored_bars_range",
    "select * from bars where open_time >= '2024-01-10 00:00:00' and open_time < '2024-01-20 00:00:00'",
    symbol=EXACT, open_time=TIME, close=EXACT, volume=EXACT,
)


def _profile(file: str, source: str, frequency: str, table: str, columns: list[str], span: str | None) -> list[str]:
    covered = (
        f"strftime(min({span}), '%Y-%m-%dT%H:%M:%S') as date_from, strftime(max({span}), '%Y-%m-%dT%H:%M:%S') as date_to"
        if span else "'Unknown' as date_from, 'Unknown' as date_to"
    )
    return [
        f"""select '{file}' as file, '{source}' as source, '{frequency}' as frequency, {covered}, count(*) as rows,
            'OK' as status, '{c}' as "column", (count(*) - count({c})) / count(*) as missing_pct from {table} """
        for c in columns
    ]


_PROFILES = " union all ".join(
    _profile(
        "raw/lineitem", "given", "1d", "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
         "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"], "l_shipdate",
    )
    + _profile("raw/documents", "given", "", "documents", ["doc_id", "text", "lang", "source", "n_chars"], None)
    + _profile("rv/history", "computed", "1d", "trades_har", ["symbol", "date", "RV", "RV_d", "RV_w", "RV_m"], "date")
)
oracle(
    "profile_table", _PROFILES, file=EXACT, source=EXACT, frequency=EXACT, date_from=EXACT, date_to=EXACT, rows=INT,
    status=EXACT, column=EXACT, missing_pct=NUM,
)
oracle(
    "profile_while_writing",
    " union all ".join(
        _profile("rv/history", "computed", "1d", "trades_har", ["symbol", "date", "RV", "RV_d", "RV_w", "RV_m"], "date")
    ),
    file=EXACT, source=EXACT, frequency=EXACT, date_from=EXACT, date_to=EXACT, rows=INT, status=EXACT, column=EXACT, missing_pct=NUM,
)
oracle(
    "quality_report",
    f"""select string_split(file, '/')[2] as file, max(rows) as rows, max(status) as status,
        max(missing_pct) * 100 as worst_missing_pct from ({_PROFILES}) group by 1""",
    file=EXACT, rows=INT, status=EXACT, worst_missing_pct=NUM,
)
oracle(
    "landed_document_counts",
    "select symbol, count(*) as documents, count(*) filter (tick_id % 7 = 0) as malformed from ticks group by symbol",
    symbol=EXACT, documents=INT, malformed=INT,
)
oracle(
    "manifest_readback",
    """select 'documents.parquet' as file, count(*) as rows, 5 as n_columns, 'OK' as status, 0 as has_error from documents
       union all select 'absent.parquet', null, null, 'FAILED', 1""",
    file=EXACT, rows=INT, n_columns=INT, status=EXACT, has_error=INT,
)
oracle(
    "bars_with_empty_history", "select symbol, open_time, close from bars ",
    symbol=EXACT, open_time=TIME, close=EXACT,
)
oracle(
    "schema_enforce",
    """select event_id, try_cast(k as bigint) as k, try_cast(value as double) as value, try_cast(ts as timestamp) as ts
       from raw_text """,
    event_id=INT, k=INT, value=NUM, ts=TIME,
)
oracle(
    "schema_bad_cells",
    """select unnest(['k', 'value', 'ts']) as "column", unnest([
         count(*) filter (k is not null and try_cast(k as bigint) is null),
         count(*) filter (value is not null and try_cast(value as double) is null),
         count(*) filter (ts is not null and try_cast(ts as timestamp) is null)]) as bad_cells from raw_text """,
    column=EXACT, bad_cells=INT,
)

oracle("har_fit", "select * from fit ", symbol=EXACT, n=INT, **_num("b_0", "b_RV_d", "b_RV_w", "b_RV_m", "r2"))
oracle("har_forecast", """select h.symbol, h.date, h.log_RV, f.pred_log_RV, f.pred_RV, f.resid
       from trades_har h left join forecasts f using (symbol, date)""", **_KEY, **_num("log_RV", "pred_log_RV", "pred_RV", "resid"))
_SIX = ", ".join(f"round({c}, 6) as {c}" for c in ("b_0", "b_RV_d", "b_RV_w", "b_RV_m", "pred_log_RV"))
for _name in ("expanding", "rolling"):
    oracle(
        f"har_forecast_{_name}", f"select symbol, date, n, {_SIX} from {_name}_forecasts ",
        **_KEY, n=INT, **dict.fromkeys(("b_0", "b_RV_d", "b_RV_w", "b_RV_m", "pred_log_RV"), EXACT),
    )
oracle(
    "forecast_quantiles",
    """select symbol, date, pred_log_RV + p10 as q10, pred_log_RV + p50 as q50, pred_log_RV + p90 as q90
       from forecasts join (select symbol, quantile_cont(resid, 0.1) as p10, quantile_cont(resid, 0.5) as p50,
            quantile_cont(resid, 0.9) as p90 from forecasts group by symbol) using (symbol)""",
    **_KEY, **_num("q10", "q50", "q90"),
)


# The confidence set: draws from the same digests, the elimination as one step per model.
_MODELS, _REPLICATES, _BLOCK = ("har", "last", "week", "month"), 200, 20
_PREDICTED = dict(zip(_MODELS, ("pred_log_RV", "RV_d", "RV_w", "RV_m")))
CTE["losses"] = " union all ".join(
    f"select symbol, date, '{m}' as model, pow(log_RV - {p}, 2) as loss from forecasts where log_RV is not null "
    for m, p in _PREDICTED.items()
)
CTE["places"] = """
  select *, row_number() over (partition by symbol, model order by date) - 1 as at,
         count(*) over (partition by symbol, model) as n from losses """
CTE["draws"] = f"""
  select symbol, n, r, cast('0x' || substr(md5(concat('1|', symbol, '|', r, '|', b)), 1, 12) as bigint) % n as start
  from (select symbol, n, r, unnest(range(cast(ceil(n / {_BLOCK}) as bigint))) as b
        from (select distinct symbol, n, unnest(range({_REPLICATES})) as r from places))"""
CTE["boots"] = f"""
  select d.symbol, d.r, p.model, sum(p.loss) / (ceil(d.n / {_BLOCK}) * {_BLOCK}) as boot
  from (select symbol, n, r, (start + unnest(range({_BLOCK}))) % n as at, n as size from draws) d
  join places p on p.symbol = d.symbol and p.at = d.at group by d.symbol, d.r, d.n, p.model"""
CTE["left1"] = "select symbol, model, avg(loss) as mean from losses group by symbol, model"
for _k in range(1, len(_MODELS)):
    CTE[f"noise{_k}"] = f"""
  select *, e - avg(e) over (partition by symbol, r) as z
  from (select b.symbol, b.r, b.model, b.boot - l.mean as e from boots b join left{_k} l using (symbol, model))"""
    CTE[f"score{_k}"] = f"""
  select symbol, model, sd, mean, (mean - avg(mean) over (partition by symbol)) / sd as t
  from left{_k} join (select symbol, model, sqrt(avg(z * z)) as sd from noise{_k} group by all) using (symbol, model)"""
    CTE[f"worst{_k}"] = f"select symbol, arg_max(model, t) as model, max(t) as top from score{_k} group by symbol"
    CTE[f"step{_k}"] = f"""
  select symbol, w.model, avg(case when high >= top then 1.0 else 0.0 end) as p
  from (select symbol, r, max(z / sd) as high from noise{_k} join score{_k} using (symbol, model) group by symbol, r)
  join worst{_k} w using (symbol) group by symbol, w.model"""
    CTE[f"left{_k + 1}"] = f"select l.* from left{_k} l anti join worst{_k} w on l.symbol = w.symbol and l.model = w.model"
_STEPS = " union all ".join(
    [f"select symbol, model, p, {k} as eliminated from step{k} " for k in range(1, len(_MODELS))]
    + [f"select symbol, model, 1.0 as p, {len(_MODELS)} as eliminated from left{len(_MODELS)} "]
)
oracle(
    "confidence_set",
    f"""select *, p_value >= 0.05 as in_set from (
         select s.symbol, s.model, l.mean as mean_loss, eliminated,
                max(p) over (partition by s.symbol order by eliminated) as p_value
         from ({_STEPS}) s join left1 l on l.symbol = s.symbol and l.model = s.model)""",
    symbol=EXACT, model=EXACT, eliminated=INT, in_set=INT, **_num("mean_loss", "p_value"),
)


def _dm(diff: str, horizon: int) -> str:
    lags = "".join(
        f", lag(e, {k}) over (partition by symbol order by date) as e{k}" for k in range(1, horizon)
    )
    spectrum = " + ".join(["sum(e * e)"] + [f"2 * coalesce(sum(e * e{k}), 0)" for k in range(1, horizon)])
    z = "-abs(dm_stat)"
    return f"""select *, 2 * ({_phi(f'({z})')}) as p_value from (
      select symbol, count(*) as n, avg(d) as mean_diff,
             avg(d) / sqrt(case when {spectrum} > 0 then ({spectrum}) / count(*) / count(*) end) as dm_stat
      from (select *{lags} from (
        select *, d - avg(d) over (partition by symbol) as e from (
          select symbol, date, {diff} as d from forecasts ) where d is not null)) group by symbol)"""


_DM = {"symbol": EXACT, "n": INT, **_num("mean_diff", "dm_stat", "p_value")}
oracle(
    "dm_test_rolling",
    _dm("pow(log_RV - pred_log_RV, 2) - pow(log_RV - RV_d, 2)", 5).replace("from forecasts ", "from expanding_forecasts "), **_DM,
)
oracle("dm_test", _dm("pow(log_RV - pred_log_RV, 2) - pow(log_RV - RV_d, 2)", 5), **_DM)
oracle(
    "dm_test_qlike",
    _dm("(RV / pred_RV - ln(nullif(RV, 0) / pred_RV)) - (RV / exp(RV_d) - ln(nullif(RV, 0) / exp(RV_d)))", 1), **_DM,
)
oracle(
    "position_size", "select symbol, date, pred_RV, 0.25 * 0.02 / sqrt(pred_RV) as weight from forecasts ",
    **_KEY, **_num("pred_RV", "weight"),
)
oracle("net_returns", "select * from net ", **_KEY, **_num("weight", "gross_ret", "cost", "net_ret"))
oracle(
    "strategy_summary",
    """select symbol, count(net_ret) as days, avg(net_ret) as mean_ret, stddev_samp(net_ret) as std_ret,
       avg(net_ret) / stddev_samp(net_ret) * sqrt(365) as sharpe,
       count(*) filter (net_ret > 0) / count(net_ret) as hit_rate from net group by symbol""",
    symbol=EXACT, days=INT, **_num("mean_ret", "std_ret", "sharpe", "hit_rate"),
)
oracle(
    "har_forecast_oos",
    """select h.symbol, h.date, h.log_RV, f.pred_log_RV, f.pred_RV, f.resid
       from trades_har h left join forecasts_oos f using (symbol, date)""",
    **_KEY, **_num("log_RV", "pred_log_RV", "pred_RV", "resid"),
)
oracle(
    "strategy_summary_oos",
    """select symbol, count(net_ret) as days, avg(net_ret) as mean_ret, stddev_samp(net_ret) as std_ret,
       avg(net_ret) / stddev_samp(net_ret) * sqrt(365) as sharpe,
       count(*) filter (net_ret > 0) / count(net_ret) as hit_rate from net_oos group by symbol""",
    symbol=EXACT, days=INT, **_num("mean_ret", "std_ret", "sharpe", "hit_rate"),
)
oracle(
    "stress_regime",
    """select *, case when value > trailing_mean then 'High' when value <= trailing_mean then 'Low' end as regime from (
         select *, avg(value) over (partition by series order by date rows between 252 preceding and 1 preceding)
                as trailing_mean from panel)""",
    series=EXACT, date=DAY, value=NUM, trailing_mean=NUM, regime=EXACT,
)
oracle(
    "vrp",
    """select h.symbol, h.date, value / 5000 as dvol_close, RV * 365 as RV_ann,
       pow(value / 5000 / 100, 2) - RV * 365 as vrp
       from trades_rv h join panel p on p.date = h.date and p.series = '1-URGENT'""",
    **_KEY, **_num("dvol_close", "RV_ann", "vrp"),
)
CTE["closed_bars"] = """
  select * from bars where open_time + interval 1 hour <= (select max(ts) - interval 10 minutes from events)"""
CTE |= _vpin("cv", "closed_bars", "open_time", "", "close", "volume", "500.0")
for _name in ("stream_vpin", "stream_vpin_keyed"):
    oracle(
        _name,
        """select * from cv_scored s where bucket < (select max(bucket) from cv_scored l where l.symbol = s.symbol)""",
        symbol=EXACT, bucket=INT, timestamp=TIME, **_num("dP", "V_total", "sigma_dP", "V_buy", "V_sell", "VPIN"),
    )
for _name in ("stream_bars", "stream_bars_redelivered"):
    oracle(_name, "select *, '1 hour' as interval from closed_bars ", **_BAR, interval=EXACT)
