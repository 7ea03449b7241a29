"""Per-bar formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import LN2, col, log_ratio

# Fixed value: keeps a flat or empty bar from dividing by zero. It shows in the results
# (a flat bar with volume has an imbalance of nearly -1), so it must not change.
EPS = 1e-10


def buy_volume_proxy(high="high", low="low", close="close", volume="volume") -> Column:
    """The share of volume taken as buying: where the close lies in the bar's range."""
    high, low, close, volume = map(col, (high, low, close, volume))
    return volume * (close - low) / (high - low + EPS)


def bar_imbalance(buy: Column | str, volume: Column | str) -> Column:
    """(buy - sell) / (buy + sell), with sell the rest of the volume."""
    buy, volume = col(buy), col(volume)
    sell = volume - buy
    return (buy - sell) / (buy + sell + EPS)


def parkinson(high="high", low="low") -> Column:
    return F.pow(log_ratio(high, low), F.lit(2.0)) / (4 * LN2)


def garman_klass(open="open", high="high", low="low", close="close") -> Column:
    return 0.5 * F.pow(log_ratio(high, low), F.lit(2.0)) - (2 * LN2 - 1) * F.pow(
        log_ratio(close, open), F.lit(2.0)
    )
