"""VPIN over a stream with keyed state: bars wait for the watermark, buckets live in state.

A symbol's state is its open bucket and cumulative volume (a value), the bars that the
watermark has not passed (a list), and the last closed buckets that rolling measures reach
back to (a list). An event-time timer wakes the symbol when the watermark passes its
newest bar; the bars up to the watermark are then taken in event-time order, so the order
in which files and rows arrive has no bearing on the result. After a restart the state
store goes on where the last completed micro-batch ended.

Spark gives keyed state to Python in Python workers only: a row crosses to one once, and every
state access is a message. A symbol is one task at a time, as its state is one object.
``vpin.drain_vpin`` has neither cost and cuts a long symbol into segments, but rewrites its
small state with each micro-batch; take this form where closed buckets have to follow bars
closely and a batch brings a symbol few of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.vpin import BUCKETS_PER_DAY, SIGMA_FLOOR, SIGMA_ROWS
from .jobs import drain_to_parquet
from .vpin import BUCKETS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "open_time timestamp, close double, volume double"
OPEN = "cum string, bucket bigint, first double, last double, V_total double, timestamp timestamp"
CLOSED = "dP double, gap double"
UNIT = Decimal("1e-8")  # volumes add up in these units, as decimal(38,8)


class VolumeBuckets(StatefulProcessor):
    """Bars of one symbol to its closed and scored volume buckets."""

    def __init__(self, v_star: float):
        self.v_star = v_star

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BAR)
        self.open = handle.getValueState("open", OPEN)
        self.closed = handle.getListState("closed", CLOSED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["open_time"], r["close"], r["volume"]) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(int(max(t for t, _, _ in new).timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        bars = sorted((tuple(b) for b in self.waiting.get()), key=lambda b: b[0])
        ready = [b for b in bars if int(b[0].timestamp() * 1000) <= passed]
        later = bars[len(ready) :]
        self.waiting.put(later) if later else self.waiting.clear()
        opened = tuple(self.open.get()) if self.open.exists() else None
        closed = [tuple(c) for c in self.closed.get()] if opened else []
        for bar in ready:
            opened, done = self._step(opened, bar)
            if done:
                row = self._scored(key[0], done, closed)
                closed = [*closed, (row["dP"], _gap(row))][-(SIGMA_ROWS + BUCKETS_PER_DAY) :]
                yield row
        if ready:
            self.open.update(opened)
            self.closed.put(closed) if closed else self.closed.clear()

    def close(self) -> None:
        pass

    def _step(self, opened: tuple | None, bar: tuple) -> tuple[tuple, tuple | None]:
        """(open bucket after a bar, the bucket that it closes)."""
        time, close, volume = bar
        amount = Decimal(repr(volume or 0.0)).quantize(UNIT, ROUND_HALF_UP)
        cum = (Decimal(opened[0]) if opened else Decimal(0)) + amount
        bucket = math.floor(float(cum) / self.v_star)
        if opened and opened[1] == bucket:
            known = [v for v in (opened[4], volume) if v is not None]
            return (str(cum), bucket, opened[2], close, sum(known) if known else None, time), None
        return (str(cum), bucket, close, close, volume, time), opened

    def _scored(self, symbol: str, done: tuple, closed: list[tuple]) -> Row:
        _, bucket, first, last, total, time = done
        change = last - first if None not in (first, last) else None
        changes = [d for d, _ in [*closed[-(SIGMA_ROWS - 1) :], (change, None)] if d is not None]
        sigma = buy = None
        if len(changes) > 1:
            mean = math.fsum(changes) / len(changes)
            sigma = math.sqrt(math.fsum((d - mean) ** 2 for d in changes) / (len(changes) - 1)) or SIGMA_FLOOR
        if None not in (sigma, total, change):
            buy = total * 0.5 * math.erfc(-change / sigma / math.sqrt(2))
        row = Row(
            symbol=symbol, bucket=bucket, timestamp=time, dP=change, V_total=total, sigma_dP=sigma,
            V_buy=buy, V_sell=None if buy is None else total - buy, VPIN=None,
        )
        gaps = [g for _, g in closed[-(BUCKETS_PER_DAY - 1) :]] + [_gap(row)]
        full = len(gaps) == BUCKETS_PER_DAY and None not in gaps
        return Row(**{**row.asDict(), "VPIN": math.fsum(gaps) / (BUCKETS_PER_DAY * self.v_star) if full else None})


def _gap(row: Row) -> float | None:
    return None if row["V_buy"] is None else abs(row["V_buy"] - row["V_sell"])


def keyed_vpin(bars: DataFrame, v_star: float, delay: str = "0 seconds") -> DataFrame:
    """The scored buckets of a stream of closed bars (symbol, open_time, close, volume), one row each.

    Bars may come in any order within ``delay``; later ones are dropped. A missing volume
    counts as none. Bars of one time and symbol have no order: give at most one.
    """
    narrow = bars.select("symbol", "open_time", "close", "volume").withWatermark("open_time", delay)
    return narrow.groupBy("symbol").transformWithState(VolumeBuckets(float(v_star)), BUCKETS, "append", "eventTime")


def drain_keyed_vpin(bars: DataFrame, path: str, checkpoint: str, v_star: float, delay: str = "0 seconds") -> dict[str, int]:
    """Score what is there, then stop; a rerun continues from the checkpoint. Sets the state store that lists need."""
    conf = bars.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS_DB)
    try:
        return drain_to_parquet(keyed_vpin(bars, v_star, delay), path, checkpoint)
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
