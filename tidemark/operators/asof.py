"""Last known values along series of any length, and the as-of match of two tick streams.

Both are one ordered scan (``scan.carry_scan``): a segment is reduced to its last known
value, a window over those few rows tells each segment what was known before it, and the
rows themselves are shuffled once. No join, no broadcast, and a series that holds a third
of all rows is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import with_day
from .scan import SEGMENT_ROWS, carry_scan, settle


def last_known(
    rows: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("symbol",),
    time: str = "ts",
    ties: Sequence[str] = (),
    max_age: str | None = None,
    segment_rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """The rows with NULLs of ``columns`` replaced by the column's last value before.

    Columns are filled each for itself; leading gaps stay NULL. ``max_age`` (an interval
    such as "5 minutes") leaves gaps to which the last value is older. A row without a
    time is left out; series without a name are one series.
    """
    seen = {f"_known_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("at"), F.col(c).alias("value"))) for c in columns}
    scanned = settle(carry_scan(with_day(rows, time, "_day"), by, "_day", [time, *ties], latest=seen, segment_rows=segment_rows))
    kept = {c: _young(F.col(f"_known_{c}"), F.col(time), max_age)["value"] for c in columns}
    return scanned.withColumns(kept).select(*rows.columns)


def asof_match(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    by: Sequence[str] = ("symbol",),
    time: str = "ts",
    right_ties: Sequence[str] = (),
    max_age: str | None = None,
    same_time: bool = True,
    prefix: str = "asof_",
    segment_rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """Every row of ``left`` with ``values`` and the time of the latest row of ``right`` not after it.

    right_ties  columns of ``right`` that order its rows of one time: the last one counts
    max_age     an interval; what is older does not match
    same_time   whether a row of ``right`` of just this time counts as before

    A match holds its NULLs: a value that the latest row lacks is not looked for further
    back (``last_known`` does that). A row of ``left`` without a match stays, with NULLs;
    one without a time is left out. Series without a name match each other.
    """
    named = {c: f"{prefix}{c}" for c in (time, *values)}
    ties = [f"_tie{i}" for i in range(len(right_ties))]
    # On one time a row of the right side sorts before those of the left side, or after them.
    later = right.select(
        *by, time, F.lit(0 if same_time else 2).alias("_side"),
        *[F.col(c).alias(t) for c, t in zip(right_ties, ties)],
        F.struct(*[F.col(c).alias(n) for c, n in named.items()]).alias("_match"),
    )
    both = left.withColumn("_side", F.lit(1)).unionByName(later, allowMissingColumns=True)
    order = [time, "_side", *ties]
    scanned = carry_scan(
        with_day(both, time, "_day"), by, "_day", order, latest={"_known": F.col("_match")}, segment_rows=segment_rows
    )
    match = _young(F.col("_known"), F.col(time), max_age, named[time])
    return settle(scanned).where("_side = 1").withColumn("_known", match).select(*left.columns, "_known.*")


def _young(known: Column, now: Column, max_age: str | None, at: str = "at") -> Column:
    if max_age is None:
        return known
    return F.when(known[at] + F.expr(f"interval {max_age}") >= now, known)
