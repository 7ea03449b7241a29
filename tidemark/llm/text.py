"""Shared by the operators: words, Arrow-batched columns, repeated rows."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words of most operators: runs of ASCII letters and digits and of everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Rows of whole texts that travel to Python at once, and that are worked on at once: a few MB.
ARROW_ROWS = 2000
WORK_ROWS = 500


def name(column: str) -> Column:
    return F.col(f"`{column}`")


def lower_ascii(c: Column) -> Column:
    """A-Z only; other capitals stay."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def whole(text: str) -> Column:
    """The text, with NULL as the empty one."""
    return F.coalesce(name(text), F.lit(""))


def column_of(df: DataFrame, *wanted: str) -> list[str]:
    """Those of ``wanted`` that the frame has, as it spells them."""
    have = {c.lower(): c for c in df.columns}
    return [have[w.lower()] for w in wanted if w.lower() in have]


def appended(
    df: DataFrame,
    text: Column,
    make: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]],
    outputs: str,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: all) and what ``make()``'s function makes of ``text``.

    ``make`` runs once in a task; its function gets a batch of texts and returns one
    array for each column of ``outputs``. A kept column of the same name is replaced.
    The kept columns travel in one struct, so no name of theirs can clash on the way.
    The session's Arrow batches are made small enough for texts.
    """
    small_batches(df)
    made = T.StructType.fromDDL(outputs)
    taken = {f.name.lower() for f in made}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    slim = df.select(F.struct(*[name(c) for c in kept] or [F.lit(0).alias("_none")]).alias("kept"), text.alias("text"))
    names = ["kept", *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, WORK_ROWS):
                part = batch.slice(at, WORK_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *work(part.column(1))], names=names)

    out = slim.mapInArrow(run, T.StructType([slim.schema["kept"], *made.fields]))
    return out.select(*[F.col("kept")[c].alias(c) for c in kept], *[name(c) for c in made.names])


def small_batches(df: DataFrame) -> None:
    """Let Arrow batches hold no more rows than suits whole texts; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))


def once(rows: DataFrame, repeated: Column, *keys: str) -> DataFrame:
    """Rows as they are, but of those marked ``repeated`` only one for each value of ``keys``.

    Repeated rows are rare; where there are none, nothing is shuffled for them.
    """
    if rows.where(repeated).select(F.lit(1)).isEmpty():
        return rows
    return rows.where(~repeated).unionByName(rows.where(repeated).dropDuplicates(list(keys)))


def if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """For the narrow side of a join: broadcast after its rows have been counted, else left to a shuffle.

    Takes a stored frame of a few plain columns, so 100,000 rows are a few MB. Both ways
    give the same rows.
    """
    return F.broadcast(df) if df.count() <= rows else df
