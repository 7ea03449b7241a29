"""Stored tables: typed Parquet scans and skew-aware overwrites."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import known
from ..session import stored

# Where the histories begin.
START = {
    "bars": "2019-01-01",
    "agg_trades": "2024-01-01",
    "daily_bars": "2015-01-01",
    "macro": "2015-01-01",
    "vol_index": "2021-01-01",
}

# The macro series ids that name the columns of the macro panel.
MACRO_SERIES = (
    "VIXCLS", "VXNCLS", "OVXCLS", "GVZCLS", "BAMLH0A0HYM2", "BAMLC0A0CM", "TEDRATE", "T10Y2Y", "T10Y3M",
    "DPCREDIT", "DCOILWTICO", "GOLDAMGBD228NLBM", "DTWEXBGS", "DFF", "CPIAUCSL", "UNRATE", "USREC", "M2SL",
    "INDIRLTLT01STM", "INDCPIALLMINMEI",
)

# The search-interest columns.
SEARCH_TERMS = (
    "BTC_bitcoin_crash", "BTC_crypto_fear", "SPX_stock_market_crash", "SPX_recession", "NIFTY_nifty",
)


def read_table(
    spark: SparkSession,
    path: str,
    schema: str,
    time: str | None = None,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Scan with a declared schema; no file gives an empty frame of that schema.

    NaN becomes NULL on the way in. The time bounds (until is exclusive) are plain
    comparisons on the stored column, so they reach the Parquet reader.
    """
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if time and since:
        df = df.where(F.col(time) >= F.lit(since).cast(df.schema[time].dataType))
    if time and until:
        df = df.where(F.col(time) < F.lit(until).cast(df.schema[time].dataType))
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: known(c) for c in floats}) if floats else df


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("symbol",),
    time: str | None = None,
    metrics: tuple[Observation, Sequence[Column]] | None = None,
) -> None:
    """Overwrite the series that ``df`` has in a Parquet table, one folder per series.

    Other series of the table stay as they are; a table without series is replaced.

    The rebalance hint gathers a series' rows into few files, and lets adaptive
    execution split a series that is too large for one task. With ``time`` the rows of a
    file are in time order, so that a time range skips row groups by their statistics.
    ``metrics`` are aggregates that are gathered from the rows as they are written.
    """
    keys = [c for c in partition_by if c in df.columns]
    gathered = df.hint("rebalance", *keys)
    if time:
        gathered = gathered.sortWithinPartitions(*keys, time)
    if metrics:
        gathered = gathered.observe(metrics[0], *metrics[1])
    writer = gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if keys else "static")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


MONTH = "month"


def read_history(
    spark: SparkSession, dataset: str, path: str, schema: str, time: str, since: str | None = None, until: str | None = None
) -> DataFrame:
    """A stored history kept by ``merge_rows``, from the first day of its kind (``START``) unless ``since`` says otherwise.

    Bounds reach the folders of months as well as the rows in them.
    """
    since = since or START[dataset]
    names = T.StructType.fromDDL(schema).names
    rows = read_table(spark, path, f"{schema}, {MONTH} string", time, since, until).where(F.col(MONTH) >= since[:7])
    return (rows.where(F.col(MONTH) <= until[:7]) if until else rows).select(*names)


def merge_rows(
    new: DataFrame, path: str, key: Sequence[str] = ("symbol", "open_time"), time: str = "open_time", by: Sequence[str] = ("symbol",),
    order: Sequence[str] = (),
) -> DataFrame:
    """Bring new and corrected rows into a table of one folder for each (series, month); returns the months touched.

    A row replaces the stored one of its key. Of several new rows of one key the last by
    ``order`` counts, else the largest. Only months that new rows fall into are read and
    written again; every other file stays as it is. A row without a time is left out.

    Stored rows are found by a join on the folders' names, which Spark prunes by, and the
    merged months are first written aside: what is read is never what is being replaced.
    """
    spark = new.sparkSession
    month = F.date_format(time, "yyyy-MM")
    fresh = stored(new.where(F.col(time).isNotNull()).withColumn(MONTH, month), "merge-new")
    parts = [*by, MONTH]
    touched = stored(fresh.select(*parts).distinct(), "merge-months")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema)
    old = read_table(spark, path, types)
    same = reduce(and_, [F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in parts])
    kept = old.alias("o").join(touched.alias("t"), same, "left_semi").select(*fresh.columns)
    rank = lambda df, n: df.withColumn("_rank", F.struct(F.lit(n), *order, F.struct(*new.columns)))
    names = [*dict.fromkeys([*parts, *key])]
    others = [c for c in fresh.columns if c not in names]
    one = rank(kept, 0).unionByName(rank(fresh, 1)).groupBy(*names).agg(F.max_by(F.struct(*others), "_rank").alias("_row"))
    merged = stored(one.select(*names, "_row.*").select(*fresh.columns), "merge-rows")
    write_table(merged, path, parts, time)
    return touched


# Names of the tie-breakers that ``with_row_position`` adds.
ROW_POSITION = ("_file", "_row")


def with_row_position(scan: DataFrame) -> DataFrame:
    """Add where each row is stored, as a last tie-breaker for ordered jobs.

    Exact copies of a row have no order of their own. With the position in ``ties`` they
    get one that every recomputation repeats, and a day full of copies can still be cut.
    Takes a frame straight from a Parquet scan.
    """
    return scan.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
