"""Dataset profiles (the manifest), a quality report, and tolerant schema enforcement."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import write_table

# The columns that may hold a dataset's time, in this order.
TIME_COLUMNS = ("date", "timestamp", "open_time")

PROFILE = (
    "file string, source string, asset string, frequency string, date_from string, date_to string, "
    "rows bigint, columns array<string>, missing_pct map<string,double>, status string, error string, "
    "pull_timestamp timestamp"
)


def _missing(field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _iso(c: Column, kind: T.DataType) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.DateType):
        return whole
    micros = F.date_format(c, "SSSSSS")
    text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return F.concat(text, F.lit("+00:00")) if isinstance(kind, T.TimestampType) else text


def profile(
    df: DataFrame,
    file: str,
    source: str = "",
    asset: str = "",
    frequency: str = "",
    time: str | None = None,
    status: str = "OK",
) -> DataFrame:
    """One row describing a dataset; one pass, folded before a shuffle of single rows.

    ``missing_pct`` holds fractions of 1. Without a known time column the coverage is
    "Unknown". An empty dataset is OK, with no coverage and no fractions.
    """
    time = time or _time_column(df)
    return _described(df.agg(*_metrics(df, time)), df.columns, time, file, source, asset, frequency, status)


def _time_column(df: DataFrame) -> str | None:
    return next((c for c in TIME_COLUMNS if c in df.columns), None)


def _metrics(df: DataFrame, time: str | None) -> list[Column]:
    """Aggregates that a profile is made of; coverage as text."""
    counts = [F.count_if(_missing(f)).alias(f"_m{i}") for i, f in enumerate(df.schema)]
    span = [_iso(f(time), df.schema[time].dataType).alias(n) for f, n in ((F.min, "_from"), (F.max, "_to"))] if time else []
    return [F.count(F.lit(1)).alias("rows"), *counts, *span]


def _described(
    stats: DataFrame, columns: list[str], time: str | None, file: str, source: str, asset: str, frequency: str, status: str
) -> DataFrame:
    filled = F.col("rows") > 0
    date_from, date_to = (F.col("_from"), F.col("_to")) if time else (F.lit("Unknown"), F.lit("Unknown"))
    fractions = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]),
        F.array(*[F.try_divide(F.col(f"_m{i}"), F.col("rows")) for i in range(len(columns))]),
    )
    none = F.create_map().cast("map<string,double>")
    return stats.select(
        F.lit(file).alias("file"),
        F.lit(source).alias("source"),
        F.lit(asset).alias("asset"),
        F.lit(frequency).alias("frequency"),
        F.when(filled, date_from).alias("date_from"),
        F.when(filled, date_to).alias("date_to"),
        "rows",
        F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("columns"),
        F.when(filled, fractions).otherwise(none).alias("missing_pct"),
        F.lit(status).alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.current_timestamp().alias("pull_timestamp"),
    )


def write_profiled(
    df: DataFrame,
    path: str,
    source: str = "",
    asset: str = "",
    frequency: str = "",
    time: str | None = None,
    partition_by: Sequence[str] = ("symbol",),
    file: str | None = None,
) -> DataFrame:
    """Write a table and describe it, in one pass: the profile of what this call wrote.

    The counts are gathered by the tasks that write the files, so the dataset is computed
    once and not scanned again. A dataset without rows is OK and has no coverage.
    """
    time = time or _time_column(df)
    seen = Observation()
    write_table(df, path, partition_by, time, metrics=(seen, _metrics(df, time)))
    counts = seen.get
    # An empty table may be written without a task that could count.
    values = {f.name: F.lit(counts.get(f.name)).cast(f.dataType) for f in df.limit(0).agg(*_metrics(df, time)).schema}
    values["rows"] = F.coalesce(values["rows"], F.lit(0).cast("bigint"))
    stats = df.sparkSession.range(1).select(*[c.alias(n) for n, c in values.items()])
    return _described(stats, df.columns, time, file or path, source, asset, frequency, "OK")


def profile_files(spark: SparkSession, entries: Iterable[Mapping[str, str]]) -> DataFrame:
    """Profiles of stored datasets; one that cannot be read gives a FAILED row."""
    out = None
    for entry in entries:
        try:
            one = profile(spark.read.parquet(entry["file"]), **entry)
        except PySparkException as e:
            named = {k: F.lit(entry.get(k)) for k in ("file", "source", "asset", "frequency")}
            named |= {"status": F.lit("FAILED"), "error": F.lit(str(e)), "pull_timestamp": F.current_timestamp()}
            shape = spark.createDataFrame([], PROFILE).schema
            one = spark.range(1).select(
                *[named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape]
            )
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], PROFILE) if out is None else out


def quality_report(profiles: DataFrame) -> DataFrame:
    """File, rows, status and the worst column's missing share in percent."""
    worst = F.array_max(F.map_values("missing_pct")) * 100
    return profiles.select(
        F.element_at(F.split("file", "/"), -1).alias("file"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "status",
        F.coalesce(worst, F.lit(0.0)).alias("worst_missing_pct"),
    )


def write_manifest(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").json(path)


# The type names that a schema may use.
_CASTS = {"datetime": "timestamp", "float": "double", "int": "bigint"}


def enforce_schema(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Cast columns to 'datetime', 'float' or 'int'; unknown names are skipped.

    A cell that does not parse becomes NULL; ``bad_cells`` counts those.
    """
    return df.withColumns(
        {c: F.col(c).try_cast(_CASTS[kind]) for c, kind in schema.items() if c in df.columns}
    )


def bad_cells(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Per enforced column: how many cells are present but do not parse."""
    known = {c: k for c, k in schema.items() if c in df.columns}
    counts = df.agg(
        *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(_CASTS[k]).isNull()).alias(c) for c, k in known.items()]
    )
    return counts.unpivot([], list(known), "column", "bad_cells")
