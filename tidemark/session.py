"""Session settings that the results depend on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Results depend on these two; everything else is tuning and is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def pin(spark: SparkSession) -> SparkSession:
    """Set the options that change results (time zone, ANSI) on an existing session."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        # Recording the Python call site of every expression slows down building a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**REQUIRED, **TUNING}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Paths handed out inside each open ``scratch``, the innermost last.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may go
    without: there one machine is the whole cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="tidemark-")
    path = f"{root.rstrip('/')}/tidemark/{purpose}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was written to the shared folder inside.

    For a job whose result has been written elsewhere by then: frames made inside read
    files that are gone afterwards.
    """
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for written in _scopes.pop():
            path = hadoop.Path(written)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    For a frame that several later steps read: it is computed once, and a lost executor
    costs a file read instead of the whole lineage.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
