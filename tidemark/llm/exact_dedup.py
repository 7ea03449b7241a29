"""Exact dedup of a batch against immutable snapshots.

A snapshot holds the distinct digests of what was taken before, dealt into buckets, and
one static binary-fuse filter for each bucket. A batch first groups its own duplicates;
then the filter of a bucket screens the bucket's digests, and only positives join the
snapshot's exact entries. Groups that result are checked byte by byte.

Defined results: NULL counts as the empty text; of equal texts the row with the largest
id stays, a NULL id being smaller than any other; repeated rows (same id, same text) all
report the same ``keep_id`` and count one by one in ``group_size``, and ``deduplicated``
keeps one of them. Ids are whole numbers, or text that reads as one; any other text is an
error. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, stored
from .text import name, once, whole

# Digests to a bucket. A filter takes about nine bits a digest, so some KB; the number
# of buckets follows the number of digests.
BUCKET_KEYS = 4096
ENTRY = "digest binary, key bigint, doc_id bigint, n bigint, n_keep bigint"
FILTER = "bucket bigint, seed bigint, segment bigint, segments bigint, cells binary"


@dataclass(frozen=True)
class Snapshot:
    """Written once, never changed. ``docs`` are its rows, for byte checks."""

    path: str
    buckets: int
    docs: DataFrame
    entries: DataFrame
    filters: DataFrame


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def spots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells for each key, in neighbouring segments, and the 8 bits to be found there."""
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    low = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    cells = np.stack([
        first,
        (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low),
        (first + np.uint64(2 * segment)) ^ (h & low),
    ])
    return cells.astype(np.int64), ((h >> np.uint64(40)) ^ (h >> np.uint64(8))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A 3-wise binary-fuse filter of distinct keys: (seed, segment length, segments, cells).

    Cells with one key left are peeled round by round, all of a round at once; going back
    through the rounds sets each key's cell so that its three cells give its bits.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    segment = 1 << max(2, min(18, int(np.log(n) / np.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    segments = max(1, int(np.ceil(room / segment)))
    for seed in range(1, 1000):
        size = segment * (segments + 2)
        cells, bits = spots(keys, seed, segment, segments)
        count = np.bincount(cells.ravel(), minlength=size)
        mixed = np.zeros(size, np.int64)  # the xor of the indexes of the keys in a cell
        for row in cells:
            np.bitwise_xor.at(mixed, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            which, at = np.unique(mixed[single], return_index=True)
            rounds.append((which, single[at]))
            for row in cells[:, which]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(mixed, row, which)
            left -= len(which)
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for which, own in reversed(rounds):
            table[own] = 0
            a, b, c = table[cells[:, which]]
            table[own] = bits[which] ^ a ^ b ^ c
        return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed fits; are the keys distinct?")


def in_filter(keys: np.ndarray, seed: int, segment: int, segments: int, cells: bytes) -> np.ndarray:
    """True for each key of the filter and for about one in 256 others."""
    at, bits = spots(keys.astype(np.uint64), seed, segment, segments)
    a, b, c = np.frombuffer(cells, np.uint8)[at]
    return (a ^ b ^ c) == bits


def grouped(digests: DataFrame) -> DataFrame:
    """A row for each digest: largest id, rows, rows with that id. Folds before it shuffles."""
    by_id = digests.groupBy("digest", "doc_id").agg(F.count("*").alias("c"))
    return by_id.groupBy("digest").agg(
        F.max(F.struct("doc_id", "c")).alias("top"), F.sum("c").alias("n")
    ).select(
        "digest", F.xxhash64("digest").alias("key"), F.col("top.doc_id").cast("bigint").alias("doc_id"), "n",
        F.col("top.c").alias("n_keep"),
    )


def bucketed(entries: DataFrame, buckets: int) -> DataFrame:
    return entries.select(F.expr(f"pmod(key, {buckets}L)").alias("bucket"), "*")


def take_snapshot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Group the rows by digest, deal the digests into buckets and build their filters."""
    spark = docs.sparkSession
    narrow = docs.select(name(id_col).alias("doc_id"), whole(text_col).alias("text"))
    groups = stored(grouped(narrow.select("doc_id", sha256(F.col("text")).alias("digest"))), "snapshot")
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))
    path = shared_folder(spark, "snapshot-filters")

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        seed, segment, segments, cells = build_filter(keys)
        row = [table.column("bucket")[0].as_py(), seed, segment, segments, cells]
        kinds = [pa.int64()] * 4 + [pa.binary()]
        names = [c.split()[0] for c in FILTER.split(", ")]
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    entries = bucketed(groups, buckets)
    entries.select("bucket", "key").groupBy("bucket").applyInArrow(build, FILTER).write.parquet(path)
    return Snapshot(path, buckets, narrow, entries, spark.read.schema(FILTER).parquet(path))


def screened(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The groups of a batch that the snapshot's filters let through: all it holds, few others.

    A batch that is larger than its snapshot is dealt further: each bucket's filter, which
    is small, goes to several groups, so that none holds more than about ``BUCKET_KEYS``
    digests of the batch.
    """
    salts = max(1, -(-batch.count() // (BUCKET_KEYS * snapshot.buckets)))

    def screen(filters: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["bucket", "salt"])
        if not filters.num_rows or not rows.num_rows:
            return rows.slice(0, 0)
        f = filters.to_pylist()[0]
        keys = rows.column("key").to_numpy().view(np.uint64)
        return rows.filter(pa.array(in_filter(keys, f["seed"], f["segment"], f["segments"], f["cells"])))

    filters = snapshot.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = bucketed(batch, snapshot.buckets).withColumn("salt", F.expr(f"cast(pmod(xxhash64(digest), {salts}) as int)"))
    return (
        filters.groupBy("bucket", "salt")
        .cogroup(dealt.select("bucket", "salt", *batch.columns).groupBy("bucket", "salt"))
        .applyInArrow(screen, ENTRY)
    )


def merged(batch: DataFrame, snapshot: Snapshot | None) -> DataFrame:
    """All groups of two rows or more, over the batch and the snapshot."""
    groups = batch.where("n > 1").select("digest", "doc_id", "n", "n_keep")
    if snapshot is None:
        return groups
    positive = stored(screened(batch, snapshot), "screened").alias("p")
    old = snapshot.entries.alias("s")
    both = stored(
        positive.join(old, F.col("p.digest") == F.col("s.digest")).select(
            F.col("p.digest").alias("digest"),
            F.greatest("p.doc_id", "s.doc_id").alias("doc_id"),
            (F.col("p.n") + F.col("s.n")).alias("n"),
            (
                F.when(F.col("p.doc_id").eqNullSafe(F.greatest("p.doc_id", "s.doc_id")), F.col("p.n_keep")).otherwise(0)
                + F.when(F.col("s.doc_id").eqNullSafe(F.greatest("p.doc_id", "s.doc_id")), F.col("s.n_keep")).otherwise(0)
            ).alias("n_keep"),
        ),
        "merged",
    )
    apart = groups.unionByName(snapshot.entries.where("n > 1").select(*groups.columns))
    return both.unionByName(apart.join(both.select("digest"), "digest", "left_anti"))


def collisions(docs: DataFrame, digest: Column) -> DataFrame:
    """The byte check: digests whose texts are not all the same bytes.

    Smallest and largest text of a digest are equal if all are. They fold before the
    shuffle, so a text that a third of the rows share moves once for each task.
    """
    bounds = docs.groupBy(digest.alias("digest")).agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return bounds.where("low != high").select("digest")


def duplicate_groups(
    docs: DataFrame, snapshot: Snapshot | None = None, id_col: str = "doc_id", text_col: str = "text",
    digest=sha256,
) -> tuple[DataFrame, DataFrame]:
    """(digests, groups) of a batch and its snapshot.

    ``digests`` has doc_id and digest of every row, snapshot first; ``groups`` has
    digest, doc_id (the row that stays), n and n_keep of each group of two rows or more.
    Where different texts share a digest, the text's bytes join the digest, which keeps
    such texts apart whatever the digest function is.
    """
    batch = docs.select(name(id_col).alias("doc_id"), whole(text_col).alias("text"))
    every = batch if snapshot is None else snapshot.docs.unionByName(batch)
    mark = lambda df: df.select("doc_id", digest(F.col("text")).alias("digest"))
    clash = stored(collisions(every, digest(F.col("text"))), "collisions")
    if clash.isEmpty():
        digests = mark(batch)
        return (
            stored(digests if snapshot is None else mark(snapshot.docs).unionByName(digests), "digests"),
            stored(merged(stored(grouped(digests), "batch"), snapshot), "groups"),
        )
    apart = (
        every.withColumn("digest", digest(F.col("text")))
        .join(clash.withColumn("clash", F.lit(True)), "digest", "left")
        .select("doc_id", F.when(F.col("clash"), F.concat("digest", F.col("text").cast("binary"))).otherwise(F.col("digest")).alias("digest"))
    )
    digests = stored(apart, "digests")
    return digests, stored(grouped(digests).where("n > 1").drop("key"), "groups")


def survivors(rows: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those of ``rows`` that stay according to ``groups``, with all their columns; of repeated rows one."""
    keep = groups.select(
        F.col("digest").alias("_exact_digest"), F.col("doc_id").alias("_exact_keep"), F.col("n_keep").alias("_exact_n_keep")
    )
    marked = rows.withColumn("_exact_digest", sha256(whole(text_col))).join(keep, "_exact_digest", "left")
    stay = F.col("_exact_n_keep").isNull() | name(id_col).cast("bigint").eqNullSafe(F.col("_exact_keep"))
    again = F.coalesce(F.col("_exact_n_keep") > 1, F.lit(False))
    return once(marked.where(stay), again, "_exact_digest").select(*[name(c) for c in rows.columns])


def deduplicated(
    docs: DataFrame, snapshot: Snapshot | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of a batch that stay. Rows equal to a text in the snapshot go as well, unless their id is the largest."""
    return survivors(docs, duplicate_groups(docs, snapshot, id_col, text_col)[1], id_col, text_col)


def deduplicated_with(docs: DataFrame, early: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a table that stay, its ``early`` ones taken as the snapshot and the others as a batch."""
    snapshot = take_snapshot(docs.where(early), id_col, text_col)
    return survivors(docs, duplicate_groups(docs.where(~early), snapshot, id_col, text_col)[1], id_col, text_col)
