"""A corpus pipeline over the operators of ``tidemark.llm``.

Each stage takes the rows its predecessor kept and keeps all columns of documents; the
last one adds the token ids. ``run`` writes each stage's rows as Parquet to the shared
folder and goes on from there, so a lost executor costs a part of one stage.

NULL texts count as empty and doc_ids may be NULL or repeat: rows are told apart by id
and text, and of rows that repeat each other the second stage keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from tidemark.llm.queries import table, toxicity_model
from tidemark.session import pin, scratch, shared_folder

REJECT = 0.5  # toxicity score from which a document goes


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below ``REJECT``; the models learn from the labelled ones among them."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    names = [c for c in docs.columns]
    scored = toxicity.with_differences(docs.select(F.struct("*").alias("row"), "text"), model)
    return scored.where(F.col("score") < REJECT).select(*[F.col("row")[c].alias(c) for c in names])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; half of the rows are the snapshot that the others meet."""
    pin(spark)
    early = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 2 == 0
    return exact_dedup.deduplicated_with(docs, early)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked fingerprints the row with the smallest id."""
    pin(spark)
    return simhash.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``token_ids`` and whether they decode to the text again (``round_trip``)."""
    pin(spark)
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = bpe.encoded(docs, vocabulary, into="token_ids")
    back = bpe.decoded(ids, vocabulary, ids_col="token_ids", into="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return back.withColumn("round_trip", same).drop("decoded")


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("byte_bpe", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written; what it wrote on the way is deleted then."""
    docs = pin(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
