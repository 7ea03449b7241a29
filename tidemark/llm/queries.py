"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin
from . import (
    bpe,
    chat,
    clustering,
    decontaminate,
    exact_dedup,
    hard_negatives,
    licences,
    lm_score,
    mixing,
    simhash,
    token_counts,
    toxicity,
    url_filter,
)
from .text import if_small

TARGET_IDS = 1_000_000  # ids of target documents that are broadcast at most

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.where(~held_out("doc_id")), order=2)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_differences(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "difference",
        "peak",
    )


@query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scanned(docs, licences.build_index(docs), keep=["doc_id"])
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = bpe.encoded(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    back = bpe.decoded(ids, vocabulary)
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = F.lit("</s>[INST] ok [/INST]")
    pair = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.lit(-7).alias("conv_id"), F.explode(pair).alias("t"), odd.alias("text"))
    rows = rows.unionByName(extra.select("conv_id", "t.turn", "t.role", "text"))
    out = chat.formatted(rows.withColumn("parts", chat.text_part(F.col("text"))))
    lines = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n")))
    loss = chat.under_mask(F.col("formatted"), F.col("loss_mask"))
    out = out.withColumn("lines", lines).withColumn("loss", loss)
    return out.select(
        "conv_id",
        F.size("lines").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows, by a checksum of the id, are the snapshot, the others a batch that comes in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 2 == 0
    snapshot = exact_dedup.take_snapshot(docs.where(before))
    digests, groups = exact_dedup.duplicate_groups(docs.where(~before), snapshot)
    of = groups.select("digest", F.col("doc_id").alias("keep"), "n")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return digests.join(of, "digest", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("digest")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = token_counts.read_counter(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.counted(table(spark, sf_dir, "documents"), counter, keep=["doc_id"])


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def target_marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with ``target``: true for every one labelled with quality 1, else NULL."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    # Up to so many ids are sent to the texts; beyond, texts and ids are shuffled.
    return docs.join(if_small(good.withColumn("target", F.lit(True)), TARGET_IDS), "doc_id", "left")


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = lm_score.fit(target_marked(docs, table(spark, sf_dir, "labels")), F.col("target"))
    return lm_score.scored(docs, models, keep=["doc_id"], counted=True)


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_filter.mined(pages, table(spark, sf_dir, "labels"))
    return url_filter.judged(pages, rules).drop("url")


@query
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mixed(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


@query
def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertias and digests are one row for each cluster."""
    rows, centroids = clustering.clustered(table(spark, sf_dir, "embeddings"))
    sums = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())
    total = sum(sums.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    clusters = [(c, n, total, digest(c)) for c, n in sums.items()]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return rows.join(F.broadcast(spark.createDataFrame(clusters, schema)), "cluster")
