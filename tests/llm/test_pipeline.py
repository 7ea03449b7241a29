"""The pipeline against a brute-force version of each stage on that stage's own input."""

import brute
import public_tokenizers as public
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tidemark.llm import bpe, toxicity
from tidemark.llm.queries import toxicity_model


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages(spark, sf_dir, documents):
    columns, docs, kept = documents.columns, documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf_dir).cache()
        kept[name] = before, docs
        if name != "byte_bpe":
            assert docs.columns == columns and docs.count() <= before.count()

    before, after = kept["toxicity"]
    model = toxicity_model(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_differences(before, model)
    assert pairs(after) == pairs(scored.where(F.col("score") < 0.5))

    before, after = kept["exact_dedup"]
    best = {}
    for i, t in pairs(before):
        best[t] = max(i, best.get(t, i))
    assert pairs(after) == sorted((i, t) for t, i in best.items())

    before, after = kept["near_dedup"]
    rows = pairs(before)
    found = brute.classes([brute.fingerprint(t) for _, t in rows])
    assert pairs(after) == [rows[i] for i in sorted(set(found))]

    before, after = kept["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute.leaks(pairs(before), items)}
    assert pairs(after) == [(d, t) for d, t in pairs(before) if d not in bad]

    before, after = kept["byte_bpe"]
    vocabulary = bpe.read_vocabulary(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    assert pairs(before) == pairs(after)
    for r in after.collect():
        assert r["round_trip"] and vocabulary.decode(r["token_ids"]) == r["text"].encode()


def test_odd_rows_pass_all_stages(spark, sf_dir, odd, empty):
    for docs in (odd, empty.withColumn("score", F.lit(1))):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert "token_ids" in docs.columns and "score" in docs.columns
    assert docs.count() == 0


def test_contract():
    names = contract.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
