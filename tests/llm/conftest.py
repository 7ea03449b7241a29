import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

ODD = [
    (1, "Twice the same text here, twice the same.", "en"),
    (2, "Twice the same text here, twice the same.", "en"),
    (2, "Twice the same text here, twice the same.", "en"),
    (3, None, None),
    (4, "", "de"),
    (None, "Twice the same text here, twice the same.", "fr"),
    (None, None, None),
    (5, "  \n\t ", "de"),
    (6, "x" * 30_000, "en"),
    (7, "Ünïcode wörds und 日本語 😀 text", "de"),
    (8, "lone", "en"),
    (9, "a b " * 20_000, "en"),
]
SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs everywhere, empty and long texts, repeated rows, and columns named like outputs."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, SCHEMA)
    clash = "score digest ids f fingerprint kept key n class h label n_tokens matches"
    return docs.withColumns({c: F.lit("other") for c in clash.split()})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
