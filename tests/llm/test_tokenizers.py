"""Byte-level BPE against tiktoken, token counts against tokenizers."""

import base64
import hashlib

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries, token_counts

PATH = public.path("byte_bpe_multi_50k.tiktoken")
JSON = public.path("byte_bpe_50k.json")
VOCABULARY = bpe.read_vocabulary(PATH, public.PATTERN)
COUNTER = token_counts.read_counter(JSON)
LIBRARY = Tokenizer.from_file(JSON)
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})

PIECES = [
    "a", "the", "ing", " ", "  ", "\n", " \n", "\r\n", "\t", "\x1c", "\x85", "\u00a0", "\u3000", "é", "ß", "1", "2024", "²", "!", "'", "'s",
    "'ll", " 're", "日本", "😀", "=", "-", "AAAA", "ion", "<|endoftext|>", "़",
]
TEXTS = st.one_of(
    st.lists(st.sampled_from(PIECES), max_size=60).map("".join),
    st.text(alphabet="etaoinshrdlu", max_size=300),
    st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=80),
)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(text):
    ids = VOCABULARY.encode(text)
    assert ids == TIKTOKEN.encode_ordinary(text)
    assert VOCABULARY.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeht=-", max_size=200), st.integers(0, 200))
def test_join_is_the_encoding_of_both(text, at):
    s = text.encode()
    x, y = VOCABULARY.encode_bytes(s[:at], False), VOCABULARY.encode_bytes(s[at:], False)
    assert VOCABULARY.join(x, y) == VOCABULARY.merged(s)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "é" * 9_000, " " * 9_000, "-=" * 9_000, "0123456789" * 900])
def test_long_runs(text):
    ids = VOCABULARY.encode(text)
    assert ids == TIKTOKEN.encode_ordinary(text) and VOCABULARY.decode(ids) == text.encode()
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_are_the_librarys(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=150).map("".join), st.integers(1, 40))
def test_state_maps_compose(text, size):
    maps = [COUNTER.map_of(text[i : i + size]) for i in range(0, len(text), size)] or [token_counts.StateMap("")]
    scanned = COUNTER.scan(maps)
    for k, m in enumerate(scanned):
        assert COUNTER.close(m) == COUNTER.between(text[: (k + 1) * size])


def test_queries(spark, sf_dir, texts):
    want = {i: TIKTOKEN.encode_ordinary(t or "") for i, t in texts}
    for r in queries.QUERIES["op3_byte_bpe"](spark, sf_dir).collect():
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    of = dict(texts)
    rows = queries.QUERIES["op7_token_counts"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(LIBRARY.encode(of[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 512, len((of[r["doc_id"]] or "").encode()))


def test_odd_rows(odd, empty):
    out = bpe.decoded(bpe.encoded(odd, VOCABULARY), VOCABULARY)
    assert set(out.columns) == {*odd.columns, "bytes"}
    for r in out.collect():
        assert r["ids"] == TIKTOKEN.encode_ordinary(r["text"] or "") and bytes(r["bytes"]) == (r["text"] or "").encode()
        assert r["score"] == "other"
    counted = token_counts.counted(odd, COUNTER)
    assert [r["n_tokens"] for r in counted.collect()] == [
        len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect()
    ]
    assert bpe.encoded(empty, VOCABULARY).count() == 0 and token_counts.counted(empty, COUNTER).count() == 0
