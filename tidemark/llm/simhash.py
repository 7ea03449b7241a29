"""SimHash near-dedup over a covering code.

A text's fingerprint takes its three-word shingles, repeats included: a bit is set if it
is set in over half of their 64-bit hashes. Fingerprints at two bits or fewer are linked,
and a component of linked fingerprints is one class.

Search: the 64 bits are cut into blocks of 23, 23 and 18, each covered by the perfect
binary Golay code of length 23 (the last one shortened), so the anchors are triples of
code words and every point has an anchor within 3 bits in each block. Two fingerprints
at distance 2 have a point between them, one bit from either; that point's anchor lies
within covering radius plus one of both in the blocks. Replicating a fingerprint to the anchors of all
points at most one bit away therefore brings each linked pair together at some anchor:
about 14 rows a fingerprint, against 65 without a code. (Replicating by the whole
threshold on both sides would find the same links with many times the rows.)

Comparison at an anchor: only anchors that several fingerprints reach are looked at.
Their fingerprints are dealt out again by the points between them that belong to the
anchor. All fingerprints around one point are within two bits of each other, so each is
linked to the smallest, and no pairs are listed, however many copies meet.

Defined results: NULL and texts without words have fingerprint zero, linked like any
other; fewer than three words make one shingle; repeated rows share fingerprint and
class; rows with a NULL id belong to classes but never name one (a class of such rows
only has a NULL name). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import roots
from .text import appended, name, once, whole

SEED = 42
SHINGLE = 3
THRESHOLD = 2  # links need a point within one bit of both: the search below is for two bits
BLOCKS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
GOLAY = 0b101011100011  # generator polynomial of the (23, 12) code


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and each syndrome's error of weight 3 or less."""

    def syndrome(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GOLAY << (i - 11)
        return word

    low = np.array([syndrome(w) for w in range(1 << 12)], np.int64)
    high = np.array([syndrome(w << 12) for w in range(1 << 11)], np.int64)
    one = [syndrome(1 << i) for i in range(23)]
    errors = np.zeros(1 << 11, np.int64)
    for i in range(23):
        errors[one[i]] = 1 << i
        for j in range(i):
            errors[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    return low, high, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the only code word within three bits of each 23-bit word."""
    low, high, errors = golay()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def block_words(points: np.ndarray) -> list[np.ndarray]:
    points = points.view(np.uint64)
    return [((points >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in BLOCKS]


def home(points: np.ndarray) -> np.ndarray:
    """The anchor of a 64-bit point: 36 bits."""
    a, b, c = (nearest(w) for w in block_words(points))
    return a | b << 12 | c << 24


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the point, anchor) for the distinct anchors of all points at most one bit away."""
    words = block_words(points)
    own = [nearest(w) for w in words]
    base = own[0] | own[1] << 12 | own[2] << 24
    index, out = [np.arange(len(points))], [base]
    for k, (_, n) in enumerate(BLOCKS):
        near = np.sort(nearest(words[k][:, None] ^ (1 << np.arange(n))), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new & (near != own[k][:, None]))
        index.append(row)
        out.append(base[row] ^ (own[k][row] ^ near[row, col]) << 12 * k)
    return np.concatenate(index), np.concatenate(out)


def fingerprint(text: bytes) -> int:
    """As a signed 64-bit number."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (total * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep=None, into: str = "fingerprint") -> DataFrame:
    """Append the fingerprint as a bigint (its 64 bits, sign included)."""

    def make():
        return lambda texts: [pa.array([fingerprint(t) for t in texts.to_pylist()], pa.int64())]

    return appended(docs, whole(text_col).cast("binary"), make, f"`{into}` bigint", keep)


def hexed(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def at_anchors(prints: DataFrame) -> DataFrame:
    """(anchor, fingerprint): each distinct fingerprint at every anchor it has to be compared at."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy()
            for at in range(0, len(points), 4096):
                part = points[at : at + 4096]
                index, anchor = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index])], names=["anchor", "f"])

    return prints.select("f").mapInArrow(spread, "anchor bigint, f bigint")


def between(members: DataFrame) -> DataFrame:
    """(point, fingerprint) for the points of an anchor at most one bit from its fingerprints."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for batch in batches:
            anchor, points = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for at in range(0, len(points), 4096):
                part = points[at : at + 4096]
                near = part[:, None] ^ flips
                row, col = np.nonzero(home(near.ravel()).reshape(near.shape) == anchor[at : at + 4096, None])
                point = near[row, col].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(part[row].view(np.int64))], names=["point", "f"])

    return members.select("anchor", "f").mapInArrow(spread, "point bigint, f bigint")


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all fingerprints ``f`` at two bits or fewer: a star at each point between."""
    placed = stored(at_anchors(prints), "anchors")
    busy = placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    members = stored(between(placed.join(busy, "anchor", "left_semi")), "between")
    least = members.groupBy("point").agg(F.min("f").alias("v"), F.max("f").alias("top")).where("v != top").select("point", "v")
    return members.join(least, "point").where("f != v").select(F.col("f").alias("u"), "v").distinct()


def classes(marked: DataFrame) -> DataFrame:
    """(f, class, component_id) of each distinct fingerprint of (doc_id, f).

    ``class`` is a fingerprint that stands for the class, ``component_id`` its smallest doc_id.
    """
    prints = stored(marked.groupBy("f").agg(F.min("doc_id").alias("doc_id")), "prints")
    root = roots(links(prints)).withColumnRenamed("node", "f")
    linked = stored(root.join(prints, "f"), "linked")
    names = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(names, "root").select("f", "root", "component_id")
    mine = lambda c, other: F.when(F.col("root").isNull(), F.col(other)).otherwise(F.col(c)).alias(c)
    return prints.join(named, "f", "left").select(
        "f", F.coalesce("root", "f").alias("class"), mine("component_id", "doc_id")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; fingerprint in 16 hex digits."""
    narrow = docs.select(name(id_col).alias("doc_id"), name(text_col).alias("text"))
    marked = stored(with_fingerprint(narrow, keep=["doc_id"], into="f"), "fingerprints")
    return marked.join(classes(marked).drop("class"), "f").select(
        "doc_id", hexed(F.col("f")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: the one with the smallest id, a NULL id last.

    Of several rows with that id the one with the smallest text digest stays; of rows
    that repeat each other one stays.
    """
    digest = F.unhex(F.sha2(whole(text_col), 256))
    narrow = docs.select(name(id_col).alias("doc_id"), name(text_col).alias("text"), digest.alias("digest"))
    marked = stored(with_fingerprint(narrow, keep=["doc_id", "digest"], into="f"), "fingerprints")
    rows = marked.join(classes(marked).drop("component_id"), "f").groupBy("class", "doc_id", "digest")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "n")).alias("first")
    best = rows.agg(F.count("*").alias("n")).groupBy("class").agg(first).select(
        F.col("first.doc_id").alias("_simhash_id"), F.col("first.digest").alias("_simhash_digest"),
        F.col("first.n").alias("_simhash_n"),
    )
    best = stored(best, "representatives")
    same = (digest == best["_simhash_digest"]) & name(id_col).eqNullSafe(best["_simhash_id"])
    return once(docs.join(best, same), F.col("_simhash_n") > 1, "_simhash_digest", "_simhash_id").select(
        *[name(c) for c in docs.columns]
    )
