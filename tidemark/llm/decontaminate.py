"""Benchmark decontamination, in DataFrame functions only.

A document holds a benchmark item if one of its windows of the item's size has a weighted
similarity of 0.8 or more with it: shingles of five words, weighted by how often they
occur, intersection over union.

Windows are placed where they can match at all: every similar window shares a shingle
with its item, so each shingle of a document that some item has places windows of that
item's size, once for each position the shingle has in items of that size. Each window
gets the SimHash of its shingles, and the items of its size within ``RADIUS`` bits are
found by a multi-index: the 64 bits are cut into ``BLOCKS`` blocks, of which at least one
differs by no more than RADIUS // BLOCKS bits, so items are entered under each of their
blocks with every such change, and windows look their blocks up as they are. That finds
all items within the radius; what it finds is verified on the shingles themselves.

A SimHash says little about few shingles. Items whose shingles weigh as much as fewer than
``LONG`` even ones are looked up by the shingles they share with a window, whatever their
distance. At similarity 0.8 a bit of a long item differs with probability 0.151, so the
radius misses about one such window in 3,000; at 0.9 less than one in ten million.

Defined results: words are cut after lower-casing A-Z only; items of fewer than five
words have one shingle, all their words; items and documents without words match nothing;
a window that would reach over an end of the document is moved inside, and a document
shorter than an item is one window. Of several windows that hold one item the most
similar and then the first is reported. Items are told apart by their words: several
under one id report the best of them, one under several ids, NULL among them, reports
each id. Repeated documents and items report what a single one does. Empty tables give
empty results; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .text import WORD, if_small, lower_ascii, name, whole

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19  # bits of 64 that matches of long items stay within
BLOCKS = 10
LONG = 16  # even shingles from which an item is looked up by its SimHash
ITEM_SHINGLES = 1_000_000  # distinct item shingles that are broadcast: 8 bytes each; more are joined by a shuffle


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_places(count: Column, width: Column | int) -> Column:
    """1, 2, ... for each shingle of ``width`` of that many words; one for fewer words, none without words."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.when(count > 0, F.sequence(F.lit(1), F.greatest(count - w + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(hashes: Column, width: Column | int) -> Column:
    return F.transform(shingle_places(F.size(hashes), width), lambda i: F.xxhash64(F.slice(hashes, i, width)))


def simhash(rows: DataFrame, *keys: str) -> DataFrame:
    """The SimHash ``f`` of the shingle hashes ``h`` of each key: bits set in over half of them."""
    bits = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n_h"), *bits)
    one = lambda b: F.when(F.col(f"b{b}") * 2 > F.col("n_h"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
    return sums.select(*keys, reduce(Column.bitwiseOR, [one(b) for b in range(64)]).alias("f"))


def prepared_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, size, width, words) of each item with words; ``item`` is the digest of its words."""
    rows = items.select(name(id_col).alias("item_id"), words_of(whole(text_col)).alias("words")).where(F.size("words") > 0)
    digest = F.unhex(F.sha2(F.array_join("words", " "), 256))
    width = F.least(F.size("words"), F.lit(SHINGLE))
    return rows.distinct().select("item_id", digest.alias("item"), F.size("words").alias("size"), width.alias("width"), "words")


def block_bits() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    ends = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def block_values(f: Column) -> Column:
    """One (number, value) for each block of a fingerprint."""
    cut = lambda at, n: F.shiftrightunsigned(f, at).bitwiseAND(F.lit((1 << n) - 1))
    return F.array(*[F.struct(F.lit(k).alias("number"), cut(*b).alias("value")) for k, b in enumerate(block_bits())])


def near_block_values(f: Column) -> Column:
    """The same with every change of up to RADIUS // BLOCKS bits of a block."""
    assert RADIUS // BLOCKS == 1
    flips = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in (0, *(1 << i for i in range(n)))]) for _, n in block_bits()])
    changed = lambda b: F.transform(
        F.get(flips, b["number"]), lambda m: F.struct(b["number"].alias("number"), b["value"].bitwiseXOR(m).alias("value"))
    )
    return F.flatten(F.transform(block_values(f), changed))


def within_radius(marked: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """(key, item, hamming): the windows (key, f) and the items (item, size, g) of their size at most RADIUS bits apart."""
    left = marked.select(*key, "f", F.explode(block_values(F.col("f"))).alias("b")).select(*key, "f", "b.*")
    right = items.select("item", "size", "g", F.explode(near_block_values(F.col("g"))).alias("b")).select("item", "size", "g", "b.*")
    hamming = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))).alias("hamming")
    return left.join(right, ["size", "number", "value"]).select(*key, "item", hamming).where(F.col("hamming") <= RADIUS).distinct()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(name(id_col).alias("doc_id"), F.xxhash64(whole(text_col)).alias("digest"), whole(text_col).alias("text"))


def windows(rows: DataFrame, item_shingles: DataFrame) -> DataFrame:
    """(doc_id, digest, start, length, size, width): each window that an item shingle places."""
    known = stored(item_shingles.select("h", "width").distinct(), "item-shingles")
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # 1 to 5
    texts = rows.select("doc_id", "digest", words_of(F.col("text")).alias("words"))
    texts = texts.select("doc_id", "digest", F.size("words").alias("n"), hashed(F.col("words")).alias("hw"))
    hits = []
    for w in widths:
        own = known.where(F.col("width") == w).select("h")
        placed = texts.where(F.col("n") >= w).select("doc_id", "digest", "n", F.posexplode(shingle_hashes(F.col("hw"), w)).alias("pos", "h"))
        hits.append(placed.join(if_small(own, ITEM_SHINGLES), "h", "left_semi").withColumn("width", F.lit(w)))
    if not hits:
        return rows.sparkSession.createDataFrame([], "doc_id bigint, digest bigint, start int, length int, size int, width int")
    found = stored(reduce(DataFrame.unionByName, hits), "hits")
    places = item_shingles.select("h", "width", "size", "at").distinct()
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("n") - F.col("size")))
    return found.join(places, ["h", "width"]).select(
        "doc_id", "digest", start.alias("start"), F.least("size", "n").alias("length"), "size", "width"
    ).distinct()


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, digest, item_id, start_word, n_words, hamming, similarity) of each item a document holds.

    ``digest`` is the hash of the document's text: with the id it tells which row it was.
    """
    named = stored(prepared_items(items, item_id_col, item_text_col), "items")
    bench = named.drop("item_id").dropDuplicates(["item", "size"])
    rows = keyed(docs, id_col, text_col)
    item_shingles = bench.select(
        "item", "size", "width", F.posexplode(shingle_hashes(hashed(F.col("words")), F.col("width"))).alias("at", "h")
    )
    placed = stored(windows(rows, item_shingles), "windows")
    holders = stored(placed.select("doc_id", "digest").distinct(), "holders")
    again = if_small(holders.select(F.col("doc_id").alias("id"), F.col("digest").alias("d")))
    texts = rows.join(again, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left_semi").distinct()
    texts = texts.select("doc_id", "digest", words_of(F.col("text")).alias("words"))
    t, p = texts.alias("t"), placed.alias("p")
    cut = t.join(p, F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.digest") == F.col("p.digest"))).select(
        "p.*", F.slice("t.words", F.col("p.start") + 1, F.col("p.length")).alias("words")
    )
    cut = stored(cut, "cut")
    key = ["doc_id", "digest", "start", "length", "size", "width"]
    hashes = cut.select(*key, F.explode(shingle_hashes(hashed(F.col("words")), F.col("width"))).alias("h"))
    item_counts = item_shingles.groupBy("item", "size", "h").agg(F.count("*").alias("y"))
    weight = item_counts.groupBy("item", "size").agg((F.pow(F.sum("y"), 2) / F.sum(F.col("y") * F.col("y"))).alias("even"))
    prints = simhash(item_shingles, "item", "size").withColumnRenamed("f", "g").join(weight, ["item", "size"])
    prints = stored(prints, "item-prints")
    marked = stored(simhash(hashes, *key), "window-prints")
    found = within_radius(marked, prints.where(F.col("even") >= LONG), key)
    short = prints.where(F.col("even") < LONG).select("item", "size", "g")
    if not short.isEmpty():
        found = found.unionByName(sharing(hashes, marked, item_counts, short, key, similarity))
    return verified(stored(found, "candidates"), cut, bench, named, similarity)


def sharing(
    hashes: DataFrame, marked: DataFrame, item_counts: DataFrame, short: DataFrame, key: list[str], similarity: float
) -> DataFrame:
    """(key, item, hamming) of windows and short items whose shared shingle hashes give the similarity: never too low."""
    counts = item_counts.join(short, ["item", "size"])
    shared = hashes.groupBy(*key, "h").agg(F.count("*").alias("x")).join(counts, ["size", "h"])
    shared = shared.groupBy(*key, "item", "g").agg(F.sum(F.least("x", "y")).alias("shared"))
    of = lambda words: F.greatest(F.col(words) - F.col("width") + 1, F.lit(1))
    enough = shared.where(F.col("shared") / (of("length") + of("size") - F.col("shared")) >= similarity).alias("e")
    m = marked.alias("m")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key]
    hamming = F.bit_count(F.col("m.f").bitwiseXOR(F.col("e.g"))).alias("hamming")
    return enough.join(m, reduce(Column.__and__, same)).select(*[F.col(f"e.{c}") for c in key], "e.item", hamming)


def verified(near: DataFrame, cut: DataFrame, bench: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """Exact weighted similarity on the shingles' words; the best window of each document and item id."""
    strings = F.transform(
        shingle_places(F.size("words"), F.col("width")), lambda i: F.array_join(F.slice("words", i, F.col("width")), " ")
    )
    key = ["doc_id", "digest", "start", "length", "size", "width"]
    a, b = near.alias("a"), cut.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    pair = [*key, "item", "hamming"]
    window = a.join(b, reduce(Column.__and__, same)).select("a.*", "b.words").select(*pair, F.explode(strings).alias("s"), F.lit(1).alias("side"))
    item = near.join(bench.select("item", "size", "words"), ["item", "size"]).select(*pair, F.explode(strings).alias("s"), F.lit(-1).alias("side"))
    counts = window.unionByName(item).groupBy(*pair, "s").agg(
        F.count_if(F.col("side") == 1).alias("x"), F.count_if(F.col("side") == -1).alias("y")
    )
    found = counts.groupBy(*pair).agg((F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("similarity"))
    ids = named.select("item_id", "item", "size").distinct()
    best = found.where(F.col("similarity") >= similarity).join(ids, ["item", "size"]).groupBy("doc_id", "digest", "item_id").agg(
        F.min(F.struct((-F.col("similarity")).alias("less"), "start", "length", "hamming")).alias("w")
    )
    return best.select(
        "doc_id", "digest", "item_id", F.col("w.start").cast("bigint").alias("start_word"), F.col("w.length").cast("bigint").alias("n_words"),
        F.col("w.hamming").alias("hamming"), (-F.col("w.less")).alias("similarity"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = stored(matches(docs, items, id_col, text_col, **names).select("doc_id", "digest").distinct(), "contaminated")
    bad = if_small(found.select(F.col("doc_id").alias("_leak_id"), F.col("digest").alias("_leak_digest")))
    same = name(id_col).eqNullSafe(F.col("_leak_id")) & (F.xxhash64(whole(text_col)) == F.col("_leak_digest"))
    return docs.join(bad, same, "left_anti")
