"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

The mix is a row of slots of ``block_words`` words. Slot i stands at the i-th point of the
golden-ratio sequence, which spreads any number of points evenly; the sources' cumulative
weights cut the line from 0 to 1 into intervals, and the interval in which a point falls
names the slot's source. So every stretch of the mix, not only the whole, holds each source
by its weight. A source's documents are shuffled by a hash and cut, end to end, into blocks
of as many words; its r-th slot takes its r-th block, and after the last one it starts over,
``most`` times at most.

Weights are asked for, sizes are given: a source whose share would exceed ``most`` times its
words gets just those, and the rest is shared out among the others by weight, until none
is above.

Rows: NULL texts are empty documents of size 0, of which nothing is taken; a NULL source is
a source of its own, the last one; ids may be NULL or repeat, as a row is known by its place
in its source. An empty table gives an empty mix, one without words an empty schedule.
Ties in the shuffle are rows of one id and size, which may stand for each other.

Size: slots and pieces of documents are about as many as blocks, without texts; ordered sums
run in segments of bounded size, so a source may hold a third of all rows. Sources themselves
are numbered in one task, one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import carry_scan, settle
from ..session import stored
from .text import name, whole

WORD = r"[^\x20\x09-\x0D]++"
WEIGHTS = (1, 2, 3)
MOST = 3  # times that a source may be gone through
BLOCK_WORDS = 64
# Points are whole numbers below GRID; STEP is the odd number nearest to GRID over the golden ratio.
GRID = 1 << 31
STEP = 1_327_217_885
# Rows of an ordered sum that one task adds up.
SEGMENT = 200_000


def size_of(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size) of every document, written: texts are read once."""
    narrow = docs.select(name(doc_id).alias("doc_id"), name(source).alias("source"), size_of(text).alias("size"))
    return stored(narrow, "mix-sizes")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(number, source, source_size, documents, target, low, high), a row for each source.

    ``number`` counts sources by code point, NULL last; weights repeat along it. All sources
    together share the words of all. With sources in the order of size over weight, those
    that are capped come first, and the level of the others, words for each unit of weight,
    is the highest of the levels that arise when the first 0, 1, 2, ... are capped.
    ``low`` and ``high`` bound the source's points.
    """
    line = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
        .withColumn("number", (F.row_number().over(line) - 1).cast("bigint"))
        .withColumn("weight", weight)
    )
    full = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    smaller = Window.orderBy(F.col("source_size") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * most
    sums = sources.withColumns({
        "_words": F.sum("source_size").over(full), "_weights": F.sum("weight").over(full),
        "_capped": F.coalesce(F.sum(cap).over(smaller), F.lit(0)),
        "_taken": F.coalesce(F.sum("weight").over(smaller), F.lit(0)),
    })
    level = (F.col("_words") - F.col("_capped")) / (F.col("_weights") - F.col("_taken"))
    levelled = sums.withColumn("_level", F.max(level).over(full))
    target = F.least(cap.cast("double"), F.col("weight") * F.col("_level"))
    until = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    share = F.try_divide(F.sum("target").over(until), F.col("_words"))
    high = F.least(F.lit(GRID), F.coalesce(F.round(share * GRID), F.lit(0)).cast("bigint"))
    return stored(
        levelled.withColumn("target", target).withColumn("high", high)
        .withColumn("low", F.lag("high", 1, 0).over(Window.orderBy("number")))
        .select("number", "source", "source_size", "documents", "target", "low", "high"),
        "mix-targets",
    )


def slots(of: DataFrame, words: int, sources: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, number, rank): the source of each slot and how many of its slots came before, written.

    The line is cut into cells, at least four times as many as sources, and a slot meets
    the intervals of its cell only.
    """
    width = GRID >> min(max(10, sources.bit_length() + 2), 24)
    count = -(-words // block_words)
    cells = of.where("high > low").select(
        "number", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell")
    )
    points = of.sparkSession.range(count).select(
        F.col("id").alias("slot"), ((F.col("id") % GRID * STEP) % GRID).alias("point")
    )
    placed = points.withColumn("cell", F.expr(f"point div {width}")).join(cells, "cell").where("low <= point and point < high")
    chunked = placed.select("slot", "number", F.expr(f"slot div {SEGMENT}").alias("chunk"))
    ranked = settle(carry_scan(chunked, ["number"], "chunk", ["slot"], running={"rank": F.lit(1).cast("bigint")}))
    return stored(ranked.select("slot", "number", (F.col("rank") - 1).alias("rank")), "mix-slots")


def placed(sizes: DataFrame, of: DataFrame, documents: int) -> DataFrame:
    """The documents with their source's row and where their words start in its shuffled row of words.

    A stretch of the hash is one segment of the running sum; with more documents there are
    more stretches.
    """
    stretches = -(-documents // SEGMENT) or 1
    key = F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    stretch = F.expr(f"cast(conv(substring(shuffle, 1, 8), 16, 10) as bigint) * {stretches} div {1 << 32}")
    sides = of.select(F.col("source").alias("_source"), "number", "source_size", "target")
    joined = sizes.withColumn("shuffle", key).join(sides, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = ["shuffle", "doc_id", "size"]
    ends = carry_scan(joined.withColumn("stretch", stretch), ["number"], "stretch", order, running={"end": F.col("size")})
    return settle(ends).withColumn("start", F.col("end") - F.col("size")).drop("stretch", "shuffle", "end")


def pieces(docs: DataFrame, ranked: DataFrame, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each document's stretches in the blocks that are taken: epoch, block, first word, words.

    A document that no slot reaches keeps one row, without a piece.
    """
    reach = ranked.groupBy("number").agg(F.count("*").alias("_blocks"))
    found = docs.join(reach.withColumnRenamed("number", "_number"), F.col("number") == F.col("_number"), "left")
    last_block = F.coalesce("_blocks", F.lit(0)) - 1

    def stretches(epoch: Column) -> Column:
        at = F.col("start") + epoch * F.col("source_size")
        first = F.floor(at / block_words)
        last = F.least(F.floor((at + F.col("size") - 1) / block_words), last_block)
        cut = lambda b: F.struct(
            epoch.alias("epoch"),
            b.alias("block"),
            (F.greatest(at, b * block_words) - at).alias("first_word"),
            (F.least(at + F.col("size"), (b + 1) * block_words) - F.greatest(at, b * block_words)).alias("words"),
        )
        inside = (F.col("size") > 0) & (first <= last)
        return F.when(inside, F.transform(F.sequence(first, F.greatest(first, last)), cut)).otherwise(F.array().cast(KIND))

    # Epochs beyond the blocks taken give no pieces.
    every = F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint")), stretches))
    return found.withColumn("piece", F.explode_outer(every)).drop("_number", "_blocks").select("*", "piece.*").drop("piece")


KIND = "array<struct<epoch: bigint, block: bigint, first_word: bigint, words: bigint>>"


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule).

    ``documents``: doc_id, source, size, source_size, target and the words taken of every
    row, repeats counted. ``schedule``: which words of which document stand in which slot;
    sorted by slot, and in a slot by ``position``, it is the mix.
    """
    sizes = sized(docs, doc_id, source, text)
    of = targets(sizes, weights, most)
    words, documents, sources = of.agg(F.sum("source_size"), F.sum("documents"), F.count("*")).first()
    ranked = slots(of, words or 0, sources, block_words)
    cut = pieces(placed(sizes, of, documents or 0), ranked, most, block_words)
    used = ranked.select("slot", F.col("number").alias("_number"), F.col("rank").alias("_rank"))
    met = stored(
        cut.join(used, (F.col("number") == F.col("_number")) & (F.col("block") == F.col("_rank")), "left").drop("_number", "_rank"),
        "mix-pieces",
    )
    row = ["number", "start", "doc_id", "source", "size", "source_size", "target"]
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).cast("bigint").alias("taken")
    # Where a document of some words starts, no other one does; those of none need no sum.
    some = met.where("size > 0").groupBy(*row).agg(taken)
    none = met.where("size = 0").select(*row, F.lit(0).cast("bigint").alias("taken"))
    position = F.col("start") + F.col("epoch") * F.col("source_size") + F.col("first_word")
    schedule = met.where("slot is not null").select("slot", position.alias("position"), "doc_id", "source", "epoch", "first_word", "words")
    return some.unionByName(none).drop("number", "start"), schedule
