"""Cross-entropy difference of two matched n-gram models.

A target model (documents that a column marks) and a background model (all documents)
share one vocabulary and one set of word pairs and are smoothed alike: absolute
discounting of pairs, interpolated with add-one words. A document's score is the mean
over its tokens of background loss less target loss, so documents like the target score
above 0.

Every word and every pair of all documents counts. Texts are written once as blocks:
the hashes of a block's words and the texts as numbers of these. A block sends its
different pairs, folded, to groups by pair; a group adds up the counts of all blocks,
answers each block and passes on what the pairs add to the counts of their words, which
are added up and answered in the same way. So a block learns the counts of its own pairs
and words only and prices its texts; no task and no driver holds a model. Blocks have a
fixed size and the number of groups follows the number of tokens. A frequent word or pair
is one entry for each block, however often it occurs.

Words are known by 64-bit hashes and a pair by those of its words; a text is known by two
hashes of different kinds.

Defined results: NULL, empty texts and texts without words have no tokens, losses 0 and
score 0; a NULL mark is not target; without target documents both models are the same
uniform one on that side; a pair that was not counted backs off, a word that was not
counted has the add-one share and, as a context, leaves all weight. Other columns pass
through; a column named like an output is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .text import WORD, name, small_batches, whole

DISCOUNT = 0.75
SEED = 42
BLOCK_TOKENS = 2_000_000  # a block of texts is closed once it holds so many
PART_TOKENS = 2_000_000  # tokens for each group of pairs, on average
ANSWER, ADDEND, SIZE, WORDS, TEXTS = range(5)  # kinds of messages

MESSAGE = "kind int, part int, block bigint, words bigint, data array<binary>"
NAMES = ["kind", "part", "block", "words", "data"]

find_words = re.compile(WORD.encode()).findall


class Numbers(dict):
    """Numbers of words in the order they come; 0 is left for the start of a text."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def packed(numbers: np.ndarray) -> bytes:
    """Integers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def dealt(a: np.ndarray, b: np.ndarray | int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in the order of the parts they belong to, and where each part starts in it."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    part = ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def message(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)


def text_keys(text_col: str) -> dict[str, Column]:
    return {"g": F.xxhash64(whole(text_col)), "g2": F.xxhash64(F.lit(SEED), whole(text_col))}


def blocked(docs: DataFrame, target: Column, text_col: str) -> DataFrame:
    """Stored blocks of texts: hashes of the block's words by frequency, the texts as numbers of them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        numbers, tokens, rows, held = Numbers(), [], [], 0

        def closed() -> pa.RecordBatch:
            of = np.concatenate(tokens)
            by_count = np.argsort(-np.bincount(of, minlength=len(numbers) + 1)[1:], kind="stable")
            rank = np.zeros(len(numbers) + 1, np.int64)
            rank[by_count + 1] = np.arange(1, len(numbers) + 1)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) or 1 for w in numbers), np.uint64, len(numbers))
            words = np.append(0, hashes.view(np.int64)[by_count])
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            marks, g, g2 = np.array(rows, np.int64).T
            data = [words, rank[of], sizes, marks, g, g2]
            arrays = [[block], [len(of)], [int((sizes * marks).sum())], pa.array([list(map(packed, data))], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["block", "n", "n_target", "data"])

        for batch in batches:
            for text, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = find_words(text.lower())
                if words:
                    tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    rows.append(row)
                    held += len(words)
                if held >= BLOCK_TOKENS:
                    yield closed()
                    block, numbers, tokens, rows, held = block + 1, Numbers(), [], [], 0
        if held:
            yield closed()

    small_batches(docs)
    marked = F.coalesce(target, F.lit(False)).cast("bigint")
    rows = docs.select(whole(text_col).cast("binary"), marked, *text_keys(text_col).values())
    return stored(rows.mapInArrow(make, "block bigint, n bigint, n_target bigint, data array<binary>"), "lm-blocks")


def pairs_of(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's different pairs (first, second word's number), and which of them each token ends."""
    first = np.append(0, tokens[:-1])
    first[np.cumsum(sizes) - sizes] = 0
    pairs, which = np.unique(first * len(words) + tokens, return_inverse=True)
    return *np.divmod(pairs, len(words)), which


def pair_requests(blocks: DataFrame, parts: int, counts: bool, asks: bool) -> DataFrame:
    """Each block's pairs with their counts, dealt to parts; ``block`` is -1 where nothing is asked."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, tokens, sizes, marks, *_ = map(unpacked, data)
                a, b, which = pairs_of(words, tokens, sizes)
                c = np.bincount(which, minlength=len(a)) * counts
                c_target = np.bincount(which, np.repeat(marks, sizes), len(a)).astype(np.int64) * counts
                order, starts = dealt(words[a], words[b], parts)
                rows = []
                for part in np.flatnonzero(np.diff(starts)).tolist():
                    at = order[starts[part] : starts[part + 1]]
                    used, local = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
                    firsts, seconds = local[: len(at)], local[len(at) :]
                    columns = [words[used], np.diff(firsts, prepend=0), seconds, c[at], c_target[at]]
                    rows.append((WORDS, part, block if asks else -1, 0, list(map(packed, columns))))
                yield message(rows)

    return blocks.select("block", "data").mapInArrow(make, MESSAGE)


def word_requests(blocks: DataFrame, parts: int) -> DataFrame:
    """Each block's words, dealt to parts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = unpacked(data[0])
                order, starts = dealt(words, 0, parts)
                filled = np.flatnonzero(np.diff(starts)).tolist()
                yield message([(WORDS, p, block, 0, [packed(words[order[starts[p] : starts[p + 1]]])]) for p in filled])

    return blocks.select("block", "data").mapInArrow(make, MESSAGE)


def sums(which: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(which, of, size).astype(np.int64)


def tally_pairs(parts: int, table: pa.Table) -> pa.Table:
    """Counts of a part's pairs: answers to the blocks, and what they add to the counts of their words."""
    blocks, data = table["block"].to_pylist(), table["data"].to_pylist()
    columns = [[], [], [], []]
    for message_ in data:
        words, firsts, seconds, c, c_target = map(unpacked, message_)
        for column, x in zip(columns, (words[np.cumsum(firsts)], words[seconds], c, c_target), strict=True):
            column.append(x)
    ends = np.cumsum([0, *map(len, columns[0])])
    a, b, c, c_target = map(np.concatenate, columns)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    a, b = a[new], b[new]
    n, n_target = sums(which, c, len(a)), sums(which, c_target, len(a))
    rows = []
    for block, lo, hi in zip(blocks, ends, ends[1:]):
        if block >= 0:
            at = which[lo:hi]
            rows.append((ANSWER, int(table["part"][0].as_py()), block, 0, [packed(n[at]), packed(n_target[at])]))
    words, local = np.unique(np.concatenate([a, b]), return_inverse=True)
    first, second = local[: len(a)], local[len(a) :]
    added = [sums(second, n, len(words)), sums(second, n_target, len(words)), sums(first, n, len(words)), sums(first, n_target, len(words))]
    added += [sums(first, n > 0, len(words)), sums(first, n_target > 0, len(words))]
    order, starts = dealt(words, 0, parts)
    for part in np.flatnonzero(np.diff(starts)).tolist():
        at = order[starts[part] : starts[part + 1]]
        rows.append((ADDEND, part, -1, 0, [packed(x[at]) for x in (words, *added)]))
    return pa.Table.from_batches([message(rows)])


def tally_words(table: pa.Table) -> pa.Table:
    """The blocks' words with their counts: as a word, as a context, different pairs; each also in the target."""
    blocks, data = table["block"].to_pylist(), table["data"].to_pylist()
    words = [unpacked(d[0]) for d in data]
    ends = np.cumsum([0, *map(len, words)])
    keys, which = np.unique(np.concatenate(words), return_inverse=True)
    counts = [np.zeros(len(keys), np.int64) for _ in range(6)]
    for lo, hi, d in zip(ends, ends[1:], data):
        for total, x in zip(counts, map(unpacked, d[1:])):
            total[which[lo:hi]] += x  # a message names a word once
    part = int(table["part"][0].as_py())
    rows = [(SIZE, part, -1, int((counts[0] > 0).sum()), [])]
    for block, lo, hi in zip(blocks, ends, ends[1:]):
        if block >= 0:
            rows.append((WORDS, part, block, 0, [packed(x[which[lo:hi]]) for x in counts]))
    return pa.Table.from_batches([message(rows)])


@dataclass
class Tables:
    blocks: DataFrame  # the texts that were counted
    answers: DataFrame  # counts of these blocks' pairs and words
    parts: int
    tokens: tuple[int, int]  # of all documents and of the target
    size: int  # words, the unknown one included


def answered(counted: DataFrame, asking: DataFrame | None, parts: int) -> DataFrame:
    """Counts over the blocks ``counted`` for their own pairs and words, or else for those of ``asking``."""
    requests = pair_requests(counted, parts, True, asking is None)
    if asking is not None:
        requests = requests.unionAll(pair_requests(asking, parts, False, True))
    pairs = stored(requests.groupBy("part").applyInArrow(lambda t: tally_pairs(parts, t), MESSAGE), "lm-pairs")
    requests = pairs.where(F.col("kind") == ADDEND).unionAll(word_requests(counted if asking is None else asking, parts))
    words = stored(requests.groupBy("part").applyInArrow(tally_words, MESSAGE), "lm-words")
    return pairs.where(F.col("kind") == ANSWER).unionAll(words)


def fit(docs: DataFrame, target: Column, text_col: str = "text") -> Tables:
    """Both models, from counts over all of ``docs``."""
    blocks = blocked(docs, target, text_col)
    found = blocks.agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).first()
    tokens = (found["n"] or 0, found["n_target"] or 0)
    parts = 1 + tokens[0] // PART_TOKENS
    answers = answered(blocks, None, parts)
    size = answers.where(F.col("kind") == SIZE).agg(F.sum("words")).first()[0] or 0
    return Tables(blocks, answers, parts, tokens, size + 1)


def losses_of(parts: int, tokens: tuple[int, int], size: int, table: pa.Table) -> pa.Table:
    """(g, g2, n, x, y) of a block's texts: tokens and mean losses under both models."""
    kinds, places, data = (table[c].to_pylist() for c in ("kind", "part", "data"))
    words, numbers, sizes, _, g, g2 = map(unpacked, data[kinds.index(TEXTS)])
    a, b, which = pairs_of(words, numbers, sizes)
    found = {ANSWER: np.zeros((2, len(a)), np.int64), WORDS: np.zeros((6, len(words)), np.int64)}
    order = {ANSWER: dealt(words[a], words[b], parts), WORDS: dealt(words, 0, parts)}
    for kind, part, columns in zip(kinds, places, data):
        if kind in found:
            at, starts = order[kind]
            found[kind][:, at[starts[part] : starts[part + 1]]] = [unpacked(x) for x in columns]
    losses = []
    for side in range(2):
        n, (word, context, types) = found[ANSWER][side], found[WORDS][side::2]
        used = (context - DISCOUNT * types)[a]
        share = np.maximum(context[a], 1)
        p = np.maximum(n - DISCOUNT, 0) / share + (1 - used / share) * ((word[b] + 1) / (tokens[side] + size))
        losses.append(-np.add.reduceat(np.log(p)[which], np.cumsum(sizes) - sizes) / sizes)
    return pa.table({"g": g, "g2": g2, "n": sizes, "x": losses[0], "y": losses[1]})


def scored(docs: DataFrame, models: Tables, text_col: str = "text", keep: Sequence[str] | None = None, counted: bool = False) -> DataFrame:
    """Append lm_tokens, background_loss, target_loss and lm_score of every whole text.

    ``counted`` says that the tables were fitted on these very documents, so that their blocks are there.
    """
    keep = docs.columns if keep is None else keep
    outputs = ("lm_tokens", "background_loss", "target_loss", "lm_score")
    kept = [c for c in keep if c.lower() not in outputs]
    blocks, answers = models.blocks, models.answers
    if not counted:
        blocks = blocked(docs, F.lit(False), text_col)
        answers = answered(models.blocks, blocks, models.parts)
    none = F.lit(0).cast("bigint")
    texts = blocks.select(F.lit(TEXTS).alias("kind"), F.lit(0).alias("part"), "block", none.alias("words"), "data")
    messages = texts.unionAll(answers.where(F.col("kind") != SIZE))
    parts, tokens, size = models.parts, models.tokens, models.size
    found = messages.groupBy("block").applyInArrow(lambda t: losses_of(parts, tokens, size, t), "g bigint, g2 bigint, n bigint, x double, y double")
    # Copies of a text have the same losses.
    losses = stored(found.groupBy("g", "g2").agg(*[F.max(c).alias(c) for c in ("n", "x", "y")]), "lm-losses")
    keys = [c.alias(n) for n, c in text_keys(text_col).items()]
    whole_rows = docs.select(F.struct(*[name(c) for c in kept] or [F.lit(0).alias("_none")]).alias("kept"), *keys)
    number = lambda c: F.coalesce(c, F.lit(0.0))
    return whole_rows.join(losses, ["g", "g2"], "left").select(
        *[F.col("kept")[c].alias(c) for c in kept], F.coalesce("n", none).alias("lm_tokens"),
        number("x").alias("background_loss"), number("y").alias("target_loss"), number(F.col("x") - F.col("y")).alias("lm_score"),
    )
