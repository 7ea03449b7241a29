"""Hard negatives by threshold joins over inverted indexes, after L2AP (Anastasiu, Karypis, 2014).

Anchors are compared with all rows, in blocks. A block's index holds its vectors' components
by dimension. Of each vector the smallest components are left out as long as the norm of
what is left out stays under a share of the threshold: a pair at the threshold is found
by the others. Scores are added up along the lists, first over the dimensions that
weigh most; then a row is dropped if what it has and the norms of the remaining and of the
omitted components cannot reach the threshold. What is left is scored exactly.

Thresholds fall until windows fill. A window asks for the best ``k`` rows between two scores.
It is searched down to a high threshold first; if too few rows are found there, the next
round goes lower, until the window's own lower end. Only windows that are not filled go on,
and each task returns ``k`` rows of a block for each window at most, so copies that a third
of all rows share cost no more. First the positives of each anchor are found so, then, when
their scores bound the windows, the negatives. A positive whose score is below 0 has an
empty window, so no search goes below 0.

Index lists are dense columns of a block in which omitted components are 0: the vectors meant
here have few zeros, and a matrix product then adds up many anchors at once.

Rows: without id, label or vector, or with a NULL or non-finite component, a row takes no
part; of rows that share an id the one with the smallest label, then vector, counts;
vectors of different lengths are compared as if the shorter ones ended in zeros; empty
tables give empty results. Exact while scores fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .text import name

# Rows and anchors that meet in one Python group, and anchors that are scored at once.
BLOCK_ROWS = 4096
BLOCK_ANCHORS = 8192
AT_ONCE = 64
PAIRS = 32_768  # that are scored exactly at once
# Of the threshold: how much of it the omitted components of a row may be worth.
OMITTED = 0.3
# Thresholds of the rounds: of an anchor's own norm squared, and of a positive's score.
POSITIVE_STEPS = (0.5, 0.35, 0.2, 0.0)
NEGATIVE_STEPS = (0.85, 0.7, 0.0)

FOUND = "anchor_id bigint, part bigint, id bigint, score bigint"


def whole_vectors(rows: DataFrame, vec_id: str, label: Column, vector: str, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v = floor(scale * x) and equally long, written."""
    of = F.col("v")
    sound = F.forall(of, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    narrow = rows.select(
        name(vec_id).cast("bigint").alias("vec_id"), label.cast("int").alias("label"), name(vector).cast("array<double>").alias("v")
    )
    kept = narrow.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & of.isNotNull() & sound)
    ints = kept.withColumn("v", F.transform(of, lambda x: F.floor(x * scale)))
    one = ints.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*")
    return stored(one, "hard-negative-rows")


def partial_norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def omitted_parts(x: np.ndarray, worth: float) -> tuple[np.ndarray, np.ndarray]:
    """(indexed, norms): the vectors with their smallest components 0, and the norms of what that omits.

    As many components as stay under the norm ``worth``.
    """
    order = np.argsort(np.abs(x), axis=1)
    squares = np.cumsum(np.take_along_axis(x * x, order, axis=1), axis=1)
    out = squares < worth * worth
    mask = np.zeros(x.shape, bool)
    np.put_along_axis(mask, order, out, axis=1)
    indexed = np.where(mask, 0.0, x)
    return indexed, partial_norms(x - indexed)


def search_block(
    anchors: np.ndarray, lows: np.ndarray, rows: np.ndarray, allowed, dims_first: np.ndarray, dims_rest: np.ndarray
):
    """Yields (anchor numbers, row numbers, exact scores) of all allowed pairs that reach an anchor's low."""
    a, x = anchors.astype(np.float64), rows.astype(np.float64)
    norms = partial_norms(a)
    slack = 1e-9 * (1 + norms * (partial_norms(x).max() if len(x) else 0))
    worth = OMITTED * np.min(np.maximum(lows, 0) / np.maximum(norms, 1)) if len(a) else 0.0
    indexed, omitted = omitted_parts(x, worth)
    first, rest = indexed[:, dims_first].T, indexed[:, dims_rest]
    rest_norms, rest = partial_norms(rest), rest.T
    # Products below 2^53 are exact in floating point, also when added up.
    small = max(1, np.abs(anchors).max(initial=0)) * max(1, np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) < 2**53
    for start in range(0, len(a), AT_ONCE):
        part = slice(start, start + AT_ONCE)
        goal = (lows[part] - slack[part])[:, None]
        score = a[part][:, dims_first] @ first
        reach = np.outer(partial_norms(a[part][:, dims_rest]), rest_norms) + np.outer(norms[part], omitted)
        alive = np.flatnonzero((score + reach >= goal).any(axis=0))
        if not len(alive):
            continue
        score = score[:, alive] + a[part][:, dims_rest] @ rest[:, alive]
        score += np.outer(norms[part], omitted[alive])
        who, which = np.nonzero(score >= goal)
        which = alive[which]
        who = who + start
        fine = allowed(who, which)
        who, which = who[fine], which[fine]
        left, right = (a, x) if small else (anchors, rows)
        exact = np.empty(len(who), np.int64)
        for at in range(0, len(who), PAIRS):
            some = slice(at, at + PAIRS)
            exact[some] = np.einsum("ij,ij->i", left[who[some]], right[which[some]])
        fine = exact >= lows[who]
        yield who[fine], which[fine], exact[fine]


def search(rows: DataFrame, queries: DataFrame, same: bool, k: int, dims: int, blocks: int, chunks: int) -> DataFrame:
    """The ``k`` best rows of each window of each anchor: of its label, or of the others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            flat = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dims)
            anchors, vectors = flat(left), flat(right)
            ids, labels = (right.column(c).to_numpy() for c in ("vec_id", "label"))
            anchor_ids, anchor_labels = (left.column(c).to_numpy() for c in ("anchor_id", "label"))
            windows = left.column("windows").to_pylist()
            bounds = np.full((3, max(map(len, windows)), len(windows)), -1, np.int64)
            bounds[1] = np.iinfo(np.int64).max  # a window that is not there starts above all scores
            for i, several in enumerate(windows):
                for j, w in enumerate(several):
                    bounds[:, j, i] = w["part"], w["low"], w["high"]
            heavy = np.argsort(-np.abs(anchors).sum(axis=0), kind="stable")
            half = dims // 2
            allowed = lambda a, r: ((anchor_labels[a] == labels[r]) == same) & (anchor_ids[a] != ids[r])
            lows = bounds[1].min(axis=0)
            for who, which, score in search_block(anchors, lows, vectors, allowed, heavy[:half], heavy[half:]):
                for part, low, high in zip(*bounds, strict=True):
                    inside = (score >= low[who]) & (score <= high[who])
                    w, r, s = who[inside], which[inside], score[inside]
                    order = np.lexsort((ids[r], -s, w))
                    w, r, s = w[order], r[order], s[order]
                    head = np.flatnonzero(np.diff(w, prepend=-1))
                    rank = np.arange(len(w)) - np.repeat(head, np.diff(head, append=len(w)))
                    best = rank < k
                    w, r, s = w[best], r[best], s[best]
                    for into, column in zip(found, (anchor_ids[w], part[w], ids[r], s), strict=True):
                        into.append(column)
        names = [c.split()[0] for c in FOUND.split(", ")]
        joined = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in found]
        return pa.table([pa.array(c) for c in joined], names=names)

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda c, n: F.expr(f"cast(pmod(xxhash64({c}), {n}) as int)")
    left = queries.withColumn("chunk", spread("anchor_id", chunks)).withColumn("block", each(blocks))
    right = rows.withColumn("block", spread("vec_id", blocks)).withColumn("chunk", each(chunks))
    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(run, FOUND)
    line = Window.partitionBy("anchor_id", "part").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def filled(
    rows: DataFrame, windows: DataFrame, same: bool, k: int, steps: Sequence[float], dims: int, blocks: int, chunks: int
) -> DataFrame:
    """The best ``k`` rows of every window (anchor_id, label, v, part, base, low, high).

    Round by round the threshold is the next step of ``base``, or the window's own ``low``
    if that is higher.
    """
    out, left = [], windows
    for step in steps:
        start = F.greatest("low", F.ceil(F.col("base") * step)).alias("low") if step else F.col("low")
        asked = left.groupBy("anchor_id").agg(
            F.first("label").alias("label"), F.first("v").alias("v"),
            F.collect_list(F.struct("part", start, "high")).alias("windows"),
        )
        found = stored(search(rows, asked, same, k, dims, blocks, chunks), "hard-negatives")
        full = found.groupBy("anchor_id", "part").agg(F.count("*").alias("_n"))
        # The window's own end has been reached, or there are enough rows above the threshold.
        done = (F.coalesce("_n", F.lit(0)) >= k) | (start <= F.col("low"))
        marked = stored(left.join(full, ["anchor_id", "part"], "left").withColumn("_done", done), "hard-negative-windows")
        closed = marked.where("_done").select("anchor_id", "part")
        out.append(found.join(closed, ["anchor_id", "part"], "left_semi"))
        left = marked.where("not _done").drop("_n", "_done")
        if left.isEmpty():
            break
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return every


def mined(
    docs: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    vec_id: str = "vec_id", label: Column | None = None, vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on ``vec_id``. A row's score is its inner product with the anchor; higher scores come
    first, ties by smaller id. An anchor's positives are its best ``positives`` rows of the
    same label; a positive's negatives are the best ``negatives`` rows of other labels whose score is
    between ``low`` and ``high`` percent of the positive's.
    """
    rows = whole_vectors(docs, vec_id, F.col("label") if label is None else label, vector, scale)
    dims, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    dims = dims or 0
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("v"))
    rows = rows.withColumn("v", F.concat("v", zeros))
    anchors = rows.where(anchor).withColumnRenamed("vec_id", "anchor_id")
    blocks, chunks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-anchors.count() // BLOCK_ANCHORS))
    square = F.aggregate("v", F.lit(0).cast("bigint"), lambda t, x: t + x * x)
    none, all_scores = F.lit(0).cast("bigint"), F.lit(2**63 - 1)
    ask = anchors.withColumns({"part": none, "base": square, "low": none, "high": all_scores})
    best = filled(rows, ask, True, positives, POSITIVE_STEPS, dims, blocks, chunks)
    best = stored(best.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    ask = anchors.join(best, "anchor_id").select(
        "anchor_id", "label", "v", F.col("positive_id").alias("part"), score.alias("base"),
        F.expr(f"(positive_score * {low} + 99) div 100").alias("low"), F.expr(f"positive_score * {high} div 100").alias("high"),
    )
    found = filled(rows, ask, False, negatives, NEGATIVE_STEPS, dims, blocks, chunks).withColumnsRenamed(
        {"part": "positive_id", "id": "negative_id", "score": "negative_score"}
    )
    return found.join(best, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
