"""Lloyd's clustering of integer vectors; nearest centroids by the threshold algorithm.

For every dimension the centroids are listed by their value. From a vector's value each list
is walked outward, nearest first. A centroid met for the first time is compared exactly. What
none of the lists has shown yet is at least as far as the squares of the gaps at all frontiers
added up, so a vector stops as soon as that sum strictly exceeds its best exact distance: a
tie with a smaller number is never missed. Vectors of a batch walk side by side in numpy, and
those that have stopped leave.

Sums and distances are whole numbers, so the result does not depend on how rows are grouped.
Only the centroids, ``k`` x dimensions numbers, pass through the driver and to the tasks;
every round adds up within tasks before its sums are shuffled.

Rows: a vector of another length, a NULL one, and one with a NULL or non-finite component is
left out; a NULL id is kept (as a first centroid it comes last); with fewer vectors than
``k`` there are as many centroids; without any the result is empty. Repeated rows count as
often as they stand there. Exact while distances fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .text import name

WORK_ROWS = 4096
ASSIGNED = "cluster int, distance bigint"


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, q) of the vectors that take part, q = floor(scale * x), written."""
    of = F.col("v")
    sound = F.forall(of, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    narrow = rows.select(name(vec_id).cast("bigint").alias("vec_id"), name(vector).cast("array<double>").alias("v"))
    kept = narrow.where((F.size(of) == dims) & sound)
    return stored(kept.select("vec_id", F.transform(of, lambda x: F.floor(x * scale)).alias("q")), "vectors")


def first_centroids(vectors: DataFrame, k: int, seed: Column) -> np.ndarray:
    rows = vectors.orderBy(F.asc_nulls_last(seed), "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; ties to the smaller number."""
    n, k = len(x), len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")  # by dimension: the list of centroid numbers
    values = np.take_along_axis(centroids, order, axis=0)
    dims = np.arange(x.shape[1])
    best = np.full(n, np.iinfo(np.int64).max)
    which = np.full(n, k)
    active = np.arange(n)
    seen = np.zeros((n, k), bool)
    # above: entries below the vector's value, that is where its value would be put in.
    above = np.stack([np.searchsorted(values[:, d], x[:, d]) for d in dims], axis=1)
    below = above - 1
    far = np.iinfo(np.int64).max
    while len(active):
        at = x[active]
        down = np.where(below >= 0, at - values[np.maximum(below, 0), dims], far)
        up = np.where(above < k, values[np.minimum(above, k - 1), dims] - at, far)
        lower = down <= up
        gap = np.minimum(down, up)
        left = gap < far  # a list that has shown all centroids has no frontier: none is unseen
        if left.all():
            go = (gap * gap).sum(axis=1) <= best[active]
            active, at, below, above, lower = active[go], at[go], below[go], above[go], lower[go]
        else:
            break
        shown = order[np.where(lower, below, above), dims]
        fresh = np.zeros((len(active), k), bool)
        fresh[np.arange(len(active))[:, None], shown] = True
        fresh &= ~seen[active]
        row, number = np.nonzero(fresh)  # in the order of numbers within a row
        seen[active[row], number] = True
        apart = at[row] - centroids[number]
        exact = np.einsum("ij,ij->i", apart, apart)
        nearer = np.lexsort((number, exact, row))
        row, number, exact = row[nearer], number[nearer], exact[nearer]
        head = np.flatnonzero(np.diff(row, prepend=-1))
        who, number, exact = active[row[head]], number[head], exact[head]
        win = (exact < best[who]) | ((exact == best[who]) & (number < which[who]))
        best[who[win]], which[who[win]] = exact[win], number[win]
        below, above = below - lower, above + ~lower
    return which.astype(np.int32), best


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every vector with its cluster and the squared distance to its centroid."""
    dims = centroids.shape[1]
    made = T.StructType.fromDDL(ASSIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, WORK_ROWS):
                part = batch.slice(start, WORK_ROWS)
                found = nearest(matrix(part.column(1), dims), centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], names=["vec_id", *made.names])

    return vectors.mapInArrow(run, T.StructType([vectors.schema["vec_id"], *made.fields]))


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each cluster; an empty one stays.

    A task adds up its own vectors and emits a row for each cluster and dimension.
    """
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, WORK_ROWS):
                x = matrix(batch.column(1).slice(start, WORK_ROWS), dims)
                which, _ = nearest(x, centroids)
                np.add.at(total, which, x)
                count += np.bincount(which, minlength=k)
        some = np.repeat(np.flatnonzero(count), dims)
        at = np.tile(np.arange(dims), len(some) // dims)
        columns = [some, at, total[some, at], count[some]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["c", "d", "s", "n"])

    sums = vectors.mapInArrow(run, "c bigint, d bigint, s bigint, n bigint").groupBy("c", "d").agg(F.sum("s"), F.sum("n"))
    out = centroids.copy()
    for c, d, s, n in sums.collect():  # k x dimensions rows at most
        out[c, d] = s // n
    return out


def clustered(
    rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector after the last round, the centroids).

    First centroids are the ``k`` vectors with the smallest sha256 of "seed:id", which a
    rerun repeats.
    """
    vectors = whole_vectors(rows, vec_id, vector, dims, scale)
    token = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = first_centroids(vectors, k, token)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return stored(assigned(vectors, centroids), "clusters"), centroids
