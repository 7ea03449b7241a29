"""Mixing, hard negatives and clustering against SQL and plain loops, and on odd rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clustering, hard_negatives, mixing, queries
from tidemark.llm.oracles import ORACLES

INF, NAN = float("inf"), float("nan")
VECTORS = "vec_id bigint, label int, embedding array<float>, score string, rank string, cluster string, part string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "s", "r", "c", "p") for r in rows], VECTORS)


@pytest.mark.parametrize("name", ["op11_mixing", "op12_hard_negatives", "op13_clustering"])
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    cursor = duck.execute(ORACLES[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    tidy = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    want = Counter(tidy(r[i] for i in at) for r in cursor.fetchall())
    assert Counter(tidy(r[c] for c in columns) for r in got.collect()) == want
    assert sum(want.values()) > 0


# Mixing


def level(sizes, weights, most=3):
    """Targets by giving each its share, capping those above, and sharing the excess again."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        share = rest / sum(weights[i] for i in free) if free else 0
        above = {i for i in free if share * weights[i] > most * sizes[i]}
        if not above:
            return [most * sizes[i] if i in capped else share * weights[i] for i in range(len(sizes))]
        capped |= above


@pytest.mark.parametrize("sizes", [(5, 1000, 1, 40), (1, 1, 1), (0, 7, 0), (300, 2, 100, 5, 1, 90, 1)])
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size bigint")
    got = [r["target"] for r in mixing.targets(rows).orderBy("number").collect()]
    want = level(sizes, [1 + i % 3 for i in range(len(sizes))])
    assert np.allclose(got, want)


def test_mix_is_near_its_targets_and_evenly_spread(spark, documents, sf_dir):
    made, schedule = mixing.mixed(documents)
    rows = made.collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 3 * mixing.BLOCK_WORDS for s, t in target.items())
    cells = schedule.orderBy("slot", "position").collect()
    assert Counter(c["doc_id"] for c in cells for _ in range(c["words"])) == Counter(
        {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    )
    # Every stretch of the mix holds each source by its weight.
    whole = sum(target.values())
    stretch = len({c["slot"] for c in cells}) // 4
    for at in range(4):
        part = Counter()
        for c in cells:
            if at * stretch <= c["slot"] < (at + 1) * stretch:
                part[c["source"]] += c["words"]
        assert all(abs(part[s] - t / whole * stretch * 64) <= 4 * 64 for s, t in target.items())
    again = Counter(map(tuple, mixing.mixed(documents)[0].collect()))
    assert again == Counter(map(tuple, rows))


def test_mix_with_cut_segments(spark, documents, monkeypatch):
    want = Counter(map(tuple, mixing.mixed(documents)[0].collect()))
    monkeypatch.setattr(mixing, "SEGMENT", 7)
    assert Counter(map(tuple, mixing.mixed(documents)[0].collect())) == want


def test_mix_odd_rows(odd, empty):
    odd = odd.withColumn("source", F.when(F.col("lang") != "en", F.col("lang")))
    clash = odd.withColumns({c: F.lit("x") for c in ("number", "slot", "start", "size", "target", "epoch", "high", "piece")})
    made, schedule = mixing.mixed(clash)
    rows = made.collect()
    assert len(rows) == odd.count()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    assert sum(r["taken"] for r in rows) == schedule.agg(F.sum("words")).first()[0]
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    empty_mix = mixing.mixed(empty.withColumn("source", F.lit("a")))
    assert [df.count() for df in empty_mix] == [0, 0]
    blank = mixing.mixed(odd.where("coalesce(trim(text), '') = ''"))
    assert blank[0].count() == 3 and blank[1].count() == 0


# Hard negatives


def plain_negatives(rows, anchor, positives=5, negatives=3):
    out = []
    for a, la, va in rows:
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, _, v in rows}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))  # noqa: B023, E731
        for p in first([i for i, lab, _ in rows if lab == la and i != a])[:positives]:
            inside = [i for i, lab, _ in rows if lab != la and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(first(inside)[:negatives])]
    return out


@pytest.mark.parametrize(("seed", "spread", "dims"), [(0, 1.0, 6), (1, 0.02, 3), (2, 9.0, 1)])
def test_negatives_equal_plain_loops(spark, monkeypatch, seed, spread, dims):
    """Also with a large group of near copies, many ties, and blocks of a few rows."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, spread, (90, dims)), np.round(rng.normal(1, 0.01, (60, dims)), 2)]).astype("f4")
    rows = [(i, int(rng.integers(0, 3)), [float(c) for c in v]) for i, v in enumerate(x)]
    for name, n in (("BLOCK_ROWS", 20), ("BLOCK_ANCHORS", 4), ("AT_ONCE", 3)):
        monkeypatch.setattr(hard_negatives, name, n)
    got = hard_negatives.mined(vectors(spark, rows), F.col("vec_id") % 7 == 0)
    ints = [(i, lab, [int(np.floor(256 * float(c))) for c in v]) for i, lab, v in rows]
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(ints, lambda i: i % 7 == 0))


def test_indexed_and_omitted_parts_bound_scores():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 100, (50, 16))
    indexed, norms = hard_negatives.omitted_parts(x, 60.0)
    assert (indexed == 0).any() and (norms < 60.0).all()
    a = rng.normal(0, 1, 16)
    assert (np.abs(x @ a - indexed @ a) <= np.linalg.norm(a) * norms + 1e-9).all()


def test_negatives_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.7, 0.0]), (2, 2, [0.7, 0.0]), (3, None, [1.0, 0.0]), (None, 1, [1.0, 0.0]),
        (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [INF, 1.0]), (7, 2, [NAN, 1.0]), (8, 2, []), (9, 2, [0.6]), (10, 2, [0.6, 0.1, 5.0]),
    ]
    got = hard_negatives.mined(vectors(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["positive_id"], r["negative_id"]) for r in got] == [(1, 2), (1, 9), (1, 10)]
    assert hard_negatives.mined(vectors(spark, []), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mined(vectors(spark, rows), F.col("vec_id") == 99).count() == 0


# Clustering


def test_nearest_equals_all_distances():
    rng = np.random.default_rng(4)
    for spread, k, dims in ((50, 16, 64), (2, 7, 3), (1, 5, 1), (3, 1, 4)):
        x = rng.integers(-spread, spread + 1, (300, dims))
        c = rng.integers(-spread, spread + 1, (k, dims))
        every = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        which, best = clustering.nearest(x, c)
        assert (which == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        assert len(clustering.nearest(x[:0], c)[0]) == 0


def test_clusters_odd_rows(spark):
    rows = [(None, 0, [1.0, 2.0]), (1, 0, None), (2, 0, [1.0]), (3, 0, [1.0, None]), (4, 0, [NAN, 1.0]), (5, None, [-3.0, -2.5]), (5, 0, [1.0, 2.0])]
    frame = vectors(spark, rows)
    got, centroids = clustering.clustered(frame, dims=2)
    assert sorted((r["vec_id"] or -1, r["distance"]) for r in got.collect()) == [(-1, 0), (5, 0), (5, 0)]
    assert len(centroids) == 3
    got, centroids = clustering.clustered(frame, k=1, dims=2, scale=1)
    assert centroids.tolist() == [[-1, 0]]  # floor((1 + 1 - 3) / 3), floor((2 + 2 - 3) / 3)
    assert got.agg(F.sum("distance")).first()[0] == sum((x + 1) ** 2 + y**2 for x, y in ((1, 2), (1, 2), (-3, -3)))
    assert clustering.clustered(vectors(spark, []))[0].count() == 0
