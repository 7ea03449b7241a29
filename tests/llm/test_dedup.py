"""Exact and near dedup against plain loops, and their filters, anchors and components."""

import hashlib
from collections import Counter

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import components, exact_dedup, queries, simhash
from tidemark.llm.oracles import ORACLES


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=700, unique=True), st.integers(0, 2**32))
def test_filter_holds_all_and_little_else(keys, seed):
    keys = np.array(keys, np.uint64)
    parts = exact_dedup.build_filter(keys)
    assert exact_dedup.in_filter(keys, *parts).all()
    others = np.setdiff1d(np.random.default_rng(seed).integers(0, 2**63, 4000).astype(np.uint64), keys)
    assert exact_dedup.in_filter(others, *parts).mean() < 0.02


def test_exact_query(spark, sf_dir, duck):
    got = queries.QUERIES["op5_exact_dedup"](spark, sf_dir)
    columns = sorted(got.columns)
    cursor = duck.execute(ORACLES["op5_exact_dedup"])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = Counter(tuple(r[i] for i in at) for r in cursor.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_screen_lets_all_known_through(spark, documents):
    half = documents.where("doc_id % 2 = 0")
    snapshot = exact_dedup.take_snapshot(half)
    batch = exact_dedup.grouped(documents.select("doc_id", exact_dedup.sha256(F.col("text")).alias("digest")))
    passed = exact_dedup.screened(batch, snapshot)
    known = half.select(exact_dedup.sha256(F.col("text")).alias("digest")).distinct()
    assert known.join(passed, "digest", "left_anti").count() == 0
    assert passed.count() < batch.count()


def test_exact_odd_rows(odd, empty):
    for early in (F.col("lang").eqNullSafe("en"), F.lit(True), F.lit(False)):
        out = exact_dedup.deduplicated_with(odd, early)
        assert out.columns == odd.columns
        best = {}
        for r in odd.collect():
            t = r["text"] or ""
            best[t] = max(best.get(t, -1), -1 if r["doc_id"] is None else r["doc_id"])
        got = [(r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in out.collect()]
        assert sorted(got) == sorted(best.items())
    assert exact_dedup.deduplicated_with(empty, F.lit(True)).count() == 0
    assert exact_dedup.deduplicated(empty).count() == 0


def test_colliding_digests_are_told_apart(odd):
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    digests, groups = exact_dedup.duplicate_groups(odd, digest=weak)
    want = {n for n in Counter(r["text"] or "" for r in odd.collect()).values() if n > 1}
    assert {r["n"] for r in groups.collect()} == want and digests.count() == odd.count()


def test_anchors_cover(spark):
    rng = np.random.default_rng(3)
    low = np.array([simhash.home(np.array([x], np.int64))[0] for x in (0, 1, -1)])
    assert low[0] == low[1]
    points = rng.integers(-(2**63), 2**63 - 1, 400)
    index, anchor = simhash.anchors(points)
    reach = [set(anchor[index == i].tolist()) for i in range(len(points))]
    assert np.bincount(index).mean() < 20
    for i, p in enumerate(points[:100]):
        a, b = rng.choice(64, 2, replace=False)
        near = np.array([p], np.int64).view(np.uint64) ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b))
        assert reach[i] & set(simhash.anchors(near.view(np.int64))[1].tolist())


def test_links_against_all_pairs(spark):
    """A dense cluster, a chain and lone points: the same classes as by comparing all pairs."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    prints = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.choice(64, (150, 2))}
    chain, now = [], int(rng.integers(0, 2**62))
    for b in range(0, 60, 2):
        now ^= 3 << b
        chain.append(now)
    prints = sorted({*prints, *chain, 0, *map(int, rng.integers(0, 2**62, 60))})
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id bigint, f bigint")
    got = {r["f"]: r["component_id"] for r in simhash.classes(rows).collect()}
    assert [got[p] for p in signed] == brute.classes(prints)


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(7)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 80, (70, 2))] + [(100, i) for i in range(101, 140)]
    edges += [(200 + i, 201 + i) for i in range(40)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    looped = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {n: r for n, r in root.items() if n not in looped}


def test_near_query(spark, sf_dir, texts):
    ids, prints = [i for i, _ in sorted(texts)], [brute.fingerprint(t) for _, t in sorted(texts)]
    want = {i: (format(f, "016x"), ids[c]) for i, f, c in zip(ids, prints, brute.classes(prints), strict=True)}
    rows = queries.QUERIES["op8_simhash"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want and len(rows) == len(texts)


def test_near_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    prints = {r["fingerprint"] for r in rows}
    assert {format(brute.fingerprint(r["text"]), "016x") for r in odd.collect()} == prints
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    # Zero fingerprint: 3, 4, 5 and a NULL id; the smallest id stays.
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7, 8, 9]
    only_null = odd.where("doc_id is null")
    assert simhash.representatives(only_null).count() == 2
    assert simhash.representatives(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
