"""Toxicity, licences, chat, decontamination, LM scores and URL rules."""

import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, licences, lm_score, queries, toxicity, url_filter
from tidemark.llm.oracles import ORACLES

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def toxic_rows(spark):
    """Ordinary words everywhere, insults in the toxic ones, and near copies that repeat rare words."""
    rng = np.random.default_rng(1)
    common = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        words = list(rng.choice(common, int(rng.integers(5, 120))))
        bad = i % 5 == 0
        for _ in range(3 * bad):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["vermin", "cretin"])))
        rows.append((i, " ".join(words) + (" rare copied words" if i % 50 == 1 else ""), 1, int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], LABELS), rows


def test_toxicity_held_out(toxic_rows):
    docs, labels, rows = toxic_rows
    model = toxicity.fit(docs, labels.where("doc_id % 3 != 0"))
    got = {r["doc_id"]: r["score"] for r in toxicity.with_differences(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(bad) for i, _, _, bad in rows if i % 3 == 0]
    assert np.mean(held) >= 0.98 and all(0 <= s <= 1 for s in got.values())
    counts = {r["w"]: (r["toxic"], r["ordinary"]) for r in toxicity.continuation_counts(docs.join(labels, "doc_id")).collect()}
    want = {}
    for _, text, _, bad in rows:
        ws = text.split()
        for v, w in zip([None, *ws], ws, strict=False):
            want.setdefault(w, (set(), set()))[1 - bad].add(v)
    assert all(counts[w] == tuple(map(len, sides)) for w, sides in want.items())


def test_toxicity_bigrams(toxic_rows):
    """Counts, ratios and what first words hand on, against plain loops."""
    docs, labels, rows = toxic_rows
    texts = docs.join(labels, "doc_id")
    pairs, counts = toxicity.bigram_counts(texts), toxicity.continuation_counts(texts)
    single = counts.where("not endswith(w, '*')")
    model = toxicity.Model(toxicity.word_ratios(single)[0], 0.1)
    bigrams = toxicity.bigram_ratios(pairs, single, model)
    before = [{}, {}]  # by class: ordinary, toxic
    for _, text, _, bad in rows:
        ws = text.split()
        for u, v, w in zip([None, *ws], ws, ws[1:], strict=False):
            before[bad].setdefault((v, w), set()).add(u)
    n = [{p: len(us) for p, us in side.items()} for side in before]
    got = {(r["v"], r["w"]): (r["ordinary"], r["toxic"]) for r in pairs.collect()}
    assert got == {p: (n[0].get(p, 0), n[1].get(p, 0)) for p in n[0].keys() | n[1].keys()}
    k = toxicity.DISCOUNT
    words = {r["w"]: (r["ordinary"], r["toxic"]) for r in single.collect()}
    total = [sum(c[i] for c in words.values()) for i in (0, 1)]
    low = [sum(min(c[i], k) for c in words.values()) for i in (0, 1)]
    first = [Counter(), Counter()]
    handed = [Counter(), Counter()]
    for i in (0, 1):
        for (v, _), c in n[i].items():
            first[i][v] += c
            handed[i][v] += min(c, k)

    def ratio(v, w):
        weight = [handed[i][v] / first[i][v] if first[i][v] else 1 for i in (0, 1)]
        alone = float(model.ratios([w.encode()])[0])
        if max(n[i].get((v, w), 0) for i in (0, 1)) <= k:
            return alone + np.log(weight[1] / weight[0])
        p = [(max(words[w][i] - k, 0) + low[i] * sum(min(c, k) for c in words[w]) / sum(low)) / total[i] for i in (0, 1)]
        if max(words[w]) <= k:
            p = [np.sqrt(p[0] * p[1]) * np.exp(s * alone / 2) for s in (-1, 1)]
        q = [max(n[i].get((v, w), 0) - k, 0) / max(first[i][v], 1) + weight[i] * p[i] for i in (0, 1)]
        return np.log(q[1] / q[0])

    assert len(bigrams.keys) == sum(max(c) > k for c in got.values()) > 100
    for _, text, _, _ in rows[::20]:
        ws = text.split()
        encoded = [w.encode() for w in ws]
        want = [float(model.ratios(encoded[:1])[0]), *map(ratio, ws, ws[1:])]
        assert np.allclose(bigrams.follow(encoded, model.ratios(encoded)), want)
    fitted = queries.toxicity_model(docs, labels)
    assert len(fitted.bigrams.keys) and fitted.features(b"w1 w2 vermin w3") != fitted.features(b"w3 vermin w2 w1")


def test_toxicity_quoted_passages(spark):
    """Passages that texts of both classes quote say little, however their counts lie about the discount."""
    rng = np.random.default_rng(3)
    common, rows = [f"w{i}" for i in range(60)], []
    for i in range(800):
        words = list(rng.choice(common, int(rng.integers(40, 120))))
        for at in rng.integers(0, len(words), 2):
            words[at] += " " + ("vermin" if i % 2 else "kitten")
        for k in np.flatnonzero(rng.random(30) < 0.05):
            words[int(rng.integers(0, len(words)))] += f" first{k} second{k} third{k}"
        rows.append((i, " ".join(words), 1, i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], LABELS)
    model = queries.toxicity_model(docs, labels)
    insult = model.words[b"vermin"]
    quoted = [model.features(f"first{k} second{k}".encode())[1] for k in range(30)]
    assert insult > 2 and max(map(abs, quoted)) < insult / 2
    got = toxicity.with_differences(docs.where(queries.held_out("doc_id")), model).collect()
    assert np.mean([(r["score"] >= 0.5) == r["doc_id"] % 2 for r in got]) >= 0.98

    texts = docs.join(labels, "doc_id")
    pairs, counts = toxicity.bigram_counts(texts), toxicity.continuation_counts(texts).where("not endswith(w, '*')")
    free, held = (toxicity.bigram_ratios(pairs, counts, model, bounded=b) for b in (False, True))
    n, first = {(r["v"], r["w"]): (r["toxic"], r["ordinary"]) for r in pairs.collect()}, [Counter(), Counter()]
    for (v, _), c in n.items():
        first[0][v] += c[0]
        first[1][v] += c[1]
    names = sorted(free.index)
    differ = 0
    for key, was, now in zip(free.keys, free.ratios, held.ratios, strict=True):
        v, w = (names[x].decode() for x in divmod(key, len(names) + 1))
        seen = np.log((n[v, w][0] + 1) / (first[0][v] + 1) / (n[v, w][1] + 1) * (first[1][v] + 1))
        own = float(model.ratios([w.encode()])[0])
        assert np.isclose(now, min(max(was, min(own, seen)), max(own, seen)))
        differ += was != now
    assert differ > 10 and np.array_equal(free.keys, held.keys) and np.array_equal(free.handed, held.handed)


def test_toxicity_query(spark, sf_dir, texts):
    rows = queries.QUERIES["op1_toxicity"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_odd_rows(spark, odd, empty, toxic_rows):
    docs, labels, _ = toxic_rows
    model = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], LABELS)))
    out = toxicity.with_differences(odd, model).collect()
    assert len(out) == odd.count() and all(r["difference"] == 0 for r in out if not (r["text"] or "").strip())
    none = toxicity.fit(empty, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in toxicity.with_differences(odd, none).collect()} == {0.0}
    assert toxicity.with_differences(empty, model).count() == 0


def test_licence_query(spark, sf_dir, texts):
    of = dict(texts)
    for r in queries.QUERIES["op2_licences"](spark, sf_dir).collect():
        n, places = brute.licence_places(of[r["doc_id"]], licences.PHRASES)
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not places
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 if places else True)


def test_licence_places(spark, empty, odd):
    texts = [
        (1, "Released under the MIT License. All rights reserved, all rights RESERVED"),
        (2, "Licensed under CC BY-NC 4.0 and cc by cc by"),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "general licence public license; mit the under released license"),
        (5, "This work was licensed under the GNU General Public License, version 3."),
        (6, None),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    index = licences.build_index(docs)
    found = {r["doc_id"]: [(m["label"], m["start"]) for m in r["matches"]] for r in licences.scanned(docs, index).collect()}
    assert found[1] == [("mit", 0), ("reserved", 5), ("reserved", 8)]
    assert found[2] == [("cc-by", 2), ("cc-by", 8), ("cc-by", 10), ("cc-by-nc", 0)]
    assert found[3] == [("gpl", 7), ("gpl-3.0", 0)] and found[4] == [] and found[6] == []
    assert ("gpl", 7) in found[5]
    assert licences.scanned(odd, index).count() == odd.count()
    assert licences.build_index(empty).postings and licences.scanned(empty, index).count() == 0


def test_chat_query(spark, sf_dir, duck):
    got = queries.QUERIES["op4_chat"](spark, sf_dir)
    columns = sorted(got.columns)
    cursor = duck.execute(ORACLES["op4_chat"])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[i] for i in at) for r in cursor.fetchall())


def test_chat_parts(spark):
    part = "kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int"
    hard = ["<|turn|>user<|body|>", "<\\|end|>", "[INST] a [/INST] </s>", "<\\\\s> <<SYS>> [\\INST]", "", "plain < [ \\ text", "<|image|>"]
    rows = [(1, i, "assistant" if i % 2 else "us<|body|>er", [("text", t, *[None] * 5)]) for i, t in enumerate(hard)]
    rows += [
        (2, 0, "user", [("text", "see ", *[None] * 5), ("image", None, "a.png", 100, 60, None, None), ("text", "", *[None] * 5),
                        ("audio", None, "b.wav", None, None, 2.0, None), None, ("odd", "x", *[None] * 5)]),
        (2, 1, "assistant", [("text", "one", *[None] * 5), ("document", None, "c.pdf", None, None, None, 3), ("text", "two", *[None] * 5)]),
        (3, None, None, None),
        (None, 1, "assistant", [("text", "x", *[None] * 5)]),
        (3, None, None, None),
    ]
    turns = spark.createDataFrame(rows, f"conv_id bigint, turn int, role string, parts array<struct<{part}>>").withColumn("at", F.lit(9))
    out = chat.formatted(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_mask")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["content"]) for t in got[1]["turns"]] == [(r, p[0][1]) for _, _, r, p in rows[: len(hard)]]
    assert got[1]["loss"] == "".join(hard[1::2])
    assert got[1]["formatted"].count("<|turn|>") == len(hard) == got[1]["n_turns"]
    assert got[2]["turns"][0]["content"] == "see <|image|><|audio|>" and got[2]["loss"] == "onetwo"
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in got[2]["attachments"]] == [
        (1, "image", "a.png", 12), (1, "audio", "b.wav", 25), (2, "document", "c.pdf", 2400)
    ]
    assert got[2]["attachment_tokens"] == 2437
    assert got[3]["n_turns"] == 2 and got[3]["loss"] == "" and got[None]["loss"] == "x"
    assert chat.formatted(turns.limit(0)).count() == 0


def test_leaks_query(spark, sf_dir, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = queries.QUERIES["op6_decontaminate"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute.leaks(texts, items)
    assert all(r["similarity"] >= 0.8 and r["hamming"] <= decontaminate.RADIUS for r in got)


def test_leaks_places(spark, odd, empty):
    item = " ".join(f"word{i}" for i in range(60))
    changed = item.replace("word30", "other")
    broken = item.replace("word30", "other").replace("word10", "x").replace("word50", "y")
    docs = [(1, f"Before, {item.upper()}! after"), (2, f"{changed} and more"), (3, broken), (4, item[: len(item) // 2]), (5, "tiny item"),
            (None, f"start {item}"), (6, f"{item} {item}"), (6, "clean"), (7, None)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("digest", F.lit("x"))
    items = spark.createDataFrame([(10, item), (11, "tiny item"), (12, None), (13, ""), (10, item)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"]) for r in decontaminate.matches(rows, items).collect()}
    assert got == {(1, 10): (1, 60), (2, 10): (0, 60), (None, 10): (1, 60), (6, 10): (0, 60), (5, 11): (0, 2)}
    kept = decontaminate.clean(rows, items)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((d, t or "") for d, t in docs if d in (3, 4, 7) or t == "clean")
    assert decontaminate.clean(odd, items).count() == odd.count()
    assert decontaminate.matches(odd, items.limit(0)).count() == 0 and decontaminate.matches(empty, items).count() == 0


def test_leaks_of_short_items(spark):
    """Eight of an item's nine words share 4 of 5 shingles, 0.8 exactly, however far their SimHashes are."""
    items = [(i, " ".join(f"i{i}w{k}" for k in range(9))) for i in range(1500)]
    docs = spark.createDataFrame([(i, t.rpartition(" ")[0]) for i, t in items], "doc_id bigint, text string")
    rows = decontaminate.matches(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(i, i) for i, _ in items]
    assert max(r["hamming"] for r in rows) > decontaminate.RADIUS


def test_lm_odd_rows(spark, odd, empty):
    rows = lm_score.scored(odd, lm_score.fit(odd, F.col("lang") == "en")).collect()
    assert len(rows) == odd.count()
    assert all(r["lm_score"] == 0 and r["lm_tokens"] == 0 for r in rows if not brute.words(r["text"]))
    same = {r["lm_score"] for r in rows if (r["text"] or "").startswith("Twice")}
    assert len(same) == 1 and {r["lm_tokens"] for r in rows if (r["text"] or "").startswith("Twice")} == {8}
    assert lm_score.scored(empty, lm_score.fit(empty, F.lit(True))).count() == 0


def test_lm_query(spark, sf_dir, texts):
    rows = queries.QUERIES["op9_lm_score"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in texts)
    of = dict(texts)
    assert all(r["lm_tokens"] == len(brute.words(of[r["doc_id"]])) for r in rows)


def test_lm_target_counts_every_label(spark):
    """More labelled ids than any fixed number of them."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    marked = queries.target_marked(docs, labels.unionByName(labels.limit(5)))
    assert marked.count() == marked.where("target").count() == 30_000


def test_lm_tables_count_every_word_and_pair(spark):
    """20,000 words, most of them seen once: each has its own probability, and so has each pair."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([f"r{i}x{k}" for k in range(400)] + [f"c{k}" for k in rng.integers(0, 9, 40)]), i % 3 == 0) for i in range(50)]
    rows += [(50, rows[0][1], True), (51, None, True), (52, "", None)]
    schema = "doc_id bigint, text string, target boolean"
    docs = spark.createDataFrame(rows, schema)
    models = lm_score.fit(docs, F.col("target"))
    news = [(60, "c1 r3x7 never c2 c2", None), (61, rows[4][1], None)]
    got = {r["doc_id"]: r for r in lm_score.scored(docs, models, counted=True).collect()}
    got |= {r["doc_id"]: r for r in lm_score.scored(spark.createDataFrame(news, schema), models).collect()}
    assert len(got) == len(rows) + len(news)
    size = len({w for _, t, _ in rows for w in (t or "").split()}) + 1
    assert models.size == size > 1 << 14
    for loss, chosen in (("background_loss", rows), ("target_loss", [r for r in rows if r[2]])):
        uni, bi, context, used = Counter(), Counter(), Counter(), Counter()
        for _, t, _ in chosen:
            ws = (t or "").split()
            uni.update(ws), bi.update(zip(["", *ws], ws, strict=False)), context.update(["", *ws][: len(ws)])
        for (v, _), n in bi.items():
            used[v] += n - lm_score.DISCOUNT
        total = sum(uni.values()) + size

        def p(v, w):
            c = max(context[v], 1)  # noqa: B023
            return max(bi[v, w] - lm_score.DISCOUNT, 0) / c + (1 - used[v] / c) * (uni[w] + 1) / total  # noqa: B023

        for i, t, _ in [*rows, *news]:
            ws = (t or "").split()
            want = -np.mean([np.log(p(v, w)) for v, w in zip(["", *ws], ws, strict=False)]) if ws else 0
            assert got[i][loss] == pytest.approx(want) and got[i]["lm_tokens"] == len(ws)


def by_hand(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(brute.LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_url_query(spark, sf_dir):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op10_url_filter"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, (rule, verdict) = by_hand(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["confidence"] is not None else "allow"))


def test_url_rules_are_mined(spark):
    good = [f"http://www.site{i % 9}.example/en/{i}" for i in range(300)]
    bad = [f"http://pills{i % 3}.example/shop/{i}?ref=x" for i in range(60)] + [f"https://a.example/shop/x{i}" for i in range(4)]
    odd = [None, "", "no scheme", "HTTP://Upper.EXAMPLE?q", "x://", "a://b://c/d#e?f", "http://h/en/1?ref=x"]
    urls = [*good, *bad, *odd, good[0]]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id bigint, url string, token string")
    labels = spark.createDataFrame(
        [(i, 0 if u in bad else 1, 0) for i, u in enumerate(urls)] + [(None, 0, 0), (1, None, None)], LABELS
    )
    rules = url_filter.mined(pages, labels)
    found = [(frozenset(r["tokens"]), r["confidence"]) for r in rules.collect()]
    sets = {url: frozenset(t) for url, t in pages.select("url", url_filter.tokens_of(F.col("url"))).collect()}
    assert found and sets[None] == sets[""] == sets["no scheme"] == frozenset()
    for tokens, confidence in found:
        have = [u for u in urls if tokens <= sets[u] and sets[u]]
        assert confidence == pytest.approx(sum(u in bad for u in have) / len(have)) and confidence >= 0.5
    got = {r["page_id"]: r for r in url_filter.judged(pages, rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, (rule, verdict) = by_hand(u)
        hit = any(t <= sets[u] for t, _ in found)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if hit else "allow"))
    none = url_filter.mined(pages, labels.limit(0))
    assert none.count() == 0 and {r["verdict"] for r in url_filter.judged(pages, none).collect()} == {"allow"}
    assert url_filter.judged(pages.limit(0), rules).count() == 0


def test_chat_control_strings_split_over_parts(spark):
    """Texts full of marks, cut at random into parts: read back whole, with as many turns as there were."""
    rng = random.Random(5)
    bits = ["<|turn|>", "<|body|>", "<|end|>", "<|image|>", "system", "<", "[", "\\", "|", "<\\|end|>", "[INST]", "<<SYS>>", "</s>", "a b", "", "", "a"]
    rows, want = [], {}
    for conv in range(60):
        for turn in range(3):
            parts, content, texts = [], "", [""]
            for _ in range(rng.randrange(5)):
                kind = rng.choice(["text", "text", "text", "image", "video", None])
                text = "".join(rng.choice(bits) for _ in range(rng.randrange(6)))
                cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(4)))
                pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if kind == "text" else [None]
                parts += [(kind, p, "ref" if kind == "image" else None, 28, 28, None, None) for p in pieces]
                if kind == "text":
                    texts[-1] += text
                elif kind == "image":
                    texts.append("")
            role = rng.choice(["assistant", "us<|er|>", "<|turn|>"])
            rows.append((conv, turn, role, parts))
            want[conv, turn] = (role, texts)
    turns = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    out = chat.formatted(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_mask")))
    got = out.collect()
    assert len(got) == 60
    for r in got:
        expected = [want[r["conv_id"], t] for t in range(3)]
        assert r["n_turns"] == 3 and [t["role"] for t in r["turns"]] == [role for role, _ in expected]
        for t, (_, texts) in zip(r["turns"], expected):
            # An image's mark is the only one that is left; texts that spell one are told apart by the escape.
            assert t["content"] == "<|image|>".join(texts)
        assert r["loss"] == "".join("".join(texts) for role, texts in expected if role == "assistant")
        assert len(r["attachments"]) == sum(len(texts) - 1 for _, texts in expected)
        marked = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_mask"]]
        assert len(marked) == sum(bool(t) for role, texts in expected if role == "assistant" for t in texts)


def test_items_of_one_id_or_none(spark):
    """Items are known by their words: two under one id, one under two ids and one without an id are all found."""
    passage = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    items = [(1, passage(1)), (1, passage(2)), (2, passage(3)), (3, passage(3)), (None, passage(4)), (None, passage(5)), (4, None)]
    docs = [(k, f"before {passage(k)} after") for k in range(1, 7)] + [(7, f"{passage(1)} {passage(2)}")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontaminate.matches(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {(1, 1), (2, 1), (3, 2), (3, 3), (4, None), (5, None), (7, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert decontaminate.clean(frame, spark.createDataFrame(items, "item_id bigint, text string")).count() == 1


def test_multi_index_finds_all_within_the_radius(spark):
    rng = np.random.default_rng(8)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    near = []
    for f in prints:
        for n in range(0, 30):
            mask = sum(1 << int(b) for b in rng.choice(64, n, replace=False))
            near.append((f & (2**64 - 1)) ^ mask)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    windows = spark.createDataFrame([(i, 5, signed(x)) for i, x in enumerate(near)], "w bigint, size int, f bigint")
    items = spark.createDataFrame([(bytes([i]), 5, f) for i, f in enumerate(prints)], "item binary, size int, g bigint")
    got = {(r["w"], r["item"][0], r["hamming"]) for r in decontaminate.within_radius(windows, items, ["w", "size"]).collect()}
    apart = lambda x, f: bin((x ^ f) & (2**64 - 1)).count("1")
    want = {(w, i, apart(x, f)) for w, x in enumerate(near) for i, f in enumerate(prints) if apart(x, f) <= decontaminate.RADIUS}
    assert got == want and len(want) >= 800


def test_licence_labels_equal_all_places(spark, texts):
    """Every place of every notice by plain comparison, on real texts and on notices with words changed."""
    rng = random.Random(6)
    changed = []
    for k, t in enumerate(licences.templates()):
        words = [w.decode() for w in t.words]
        for n in range(4):
            copy = ["other" if rng.random() < 0.1 * n else w for w in words]
            changed.append((10_000 + 10 * k + n, f"Before it. {' '.join(copy)}, after {words[0]}"))
    rows = [*texts, *changed]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["matches"] for r in licences.scanned(docs, licences.build_index(docs)).collect()}
    found = 0
    for i, text in rows:
        words, want = [w.encode() for w in brute.words(text)], []
        for t in licences.templates():
            a, b = t.key
            for start in range(len(words) - b + 1):
                if tuple(words[start + a : start + b]) == t.words[a:b]:
                    share = sum(x == y for x, y in zip(t.words, words[start : start + len(t.words)])) / len(t.words)
                    if share >= licences.ENOUGH:
                        want.append((t.label, start, len(t.words), share, t.base))
        assert [tuple(m) for m in got[i]] == sorted(want), i
        found += sum(not w[4] for w in want)
    assert found > 40


def test_toxicity_scores_equal_loops(spark):
    """Differences, peaks and scores from counts made by hand."""
    rng = random.Random(7)
    mild, foul = [f"mild{i}" for i in range(40)], [f"foul{i}" for i in range(12)]
    rows = []
    for i in range(400):
        toxic = int(i % 3 == 0)
        rows.append((i, " ".join(rng.choice(foul if toxic and rng.random() < 0.4 else mild) for _ in range(25)), toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, t int")
    labels = docs.select("doc_id", F.col("t").alias("toxic"))
    model = toxicity.fit(docs, labels)
    held = {r[0] for r in docs.where(F.expr(f"pmod(xxhash64(text), {toxicity.CALIBRATION}L)") == 0).select("doc_id").collect()}
    before = {0: {}, 1: {}}
    for i, text, toxic in rows:
        if i in held:
            continue
        ws = text.split()
        for v, w in zip([None, *ws], ws):
            for unit in (w, w[: toxicity.STEM] + toxicity.STEM_MARK if len(w) > toxicity.STEM else None):
                if unit:
                    before[toxic].setdefault(unit, set()).add(v)
    count = lambda unit, c: len(before[c].get(unit, ()))

    def ratios(units, k):
        total = {c: sum(count(u, c) for u in units) for c in (0, 1)}
        low = {c: sum(min(count(u, c), k) for u in units) for c in (0, 1)}
        p = lambda u, c: max(count(u, c) - k, 0) / total[c] + low[c] / total[c] * sum(min(count(u, x), k) for x in (0, 1)) / sum(low.values())
        own = {u: np.log(p(u, 1) / p(u, 0)) for u in units if max(count(u, 0), count(u, 1)) > k}
        return own, np.log(low[1] / total[1] / (low[0] / total[0]))

    units = before[0].keys() | before[1].keys()
    words, _ = ratios([u for u in units if not u.endswith("*")], toxicity.DISCOUNT)
    stems, other = ratios([u for u in units if u.endswith("*")], toxicity.DISCOUNT * toxicity.STEM_FACTOR)
    assert words and stems
    a, b, c = model.weights
    for r in toxicity.with_differences(docs, model).collect():
        rs = [words.get(w, stems.get(w[: toxicity.STEM] + "*", other)) for w in r["text"].split()]
        mean, peak = np.mean(rs), max((x + y) / 2 for x, y in zip(rs, rs[1:]))
        assert r["difference"] == pytest.approx(mean) and r["peak"] == pytest.approx(peak)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(a + b * mean + c * peak, -30, 30))))
