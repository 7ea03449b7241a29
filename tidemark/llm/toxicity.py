"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, count for each word the distinct words it
follows (continuation counts), so a text that was copied a thousand times counts once.
Both discount the same way and hand what they discount to one shared distribution made
of exactly these discounts, as Kneser-Ney prescribes for backing off: with the counts
N_c(w) and the discount K,

    P_c(w) = (N_c(w) - min(N_c(w), K)) / T_c + lambda_c * P_shared(w),
    P_shared(w) ~ sum over both classes of min(N_c(w), K).

A word that neither class has seen after more than K different words has no ratio of its
own. It backs off to its stem, the words that share its first characters, counted in the
same way, and if that is rare as well, says nothing about the class.

On top stand bigrams, interpolated with the words by each class's own weight:

    P_c(w | v) = (N_c(vw) - min(N_c(vw), K)) / N_c(v) + lambda_c(v) * P_c(w),
    lambda_c(v) = sum over w of min(N_c(vw), K) / N_c(v).

N_c(vw) is a continuation count too, the distinct words before the bigram, and N_c(v) its
sum over w: near copies repeat bigrams, and counted once a text they would outvote the rest.
The first word of a text has P_c(w).

The discount takes up to K counts from each class, so a bigram seen 12 times in one class
and 8 in the other keeps counts in one only, and against the back-off weight of a rare word
these few would outweigh any insult: passages that many texts quote begin with such bigrams.
So its log ratio is held between the word's own and that of the whole counts with one added,
(N_c(vw) + 1) / (N_c(v) + 1).

A text is described by the difference of the two log-likelihoods, normalised by length,
over the whole text and over its most toxic passage; both go through a logistic curve
fitted on labelled texts that the counts have not seen.

Defined results: NULL, empty texts and texts without words have difference 0; without
labels of both classes the score is the share of toxic labels (0 without any). Labels
that are NULL or have no id are left out, of several for one id the largest counts. Other
columns pass through; a column named like an output is replaced. Empty tables give empty
results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import stored
from .text import WORD, appended, lower_ascii, name, whole

CLASSES = ("toxic", "ordinary")
MAX_DOCS = 8000  # labelled rows of each class that are fitted on: a sample by hash of the id
DISCOUNT = 8
PASSAGE = 2  # words
STEM = 4  # first characters of a longer word, to which a rare word backs off
STEM_FACTOR = 6  # stems gather many words, and need that much more evidence
STEM_MARK = "*"  # no word has it
CACHE = 1 << 17
CALIBRATION = 4  # every fourth of the fitted rows sets the curve instead of the counts


@dataclass
class Bigrams:
    """Log ratios of the bigrams that have one of their own, and of what their first words hand on.

    Words are numbered; a bigram is one integer, and both sorted arrays hold no objects.
    """

    index: dict[bytes, int] = field(default_factory=dict)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(0))
    handed: np.ndarray = field(default_factory=lambda: np.zeros(1))  # by the first word's number; 0 beyond

    def follow(self, words: list[bytes], ratios: np.ndarray) -> np.ndarray:
        """The ratios of words, each given the word before it, from those without it."""
        if not len(self.keys) or len(words) < 2:
            return ratios
        get, n = self.index.get, len(self.index)
        numbers = np.array([get(w, n) for w in words])  # n: a word of no such bigram
        before, after = numbers[:-1], numbers[1:]
        key = before * (n + 1) + after
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        given = np.where(self.keys[at] == key, self.ratios[at], ratios[1:] + self.handed[before])
        return np.concatenate([ratios[:1], given])


@dataclass
class Model:
    """Log ratio of each word that has one of its own, of all others, of bigrams, and the curve."""

    words: dict[bytes, float] = field(default_factory=dict)
    other: float = 0.0
    bigrams: Bigrams = field(default_factory=Bigrams)
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float = 0.0

    def __post_init__(self):
        self.rare: dict[bytes, float] = {}

    def ratio(self, word: bytes) -> float:
        """Of a word without a ratio of its own: its stem's, or that of the rest."""
        found = self.rare.get(word)
        if found is None:
            found = self.words.get(word.decode()[:STEM].encode() + STEM_MARK.encode(), self.other)
            if len(self.rare) >= CACHE:
                self.rare.clear()
            self.rare[word] = found
        return found

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """Of words by themselves."""
        get = self.words.get
        return np.array([self.ratio(w) if (r := get(w)) is None else r for w in words])

    def features(self, text: bytes) -> tuple[float, float]:
        words = find_words(text.lower())
        if not words:
            return 0.0, 0.0
        ratios = self.bigrams.follow(words, self.ratios(words))
        width = min(PASSAGE, len(ratios))
        sums = np.concatenate([[0.0], ratios.cumsum()])
        return float(ratios.mean()), float((sums[width:] - sums[:-width]).max() / width)

    def score(self, mean: float, peak: float) -> float:
        if self.weights == (0.0, 0.0, 0.0):
            return self.prior
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-np.clip(a + b * mean + c * peak, -30, 30))))


find_words = re.compile(WORD.encode()).findall


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int) -> DataFrame:
    """(text, toxic, digest): distinct labelled texts, at most ``max_docs`` ids of each class."""
    known = labels.where(name(label_col).isNotNull() & name(id_col).isNotNull())
    known = known.groupBy(name(id_col).alias("id")).agg(F.max(name(label_col).cast("int")).alias("toxic"))
    ids = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(max_docs) for c in (0, 1)]
    # At most 2 * max_docs ids of a few bytes each.
    rows = docs.select(name(id_col).alias("id"), whole(text_col).alias("text")).join(
        F.broadcast(ids[0].unionByName(ids[1])), "id"
    )
    rows = rows.withColumn("digest", F.xxhash64("text"))
    return rows.groupBy("digest").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))


def continuation_counts(texts: DataFrame) -> DataFrame:
    """(w, toxic, ordinary): distinct words before ``w``, a word or a stem, in the texts of each class."""
    words = texts.select("toxic", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("ws"))
    follows = F.transform(
        "ws", lambda w, i: F.struct(F.when(i > 0, F.xxhash64(F.get("ws", i - 1))).alias("v"), w.alias("w"))
    )
    w = F.col("p.w")
    stem = F.when(F.length(w) > STEM, F.concat(F.substring(w, 1, STEM), F.lit(STEM_MARK)))
    pairs = words.select("toxic", F.explode(follows).alias("p")).select("toxic", "p.v", F.explode(F.array(w, stem)).alias("w"))
    pairs = pairs.where("w is not null").distinct()
    return pairs.groupBy("w").agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("ordinary")
    )


def bigram_counts(texts: DataFrame) -> DataFrame:
    """(v, w, toxic, ordinary): distinct words before ``v w``, in the texts of each class; none counts as one."""
    words = texts.select("toxic", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("ws"))
    follows = F.transform(
        F.slice("ws", F.lit(2), F.size("ws")),
        lambda w, i: F.struct(
            F.when(i > 0, F.xxhash64(F.get("ws", i - 1))).alias("u"),
            F.concat(F.get("ws", i), F.lit(" "), w).alias("vw"),  # no word has a space
        ),
    )
    seen = words.select("toxic", F.explode(follows).alias("p")).select("toxic", "p.u", "p.vw").distinct()
    counted = seen.groupBy("vw").agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("ordinary")
    )
    part = lambda i: F.split_part("vw", F.lit(" "), F.lit(i))
    return counted.select(part(1).alias("v"), part(2).alias("w"), *CLASSES)


def totals(counts: DataFrame, discount: int) -> Row:
    """Sums of the counts of each class and of what is discounted of them."""
    low = {c: F.least(F.col(c), F.lit(discount)) for c in CLASSES}
    return counts.agg(*[F.sum(c).alias(c) for c in CLASSES], *[F.sum(low[c]).alias(f"{c}_low") for c in CLASSES]).first()


def probabilities(rows: pd.DataFrame, total: Row, discount: int) -> dict[str, pd.Series]:
    """P_c of words by their continuation counts."""
    shared = total["toxic_low"] + total["ordinary_low"]
    low = np.minimum(rows["toxic"], discount) + np.minimum(rows["ordinary"], discount)
    return {
        c: np.maximum(rows[c] - discount, 0) / total[c] + total[f"{c}_low"] / total[c] * low / shared for c in CLASSES
    }


def word_ratios(counts: DataFrame, discount: int = DISCOUNT) -> tuple[dict[bytes, float], float]:
    """Log P_toxic / P_ordinary of words seen after more than ``discount`` words in a class, and of the rest.

    The counts come from at most ``MAX_DOCS`` texts of each class, which bounds the words.
    """
    total = totals(counts, discount)
    if not total["toxic"] or not total["ordinary"]:
        return {}, 0.0
    rows = counts.where(F.greatest(*CLASSES) > discount).toPandas()
    p = probabilities(rows, total, discount)
    share = {c: total[f"{c}_low"] / total[c] for c in CLASSES}
    ratio = np.log(p["toxic"] / p["ordinary"])
    words = [w.encode() for w in rows["w"]]
    return dict(zip(words, ratio.tolist(), strict=True)), float(np.log(share["toxic"] / share["ordinary"]))


def bigram_ratios(
    pairs: DataFrame, counts: DataFrame, model: Model, discount: int = DISCOUNT, bounded: bool = False
) -> Bigrams:
    """Log P_toxic(w | v) / P_ordinary(w | v) of bigrams seen after more than ``discount`` words in a class.

    ``bounded`` holds them between the word's own ratio and that of the whole counts.

    ``counts`` are the words' continuation counts, ``model`` has the words' ratios. A first
    word without such a bigram hands on all it has in both classes, so only the others are
    needed. The counted texts bound the bigrams as they bound the words.
    """
    total = totals(counts, discount)
    if not total["toxic"] or not total["ordinary"]:
        return Bigrams()
    low = {c: F.least(F.col(c), F.lit(discount)) for c in CLASSES}
    firsts = pairs.groupBy("v").agg(
        *[F.sum(c).alias(f"{c}_v") for c in CLASSES], *[F.sum(low[c]).alias(f"{c}_v_low") for c in CLASSES]
    )
    strong = pairs.where(F.greatest(*CLASSES) > discount).withColumnsRenamed({c: f"{c}_vw" for c in CLASSES})
    rows = strong.join(firsts, "v").join(counts, "w").toPandas()
    if rows.empty:
        return Bigrams()
    words = sorted({*rows["v"], *rows["w"]})
    index = {w: i for i, w in enumerate(words)}
    v, w = (rows[c].map(index).to_numpy() for c in "vw")
    p = probabilities(rows, total, discount)
    # The level below has this ratio, which for a rare word is its stem's.
    ratio = model.ratios([x.encode() for x in rows["w"]])
    middle = np.sqrt(p["toxic"] * p["ordinary"])
    below = {"toxic": middle * np.exp(ratio / 2), "ordinary": middle * np.exp(-ratio / 2)}
    kept = {c: (rows[f"{c}_v_low"] / rows[f"{c}_v"].where(rows[f"{c}_v"] > 0)).fillna(1.0) for c in CLASSES}
    given = {
        c: np.maximum(rows[f"{c}_vw"] - discount, 0) / rows[f"{c}_v"].clip(lower=1) + kept[c] * below[c] for c in CLASSES
    }
    keys, found = v * (len(words) + 1) + w, np.log(given["toxic"] / given["ordinary"]).to_numpy()
    if bounded:
        share = {c: (rows[f"{c}_vw"] + 1) / (rows[f"{c}_v"] + 1) for c in CLASSES}
        seen = np.log(share["toxic"] / share["ordinary"]).to_numpy()
        found = np.clip(found, np.minimum(ratio, seen), np.maximum(ratio, seen))
    order = np.argsort(keys)
    handed = np.zeros(len(words) + 1)
    handed[v] = np.log(kept["toxic"] / kept["ordinary"])
    return Bigrams({w.encode(): i for w, i in index.items()}, keys[order], found[order], handed)


def curve(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Logistic weights of (1, mean, peak), rows weighted so that toxic ones have the share ``prior``."""
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    z = np.c_[np.ones(len(x)), x]
    b = np.zeros(3)
    ridge = np.diag([1e-6, 1e-3, 1e-3]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - ridge @ b)
        b = b + np.clip(step, -2, 2)
    return tuple(b.tolist())


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_docs: int = MAX_DOCS, discount: int = DISCOUNT, order: int = 1,
) -> Model:
    """Counts and curve from the labelled rows of ``docs``, at most ``max_docs`` of each class.

    ``order`` 2 is the whole model; 1 leaves out the bigrams.
    """
    share = labels.where(name(label_col).isNotNull()).agg(F.avg(name(label_col).cast("double"))).first()[0] or 0.0
    rows = stored(sample(docs, labels, id_col, text_col, label_col, max_docs), "toxicity-sample")
    curve_row = F.expr(f"pmod(digest, {CALIBRATION}L)") == 0
    counts = stored(continuation_counts(rows.where(~curve_row)), "toxicity-counts")
    is_stem = F.endswith("w", F.lit(STEM_MARK))
    words, _ = word_ratios(counts.where(~is_stem), discount)
    stems, other = word_ratios(counts.where(is_stem), discount * STEM_FACTOR)
    words.update(stems)
    model = Model(words, other, prior=share)
    if order > 1:
        pairs = stored(bigram_counts(rows.where(~curve_row)), "toxicity-bigrams")
        model.bigrams = bigram_ratios(pairs, counts.where(~is_stem), model, discount, bounded=True)
    seen = with_differences(rows.where(curve_row), model, keep=["toxic"]).select("toxic", "difference", "peak").toPandas()
    if 0 < seen["toxic"].sum() < len(seen):
        model.weights = curve(seen[["difference", "peak"]].to_numpy(), seen["toxic"].to_numpy(), min(max(share, 0.01), 0.99))
    return model


def with_differences(docs: DataFrame, model: Model, text_col: str = "text", keep=None) -> DataFrame:
    """Append difference (whole text), peak (most toxic passage) and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = replace(shared.value)  # with a memory of its own, which goes with the task

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [m.features(t) for t in texts.to_pylist()]
            columns = [[d for d, _ in found], [p for _, p in found], [m.score(d, p) for d, p in found]]
            return [pa.array(c, pa.float64()) for c in columns]

        return work

    return appended(docs, whole(text_col).cast("binary"), make, "difference double, peak double, score double", keep)
