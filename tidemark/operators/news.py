"""News-event aggregates and text sentiment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The theme patterns. The underscore is a one-character wildcard.
CRISIS_THEMES = ("%CRISISLEX%", "%ECON_BANKRUPTCY%")
CRYPTO_THEMES = ("%CRYPTO%", "%BITCOIN%")


def _any_like(c: str, patterns: Sequence[str]) -> Column:
    out = F.col(c).like(patterns[0])
    for p in patterns[1:]:
        out = out | F.col(c).like(p)
    return out


def event_news_daily(gkg: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Per day, in order: events, mean tone, share of negative tone, crisis and crypto themes, sources.

    Both bounds are days and inclusive. They are applied to the stored time, not to a day
    computed from it, so the scan can skip. A missing or malformed tone counts in the
    denominator of the share only.
    """
    when = F.col("DATE")
    if since:
        gkg = gkg.where(when >= F.lit(since).cast("timestamp"))
    if until:
        gkg = gkg.where(when < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp"))
    tone = F.get(F.split("V2Tone", ","), F.lit(0)).try_cast("double")
    by_day = gkg.groupBy(F.to_date(when).alias("date")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg(tone).alias("avg_tone"),
        (F.count_if(tone < 0) / F.count(F.lit(1))).alias("negative_share"),
        F.count_if(_any_like("Themes", CRISIS_THEMES)).alias("crisis_count"),
        F.count_if(_any_like("Themes", CRYPTO_THEMES)).alias("crypto_count"),
        F.count_distinct("SourceCommonName").alias("source_diversity"),
    )
    return by_day.orderBy("date")


# 2 to this power: registers of a sketch. The error's deviation is 1.04 / sqrt(2^14), 0.8 %.
SKETCH_BITS = 14


def source_sketches(gkg: DataFrame, by: Sequence[str] = (), bits: int = SKETCH_BITS) -> DataFrame:
    """Per day a mergeable sketch of its distinct sources, of a fixed size whatever the day holds.

    Distinct counts of days do not add up; their sketches do. Stored, they give any longer
    span without a second look at the events. A missing source is none.
    """
    sketch = F.hll_sketch_agg("SourceCommonName", F.lit(bits)).alias("sources")
    return gkg.groupBy(*by, F.to_date("DATE").alias("date")).agg(sketch, F.count(F.lit(1)).alias("event_count"))


def source_diversity(sketches: DataFrame, unit: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct sources of each week, month, quarter or year, merged from daily sketches."""
    span = F.to_date(F.date_trunc(unit, "date")).alias("span")
    return sketches.groupBy(*by, span).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sources")).alias("source_diversity"),
        F.sum("event_count").alias("event_count"),
    )


def daily_sources(gkg: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per day and source its events: what exact distinct counts of longer spans need, at any size.

    Stored, they give any longer span without a second look at the events, as the sketches
    do, but grow with the sources of a day. A missing source keeps its events in a row of its own.
    """
    return gkg.groupBy(*by, F.to_date("DATE").alias("date"), "SourceCommonName").agg(F.count(F.lit(1)).alias("event_count"))


def exact_source_diversity(sources: DataFrame, unit: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Distinct sources of each week, month, quarter or year, from the sources of its days. A missing one is none."""
    span = F.to_date(F.date_trunc(unit, "date")).alias("span")
    once = sources.groupBy(*by, span, "SourceCommonName").agg(F.sum("event_count").alias("event_count"))
    return once.groupBy(*by, "span").agg(
        F.count("SourceCommonName").alias("source_diversity"), F.sum("event_count").alias("event_count")
    )


# A small default lexicon; pass your own for real work.
POSITIVE_WORDS = ("best", "gain", "good", "growth", "profit", "rally", "strong", "surge")
NEGATIVE_WORDS = (
    "bad", "crash", "disgusting", "fear", "hate", "idiot", "loser", "loss", "moron", "panic", "pathetic",
    "stupid", "trash", "ugly", "weak", "worthless",
)


# Runs of letters of the lower-cased text, in any script, are words.
WORD_BREAK = r"[^\p{L}]+"

LEXICON = "word string, weight int"
# A lexicon of so many bytes at most is sent to every task; a larger one meets the words by a shuffle.
BROADCAST_LEXICON = 16 << 20


def words_of(text: str = "text") -> Column:
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_BREAK)


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg") + 1))


def sentiment_columns(
    text: str = "text",
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> dict[str, Column]:
    """The columns of ``with_sentiment`` as expressions; each of them counts for itself."""
    hits = _hits(text, positive, negative)
    pos, neg = hits["pos"], hits["neg"]
    return {"pos": pos, "neg": neg, "score": (pos - neg) / (pos + neg + 1)}


def _hits(text: str, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Struct of the counts of both word lists, from one split of the text."""
    zero = F.lit(0).cast("bigint")

    def counted(so_far: Column, w: Column) -> Column:
        hit = lambda lexicon: F.when(w.isin(*lexicon), 1).otherwise(0)
        return F.struct((so_far["pos"] + hit(positive)).alias("pos"), (so_far["neg"] + hit(negative)).alias("neg"))

    return F.aggregate(words_of(text), F.struct(zero.alias("pos"), zero.alias("neg")), counted)


def with_sentiment(
    docs: DataFrame,
    text: str = "text",
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """Word hits in the whole text and the score (pos - neg) / (pos + neg + 1).

    For short word lists, which become part of the plan. A text is split once and its
    words are counted in place: no explode and no shuffle.
    """
    hits = _hits(text, positive, negative)
    return with_score(docs.withColumn("_hits", hits).select(*docs.columns, "_hits.pos", "_hits.neg"))


def with_lexicon(
    docs: DataFrame, lexicon: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """The same with a lexicon table (word, weight) of any size: positive weights count as pos, negative ones as neg.

    ``key`` identifies a document. Of several weights of a word the largest counts; a word
    of weight 0, or without one, does not. Words meet the lexicon by hash: it is broadcast
    if its words' bytes stay under ``BROADCAST_LEXICON``, else both sides are shuffled.
    Either way a task holds lexicon entries and streams the occurrences past them: sorting
    those would take memory for every word of every text. Hits are added up within tasks
    before they are shuffled to their documents, where they are the side that is held.
    """
    entries = (
        lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(F.max("weight").alias("weight")).where("weight <> 0")
    )
    size = entries.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    entries = F.broadcast(entries) if size <= BROADCAST_LEXICON else entries.hint("shuffle_hash")
    named = {k: f"_key_{k}" for k in key}
    worded = docs.select(*[F.col(k).alias(n) for k, n in named.items()], F.explode(words_of(text)).alias("word"))
    times = worded.join(entries, "word").groupBy(*named.values()).agg(
        F.count_if(F.col("weight") > 0).alias("_pos"), F.count_if(F.col("weight") < 0).alias("_neg")
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    joined = docs.join(times.hint("shuffle_hash"), same, "left").drop(*named.values())
    counts = {c: F.coalesce(f"_{c}", F.lit(0).cast("bigint")) for c in ("pos", "neg")}
    return with_score(joined.withColumns(counts).drop("_pos", "_neg"))


def register_sentiment(
    spark: SparkSession,
    name: str = "get_sentiment_score",
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> None:
    """Make the score a function of SQL: ``select get_sentiment_score(text)``.

    A SQL function, so calls become plain expressions of the query's plan.
    """
    hit = lambda lexicon: " when w in (" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in lexicon) + ") then "
    spark.sql(f"""
        create or replace temporary function {name}(body string) returns double
        return aggregate(
            split(lower(coalesce(body, '')), '[^\\\\p{{L}}]+'),
            named_struct('pos', 0D, 'neg', 0D),
            (h, w) -> named_struct(
                'pos', h.pos + case{hit(positive)}1 else 0 end, 'neg', h.neg + case{hit(negative)}1 else 0 end
            ),
            h -> (h.pos - h.neg) / (h.pos + h.neg + 1)
        )
    """)


def sentiment_daily(scored: DataFrame, by: Sequence[str] = ("asset",), day: str = "date") -> DataFrame:
    """Mean score and number of texts per asset and day."""
    return scored.groupBy(*by, day).agg(
        F.avg("score").alias("sentiment"), F.count(F.lit(1)).alias("texts")
    )
