"""URL filter by association rules, in DataFrame functions only.

A URL becomes a set of tokens: scheme, host labels, path segments with numbers folded,
query keys, fragment. FP-growth mines token combinations together with the label of bad
pages; rules "these tokens, then bad" with enough support and confidence are kept. A rule
is posted in an inverted index under its rarest token; each URL looks up its tokens and
the rules found are tested for their other tokens. Host and path rules given by hand come
first; the longest that fits decides.

Defined results: NULL URLs and URLs without ``://`` have an empty host and path and no
tokens, so no rule fits and the verdict is ``allow``; repeated rows get the same verdict;
without labels nothing is mined. Labels that are NULL don't count. Other columns are kept
out of the result. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .text import if_small, lower_ascii, name

MIN_PAGES = 20  # bad pages that a rule needs, whatever the size of the table: fewer would make rules of chance
MIN_CONFIDENCE = 0.5
INDEX_RULES = 20_000  # rules that are broadcast, some hundred bytes each; more meet the URLs by a shuffle
BAD = "label=bad"

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The set of a URL's tokens; empty without ``://``."""
    marked = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind), x))
    filled = lambda items: F.filter(items, lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    folded = F.regexp_replace(path_of(url), r"[0-9]+", "0")
    parts = F.concat(
        F.array(F.concat(F.lit("scheme="), F.substring_index(url, "://", 1))),
        marked("host=", filled(F.split(host_of(url), r"\."))),
        marked("path=", filled(F.split(folded, "/"))),
        marked("query=", filled(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)))),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def mined(
    pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url_col: str = "url", label_id: str = "doc_id",
    bad: Column | None = None, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(tokens, confidence, support): combinations that tell bad pages, the smallest of equal strength."""
    bad = (F.col("quality") == 0) if bad is None else bad
    marks = labels.where(bad.isNotNull()).groupBy(name(label_id).alias("id")).agg(F.max(bad.cast("int")).alias("bad"))
    known = pages.select(name(page_id).alias("id"), tokens_of(name(url_col)).alias("tokens")).join(marks, "id")
    last = F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = stored(known.where(F.size("tokens") > 0).select(F.concat("tokens", last).alias("items")), "baskets")
    schema = "tokens array<string>, confidence double, support double"
    labelled = baskets.count()
    if not labelled:
        return pages.sparkSession.createDataFrame([], schema)
    least = min(1.0, min_pages / labelled)
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BAD))
    rules = stored(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    # A rule with more tokens must be surer than each rule inside it.
    inner = rules.select(F.col("tokens").alias("some"), F.col("confidence").alias("sure"))
    inside = (F.size(F.array_except("some", "tokens")) == 0) & (F.size("some") < F.size("tokens")) & (F.col("sure") >= F.col("confidence"))
    first = rules.withColumn("token", F.explode("tokens")).join(inner.withColumn("token", F.element_at("some", 1)), "token")
    weaker = first.where(inside).select("tokens").distinct()
    return rules.join(weaker, "tokens", "left_anti")


def posted(rules: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The inverted index: each rule under its token that the fewest pages have."""
    counts = pages.select(F.explode(tokens_of(name(url_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    spread = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    ranked = spread.join(counts, "token", "left").groupBy("tokens", "confidence")
    return ranked.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest")).select(
        F.col("rarest.token").alias("token"), "tokens", "confidence"
    )


def url_key(url: Column) -> Column:
    """32 bytes for a URL of any length."""
    return F.unhex(F.sha2(url, 256))


def fired(pages: DataFrame, index: DataFrame, url_col: str = "url") -> DataFrame:
    """(key, confidence) of the URLs that a mined rule matches."""
    urls = pages.select(url_key(name(url_col)).alias("key"), tokens_of(name(url_col)).alias("own"))
    looked = urls.select("key", "own", F.explode("own").alias("token")).join(if_small(index, INDEX_RULES), "token")
    return looked.where(F.size(F.array_except("tokens", "own")) == 0).groupBy("key").agg(F.max("confidence").alias("confidence"))


def hand_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else NULL."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(out)
    return out


def judged(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url_col: str = "url",
    by_hand: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, confidence) for each row of ``pages``."""
    index = stored(posted(rules, pages, url_col), "url-index")
    hits = stored(fired(pages, index, url_col), "fired")
    rows = pages.select(name(page_id).alias("page_id"), name(url_col).alias("url"), url_key(name(url_col)).alias("key"))
    rows = rows.join(if_small(hits), "key", "left")
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("hand", hand_rule(F.col("host"), F.col("path"), by_hand))
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id", "url", "host", "path", F.col("hand.rule").alias("rule"), F.coalesce("hand.verdict", method).alias("verdict"), "confidence"
    )
