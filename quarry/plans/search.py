"""Phrase search over stored trigrams, facets, suggestions and dense windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETURNED, SUGGESTED = 25, 10


def occurrences(content: Column, term: str) -> Column:
    """How often, without overlaps."""
    text, t = F.lower(content), term.lower()
    return ((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("long")


def trigram_candidates(postings: DataFrame, term: str, key: str, *others: str) -> DataFrame:
    """Keys that may have a term, and all others: all trigrams of their lower case (with fewer than 3
    characters, all keys). Postings are once for each file, so they are counted as they are, those of
    all terms in one look-up with one small shuffle."""
    grams = sorted({t[i : i + 3] for t in map(str.lower, (term, *others)) for i in range(len(t) - 2)})
    hits = postings.where(F.col("trigram").isin(grams)) if grams else postings
    return hits.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= len(grams)).select(key)


def phrase_search(docs: DataFrame, postings: DataFrame, phrase: str, key: str, content: str, limit: int = RETURNED) -> DataFrame:
    """Ranked documents with a phrase: trigram candidates (of the phrase as spelled), exact
    verification, then 10 + min(occurrences, 10)."""
    found = docs.join(trigram_candidates(postings, phrase, key), key, "left_semi").where(F.contains(content, F.lit(phrase)))
    n = occurrences(F.col(content), phrase)
    return found.select(key, n.alias("occurrences"), (10 + F.least(n, F.lit(10))).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def facets(found: DataFrame, column: str, most: int = 5) -> DataFrame:
    """The most frequent values and their counts; nothing if there is only one value."""
    top = found.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)
    return top.join(F.broadcast(top.agg(F.count("*").alias("_all"))), F.col("_all") > 1).select("value", "n")


def suggestions(keywords: DataFrame, prefix: str, most: int = SUGGESTED) -> DataFrame:
    """The most frequent keywords with a prefix."""
    return keywords.where(F.col("keyword").startswith(prefix)).groupBy("keyword").agg(F.sum("occurrences").alias("occurrences")).orderBy(F.desc("occurrences"), "keyword").limit(most)


def densest_window(spans: DataFrame, key: str, size: int = 7) -> DataFrame:
    """(key, line, n): where, of all windows of `size` lines that end on a span's line, the first
    with the most spans ends."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("line").rangeBetween(-(size - 1), 0)
    counted = spans.select(key, "line", F.count("*").over(w).alias("n"))
    return counted.groupBy(key).agg(F.max_by(F.struct("line", "n"), F.struct("n", -F.col("line"))).alias("best")).select(key, "best.line", "best.n")
