"""Ranked search of source files: candidates by definition, by file name and by trigrams, each with
bits for the terms it has; elimination by these bits; verification in the text; score; snippets.

Term number i is bit i of every mask. What is definite needs no look into the text, what is possible
(by trigrams) does. Candidates are joined to texts only after elimination."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import symbols
from quarry.functions import text as T
from quarry.operators.batches import bounded

EXPANDED, RETURNED, SUGGESTED_ENTITIES, LINES = 100, 25, 11, 7
_PART = re.compile(r'"([^"]*)"|(\S+)')
#: Kinds of terms by their marks: a definition, the beginning of a file name, a language, a file name.
_MARKS = {"def:": "def", "in:": "in", "lang:": "lang", "f:": "f"}
#: What a definition of a kind adds to the score.
KIND_WEIGHTS = {"VARIABLE": 5, "FUNCTION": 40, "STRUCTURE": 80, "TRAIT": 40}
_DEFINITION = "struct<symbol: string, symbol_type: string, line_number: int>"


class Query(NamedTuple):
    text: str
    terms: list[str]
    kinds: list[str]

    @property
    def full(self) -> int:
        return (1 << len(self.terms)) - 1

    def of(self, *kinds: str) -> list[tuple[int, str]]:
        return [(i, t) for i, (t, k) in enumerate(zip(self.terms, self.kinds, strict=True)) if k in kinds]


def parse(text: str) -> Query:
    """Words and quoted phrases; a mark before one narrows what it is sought in."""
    terms, kinds = [], []
    for phrase, word in _PART.findall(text):
        mark = next((m for m in _MARKS if word.startswith(m) and word != m), "")
        term = phrase or word[len(mark) :]
        if term:
            terms.append(term)
            kinds.append(_MARKS.get(mark, ""))
    if not terms:
        raise ValueError("the query has no terms")
    return Query(text.strip(), terms, kinds)


def normalized(term: str) -> str:
    return term.lower().replace("_", "").replace("-", "")


def by_definition(definitions: DataFrame, query: Query) -> DataFrame:
    """(filename, definite, defined) of files that define a term, in its normal form."""
    wanted = [(1 << i, normalized(t)) for i, t in query.of("", "def")]
    bits = definitions.sparkSession.createDataFrame(wanted, "bit int, normalized string")
    found = definitions.where(F.col("normalized").isin([n for _, n in wanted])).join(F.broadcast(bits), "normalized")
    defined = F.collect_list(F.struct("symbol", "symbol_type", "line_number"))
    return found.groupBy("filename").agg(F.bit_or("bit").alias("definite"), defined.alias("defined"))


def _inside_word(sign: Column) -> Column:
    return sign.rlike(r"^[\p{L}\p{N}_]$")


def by_name(files: DataFrame, query: Query) -> DataFrame:
    """Of files whose names (or language) have a term: filename, definite (-1, all bits, where the
    normal form of the name has the whole query), border, position, n_matches, in_order, coverage,
    whole, exact. Letter case doesn't matter; in: terms have to begin the name."""
    name, low = F.col("filename"), F.lower("filename")
    zero = F.lit(0)
    mask = border = n = covered = position = zero
    ordered = F.lit(True)
    for i, term in query.of("", "in", "f"):
        at = F.instr(low, term.lower())
        hit = (at == 1) if query.kinds[i] == "in" else (at > 0)
        end = at - 1 + len(term)
        open_ = (at == 1) | (end == F.length(name)) | ~_inside_word(F.substring(name, at - 1, F.lit(1))) | ~_inside_word(F.substring(name, end + 1, F.lit(1)))
        ordered = ordered & ~(hit & (end < position))
        position = F.when(hit, F.greatest(position, end)).otherwise(position)
        mask = mask.bitwiseOR(F.when(hit, 1 << i).otherwise(0))
        border = border.bitwiseOR(F.when(hit & open_, 1 << i).otherwise(0))
        n, covered = n + hit.cast("int"), covered + F.when(hit, len(term)).otherwise(0)
    for i, term in query.of("lang"):
        mask = mask.bitwiseOR(F.when(F.col("file_type") == term.upper(), 1 << i).otherwise(0))
    at = F.instr(T.normalized(name), query.text.lower())
    whole = at > 0
    columns = {
        "definite": F.when(whole, -1).otherwise(mask), "border": border, "n_matches": n, "in_order": (n > 1) & ordered, "whole": whole, "exact": whole & (name == query.text),
        "position": F.when(whole, F.greatest(position, at - 1 + len(query.text))).otherwise(position), "coverage": covered / F.length(name),
    }
    return files.select("filename", *(c.alias(k) for k, c in columns.items())).where("definite <> 0")


def by_trigrams(postings: DataFrame, query: Query) -> DataFrame:
    """(filename, possible) of files that have all trigrams of a term of three signs or more;
    postings: distinct (trigram, filename) of texts in lower case."""
    wanted = [(i, t.lower()) for i, t in query.of("") if len(t) >= 3]
    grams = [(i, g) for i, t in wanted for g in sorted({t[k : k + 3] for k in range(len(t) - 2)})]
    needs = {i: sum(j == i for j, _ in grams) for i, _ in wanted}
    spark = postings.sparkSession
    terms = spark.createDataFrame([(i, g, needs[i]) for i, g in grams], "term int, trigram string, needed int")
    found = postings.where(F.col("trigram").isin(sorted({g for _, g in grams}))).join(F.broadcast(terms), "trigram")
    full = found.groupBy("filename", "term").agg(F.count("*").alias("n"), F.any_value("needed").alias("needed")).where("n >= needed")
    return full.groupBy("filename").agg(F.bit_or(F.expr("shiftleft(1, term)")).alias("possible"))


_NAME = ("border", "position", "n_matches", "in_order", "coverage", "whole", "exact")


def candidates(index: dict[str, DataFrame], query: Query) -> DataFrame:
    """All candidates: filename, definite, possible, defined and the columns of `by_name`."""
    named = by_name(index["files"], query)
    fields = {c: named.schema[c].dataType.simpleString() for c in _NAME}
    name = F.struct(*_NAME)
    none = F.lit(None).cast("struct<" + ", ".join(f"{c}: {t}" for c, t in fields.items()) + ">")
    no_definitions = F.array().cast(f"array<{_DEFINITION}>")
    parts = [
        by_definition(index["definitions"], query).select("filename", "definite", F.lit(0).alias("possible"), "defined", none.alias("name")),
        named.select("filename", "definite", F.lit(0).alias("possible"), no_definitions.alias("defined"), name.alias("name")),
        by_trigrams(index["trigrams"], query).select("filename", F.lit(0).alias("definite"), "possible", no_definitions.alias("defined"), none.alias("name")),
    ]
    each = reduce(DataFrame.unionByName, parts).groupBy("filename").agg(F.bit_or("definite").alias("definite"), F.bit_or("possible").alias("possible"), F.flatten(F.collect_list("defined")).alias("defined"), F.max("name").alias("name"))
    short = sum(1 << i for i, t in query.of("") if len(t) < 3)
    zero = {"boolean": F.lit(False), "int": F.lit(0), "double": F.lit(0.0)}
    return each.select("filename", "definite", F.col("possible").bitwiseOR(F.lit(short)).alias("possible"), "defined", *(F.coalesce(f"name.{c}", zero[fields[c]]).alias(c) for c in _NAME))


def remaining(found: DataFrame, query: Query) -> DataFrame:
    """Candidates that have, or may have, every term."""
    return found.where(F.col("definite").bitwiseOR(F.col("possible")).bitwiseAND(F.lit(query.full)) == query.full)


def verified(found: DataFrame, files: DataFrame, query: Query) -> DataFrame:
    """Candidates that have every term, after a look into their texts; with spans, occurrences (of
    each term found), and definite, border and complete with the bits of what was found."""
    sought = query.of("", "def")
    held = found.join(files.select("filename", "content", "page_rank", "is_test", "is_ugly", "file_type"), "filename")
    if not sought:
        held = held.withColumn("spans", F.array().cast(symbols.SPAN))
    else:
        bounded(held.sparkSession)
        held = held.withColumn("spans", symbols.spans_of("content", [t for _, t in sought]))
    places = F.array(*(F.lit(i) for i, _ in sought)) if sought else F.array().cast("array<int>")
    held = held.withColumn("spans", F.transform("spans", lambda s: s.withField("term", places[s["term"]])))
    of = lambda keep: F.expr(f"aggregate(filter(spans, s -> {keep}), 0, (a, s) -> a | shiftleft(1, s.term))")
    terms = F.array_distinct(F.transform("spans", lambda s: s["term"]))
    occurrences = F.transform(terms, lambda t: F.size(F.filter("spans", lambda s: s["term"] == t)))
    held = held.withColumns({"definite": F.col("definite").bitwiseOR(of("true")), "border": F.col("border").bitwiseOR(of("s.border")), "complete": of("s.complete"), "occurrences": occurrences})
    return held.where(F.col("definite").bitwiseAND(F.lit(query.full)) == query.full)


def definition_score(defined: Column, terms: list[str]) -> Column:
    """Weights of the definitions, those spelled as a term twice; a variable counts once by its
    name; 100 at most."""
    weight = lambda d: reduce(lambda a, kv: F.when(d["symbol_type"] == kv[0], kv[1]).otherwise(a), KIND_WEIGHTS.items(), F.lit(0))
    variable = lambda d: d["symbol_type"] == "VARIABLE"
    times = lambda d: 1 + sum(((d["symbol"] == t).cast("int") for t in terms), F.lit(0))
    others = F.aggregate(F.filter(defined, lambda d: ~variable(d)), F.lit(0), lambda a, d: a + weight(d) * times(d))
    names = F.array_distinct(F.transform(F.filter(defined, variable), lambda d: d["symbol"]))
    once = F.aggregate(names, F.lit(0), lambda a, s: a + KIND_WEIGHTS["VARIABLE"] * (1 + sum(((s == t).cast("int") for t in terms), F.lit(0))))
    return F.least(others + once, F.lit(100))


def score(found: DataFrame, query: Query) -> DataFrame:
    """found with score, from the columns that `verified` gives (and `normalized`, the number of terms
    that only a normal form matched, where there is one). The order of steps matters: what is divided
    is what came before."""
    name = F.length("filename")
    s = F.aggregate("occurrences", F.lit(0.0), lambda a, n: a + 10 + F.least(n, F.lit(10)))
    if "normalized" in found.columns:
        s -= 3 * F.col("normalized")
    s += F.when((F.col("n_matches") > 0) | F.col("whole"), 10 + 100 * F.col("coverage") + 10 * F.col("n_matches")).otherwise(0.0)
    s += 50 * F.col("position") / name
    s += F.when(F.col("whole") & F.col("in_order"), 20 * F.col("n_matches")).otherwise(0)
    s += F.when(F.col("page_rank") > 0, 10 * F.log2("page_rank")).otherwise(0.0)
    s += F.when(F.col("exact"), 40).otherwise(0)
    s = F.when(F.contains("filename", F.lit("/migrations/")), s / 2).otherwise(s)
    s = F.when(F.startswith("filename", F.lit("third_party")), s / 3).otherwise(s)
    s += definition_score(F.col("defined"), query.terms) + 10 * F.bit_count("complete") + 5 * F.bit_count("border")
    s = F.when(F.col("border") != query.full, s / 2).otherwise(s)
    return found.withColumn("score", s - 0.25 * name)


def second_pass(found: DataFrame) -> DataFrame:
    s = F.when(F.col("is_ugly"), F.col("score") / 10).otherwise(F.col("score"))
    return found.withColumn("score", F.when(F.col("is_test"), s / 2).otherwise(s))


def window_start(defined: Column, spans: Column) -> Column:
    """The first line of a snippet: about the weightiest definition, else the first of the densest
    windows of spans, centred on their lines."""
    weight = lambda d: reduce(lambda a, kv: F.when(d["symbol_type"] == kv[0], kv[1]).otherwise(a), KIND_WEIGHTS.items(), F.lit(0))
    best = F.array_max(F.transform(defined, lambda d: F.struct(weight(d).alias("w"), d["line_number"].alias("line"))))["line"]
    lines = F.transform(spans, lambda s: s["line"])
    held = F.transform(lines, lambda x, i: F.struct((-i).alias("after"), x.alias("high"), F.filter(F.slice(lines, 1, i + 1), lambda y: y > x - LINES).alias("lines")))
    dense = F.array_max(F.transform(held, lambda h: F.struct(F.size(h["lines"]).alias("n"), h["after"].alias("after"), h["high"].alias("high"), F.array_min(h["lines"]).alias("low"))))
    centred = F.greatest(dense["low"] - F.floor((LINES - (dense["high"] - dense["low"])) / 2), F.lit(0))
    return F.when(F.size(defined) > 0, F.greatest(best - LINES // 2, F.lit(0))).otherwise(F.coalesce(centred, F.lit(0))).cast("int")


def search(index: dict[str, DataFrame], text: str, limit: int = RETURNED) -> DataFrame:
    """Ranked files for a query: filename, score, file_type, start (first line of the snippet), snippet."""
    query = parse(text)
    found = verified(remaining(candidates(index, query), query), index["files"], query)
    top = score(found, query).orderBy(F.desc("score"), "filename").limit(EXPANDED)
    top = second_pass(top).withColumn("start", window_start(F.col("defined"), F.col("spans")))
    return top.select("filename", "score", "file_type", "start", T.snippet(F.col("content"), F.col("start")).alias("snippet")).orderBy(F.desc("score"), "filename").limit(limit)


def facets(found: DataFrame, most: int = 5) -> DataFrame:
    """(facet, value, n): the most frequent languages and first parts of file names; a facet of one
    value is none."""
    known = found.where("file_type <> 'OTHER'").select(F.lit("language").alias("facet"), F.lower("file_type").alias("value"))
    prefix = found.select(F.lit("prefix").alias("facet"), F.split("filename", "/")[0].alias("value"))
    counted = known.unionByName(prefix).groupBy("facet", "value").agg(F.count("*").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "value"))), 1, most)
    return counted.groupBy("facet").agg(best.alias("best"), F.count("*").alias("all")).where("all > 1").select("facet", F.explode("best").alias("b")).select("facet", "b.value", (-F.col("b.less")).alias("n"))


def entities_for(entity_keywords: DataFrame, query: Query) -> DataFrame:
    """Entities (name, keywords) one of whose keywords is a term in its normal form; of several
    terms, those with exactly as many pairs of a keyword and a term inside it as there are terms."""
    keys = F.transform("keywords", lambda k: F.translate(F.lower(k), "_-", ""))
    found = entity_keywords.where(F.arrays_overlap(keys, F.array(*(F.lit(normalized(t)) for t in query.terms))))
    if len(query.terms) == 1:
        return found
    pairs = F.aggregate("keywords", F.lit(0), lambda a, k: a + sum((F.contains(k, F.lit(t)).cast("int") for t in query.terms), F.lit(0)))
    return found.where(pairs == len(query.terms))


def suggested_entities(entity_keywords: DataFrame, query: Query, most: int = SUGGESTED_ENTITIES) -> DataFrame:
    """(keyword, name): the first entities in order of their keywords that begin with the last term;
    none if that is a marked one."""
    rows = entity_keywords.select(F.explode(F.transform("keywords", lambda k: F.translate(F.lower(k), "_-", ""))).alias("keyword"), "name")
    wanted = F.startswith("keyword", F.lit(normalized(query.terms[-1]))) if not query.kinds[-1] else F.lit(False)
    return rows.where(wanted).orderBy("keyword", "name").limit(most)
