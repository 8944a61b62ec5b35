"""The text index, search and text functions on documents, pages and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.plans import index as I
from quarry.plans import search as S
from quarry.plans.registered import query

PHRASE = "the and"


@query(f"""SELECT doc_id, (length(lower(text)) - length(replace(lower(text), '{PHRASE}', ''))) // {len(PHRASE)} AS occurrences,
10 + least((length(lower(text)) - length(replace(lower(text), '{PHRASE}', ''))) // {len(PHRASE)}, 10) AS score FROM documents WHERE contains(text, '{PHRASE}') ORDER BY score DESC, doc_id LIMIT 25""")
def search_flagship(t) -> DataFrame:
    """Trigram index, candidates, exact verification, ranking."""
    docs = t("documents")
    return S.phrase_search(docs, I.stored_postings(docs, "doc_id", "text"), PHRASE, "doc_id", "text")


@query("SELECT p_partkey, translate(lower(p_name), '_-', '') AS name FROM part")
def str01_normalize(t) -> DataFrame:
    return t("part").select("p_partkey", T.normalized(F.col("p_name")).alias("name"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), g AS (SELECT DISTINCT doc_id, unnest([substr(line, i, 3) FOR i IN range(1, length(line) - 1)]) AS gram FROM l WHERE length(line) >= 3)
SELECT doc_id, count(*) AS n FROM g GROUP BY 1""")
def agg05_doc_trigrams(t) -> DataFrame:
    return I.trigram_postings(t("documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+')) AS token FROM documents) SELECT doc_id, token, count(*) AS occurrences FROM w WHERE octet_length(encode(token)) >= 4 GROUP BY 1, 2""")
def agg06_term_counts(t) -> DataFrame:
    return I.keyword_counts(t("documents"), "doc_id", "text")


@query("""WITH w AS (SELECT unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+')) AS keyword FROM documents), n AS (SELECT translate(lower(keyword), '_-', '') AS normalized, keyword FROM w WHERE octet_length(encode(keyword)) >= 4)
SELECT normalized, keyword, count(*) AS occurrences FROM n WHERE octet_length(encode(normalized)) > 4 GROUP BY 1, 2""")
def agg04_keyword_counts(t) -> DataFrame:
    return I.keywords(t("documents"), "text")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def agg08_facets(t) -> DataFrame:
    return S.facets(t("documents"), "source").select(F.col("value").alias("source"), "n")


@query("SELECT doc_id, octet_length(encode(text)) > 200 * len(string_split(text, chr(10))) AS ugly FROM documents")
def map09_ugly_flag(t) -> DataFrame:
    return t("documents").select("doc_id", T.is_ugly(F.col("text")).alias("ugly"))


@query("""SELECT page_id, CASE WHEN length(url) > 25 THEN left(url, 11) || '...' || right(url, 11) ELSE url END AS short FROM pages""")
def str16_truncate(t) -> DataFrame:
    return t("pages").select("page_id", T.middle_cut(F.col("url"), 25).alias("short"))


@query("SELECT page_id, regexp_replace(url, '/?[^/]*$', '') AS parent, len(string_split(regexp_replace(url, '^/|/$', '', 'g'), '/')) AS depth FROM pages")
def str17_paths(t) -> DataFrame:
    return t("pages").select("page_id", T.parent_directory(F.col("url")).alias("parent"), T.path_depth(F.col("url")).cast("long").alias("depth"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def str14_html_escape(t) -> DataFrame:
    return t("pages").select("page_id", T.html_escaped(F.col("url")).alias("escaped"))


@query("""WITH c AS (SELECT doc_id, [left(x, 144) FOR x IN list_slice(string_split(text, chr(10)), 1, 7)] AS cut FROM documents), f AS (SELECT doc_id, cut, list_position([trim(x) <> '' FOR x IN cut], TRUE) AS p FROM c)
SELECT doc_id, CASE WHEN p > 0 THEN array_to_string(list_slice(cut, p, len(cut)), chr(10)) ELSE '' END AS snippet FROM f""")
def str12_snippet(t) -> DataFrame:
    return t("documents").select("doc_id", F.array_join(T.snippet(F.col("text"), F.lit(0)), "\n").alias("snippet"))


_EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), v AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part), w AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM e), r0 AS (SELECT id, 1.0::DOUBLE AS r FROM v)"
_ROUND = ", r{1} AS (SELECT a.id, (SELECT avg(r) FROM r{0}) + coalesce(g, 0) AS r FROM r{0} a LEFT JOIN (SELECT dst AS id, sum(r * 0.85 / n) AS g FROM w JOIN r{0} ON id = src GROUP BY 1) b ON a.id = b.id)"


@query(f"WITH {_EDGES}{''.join(_ROUND.format(i, i + 1) for i in range(3))} SELECT id, round(r, 6) AS rank FROM r3")
def grf01_pagerank3(t) -> DataFrame:
    edges = t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    nodes = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(t("part").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    return G.page_rank(nodes, edges).select("id", F.round("rank", 6).alias("rank"))


_TREE = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


@query(f"WITH RECURSIVE e AS ({_TREE}), d AS (SELECT src AS id FROM e WHERE dst = 'r1' UNION SELECT src FROM e JOIN d ON dst = id) SELECT id FROM d")
def grf04_reverse_deps(t) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c)
    e = t("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    e = e.unionByName(t("customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))).unionByName(t("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")))
    return G.dependents(e, e.sparkSession.createDataFrame([("r1",)], "id string"))


@query(f"WITH e AS ({_TREE}) SELECT src AS key, src, dst FROM e UNION ALL SELECT dst, src, dst FROM e")
def grf02_both_ways(t) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c)
    e = t("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    e = e.unionByName(t("customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))).unionByName(t("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")))
    return G.both_ways(e)


_NAMES = "f AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^.*?://', ''), '[?#].*$', '') AS filename FROM pages), i AS (SELECT DISTINCT filename, array_to_string(list_slice(string_split(filename, '/'), 2, 99), '/') AS target FROM f)"


@query(f"""WITH {_NAMES}, a AS (SELECT i.filename, target, g.filename AS resolved, 0 AS way, 0 AS step FROM i JOIN f g ON g.filename = target
UNION ALL SELECT i.filename, target, g.filename, 1, n FROM i, range(1, 20) r(n), f g WHERE n <= len(string_split(i.filename, '/')) - 2 AND g.filename = array_to_string(list_slice(string_split(i.filename, '/'), 1, n), '/') || '/' || target
UNION ALL SELECT i.filename, target, g.filename, 2, length(g.filename) FROM i JOIN f g ON g.filename = target OR ends_with(g.filename, '/' || target)),
r AS (SELECT *, row_number() OVER (PARTITION BY filename, target ORDER BY way, step, resolved) AS n FROM a) SELECT filename, target, resolved FROM r WHERE n = 1""")
def join08_suffix_resolve(t) -> DataFrame:
    files = t("pages").select(F.regexp_replace(F.regexp_replace("url", "^.*?://", ""), "[?#].*$", "").alias("filename")).distinct()
    parts = F.split("filename", "/")
    imports = files.select("filename", F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/").alias("target"))
    return I.resolve_imports(imports, files)


@query("""WITH g AS (SELECT doc_id, text FROM documents) SELECT doc_id FROM g WHERE """ + " AND ".join(f"regexp_matches(text, '{x}')" for x in ("tion", "heat")))
def join14_trigram_and(t) -> DataFrame:
    """Trigram candidates of two words, then verified."""
    docs = t("documents")
    postings = I.stored_postings(docs, "doc_id", "text")
    both = S.trigram_candidates(postings, "tion", "doc_id", "heat")
    return docs.join(both, "doc_id", "left_semi").where(F.contains("text", F.lit("tion")) & F.contains("text", F.lit("heat"))).select("doc_id")


@query("""WITH w AS (SELECT unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+')) AS keyword FROM documents) SELECT keyword, count(*) AS occurrences FROM w WHERE octet_length(encode(keyword)) > 4 AND starts_with(keyword, 'th') GROUP BY 1 ORDER BY occurrences DESC, keyword LIMIT 10""")
def topk02_suggestions(t) -> DataFrame:
    return S.suggestions(I.keywords(t("documents"), "text"), "th")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS x FROM documents), s AS (SELECT doc_id, line FROM l WHERE contains(x, 'the')),
c AS (SELECT doc_id, line, count(*) OVER (PARTITION BY doc_id ORDER BY line RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS n FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line) AS k FROM c) SELECT doc_id, CAST(line AS INTEGER) AS line, n FROM r WHERE k = 1""")
def win02_densest_window(t) -> DataFrame:
    spans = I.lines(t("documents"), "doc_id", "text").where(F.contains("line", F.lit("the"))).select("doc_id", F.col("line_number").alias("line"))
    return S.densest_window(spans, "doc_id")
