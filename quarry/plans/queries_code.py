"""Code search, build targets and repository versions on the driver tables.

Files are the documents, named by language, source and id; definitions and entities are the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import symbols
from quarry.functions import text as T
from quarry.operators import diffs as V
from quarry.operators import graph as G
from quarry.operators.tables import spread
from quarry.plans import index as I
from quarry.plans import ranked as R
from quarry.plans.registered import query

_FILE = "coalesce(lang, 'xx') || '/src_' || coalesce(source, '') || '/doc_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.rs' END"
_LOW = "translate(lower({0}), '_-', '')"


def files(t) -> DataFrame:
    name = F.concat(F.coalesce("lang", F.lit("xx")), F.lit("/src_"), F.coalesce("source", F.lit("")), F.lit("/doc_"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".py").otherwise(".rs"))
    return spread(t("documents")).select(name.alias("filename"), F.col("text").alias("content"))


# spans


@query(r"""WITH p AS (SELECT doc_id, string_split(lower(text), 'the') AS p FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, p, unnest(range(1, least(10, len(p) - 1) + 1)) AS i FROM p),
f AS (SELECT doc_id, i, length(regexp_replace(array_to_string(p[1:i], 'the'), '[^\n]', '', 'g')) AS line, CASE WHEN p[i] = '' THEN i = 1 ELSE NOT regexp_matches(right(p[i], 1), '[0-9A-Za-z_]') END AS a,
  CASE WHEN p[i + 1] = '' THEN i = len(p) - 1 ELSE NOT regexp_matches(left(p[i + 1], 1), '[0-9A-Za-z_]') END AS b FROM o)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (a OR b) AS BIGINT) AS n_border, CAST(count(*) FILTER (a AND b) AS BIGINT) AS n_complete FROM f GROUP BY 1, 2""")
def str11_spans(t) -> DataFrame:
    """The first ten occurrences of a term in each text, by line."""
    s = symbols.with_spans(spread(t("documents")).where("text is not null"), "doc_id", "text", ["the"]).select("doc_id", F.explode("spans").alias("s"))
    return s.groupBy("doc_id", "s.line").agg(F.count("*").alias("n"), F.count_if("s.border").alias("n_border"), F.count_if("s.complete").alias("n_complete"))


# candidates and score

_NAMED = 'example org'


@query(f"""WITH f AS (SELECT DISTINCT url AS filename FROM pages), m AS (SELECT filename, lower(filename) AS low, instr(lower(filename), 'example') AS a, instr(lower(filename), 'org') AS o, instr({_LOW.format('filename')}, '{_NAMED}') AS w FROM f)
SELECT filename, CAST(CASE WHEN w > 0 THEN -1 ELSE (CASE WHEN a > 0 THEN 1 ELSE 0 END) + (CASE WHEN o > 0 THEN 2 ELSE 0 END) END AS INTEGER) AS definite,
  CAST((CASE WHEN a > 0 AND (a = 1 OR NOT regexp_matches(low[a - 1], '[\\p{{L}}\\p{{N}}_]') OR NOT regexp_matches(low[a + 7], '[\\p{{L}}\\p{{N}}_]')) THEN 1 ELSE 0 END)
    + (CASE WHEN o > 0 AND (o = 1 OR NOT regexp_matches(low[o - 1], '[\\p{{L}}\\p{{N}}_]') OR NOT regexp_matches(low[o + 3], '[\\p{{L}}\\p{{N}}_]')) THEN 2 ELSE 0 END) AS INTEGER) AS border,
  CAST(greatest(CASE WHEN a > 0 THEN a + 6 ELSE 0 END, CASE WHEN o > 0 THEN o + 2 ELSE 0 END) AS INTEGER) AS position, CAST((a > 0)::INT + (o > 0)::INT AS INTEGER) AS n_matches, a > 0 AND o > 0 AND o + 2 >= a + 6 AS in_order,
  round(((CASE WHEN a > 0 THEN 7 ELSE 0 END) + (CASE WHEN o > 0 THEN 3 ELSE 0 END)) / length(filename), 9) AS coverage FROM m WHERE w > 0 OR a > 0 OR o > 0""")
def qry02_by_name(t) -> DataFrame:
    pages = t("pages").select(F.col("url").alias("filename"), F.lit("OTHER").alias("file_type")).distinct()
    return R.by_name(pages, R.parse(_NAMED)).select("filename", "definite", "border", "position", "n_matches", "in_order", F.round("coverage", 9).alias("coverage"))


_SYMBOLS = "d AS (SELECT p_brand AS filename, p_name AS symbol, CASE p_size % 4 WHEN 0 THEN 'VARIABLE' WHEN 1 THEN 'FUNCTION' WHEN 2 THEN 'STRUCTURE' ELSE 'TRAIT' END AS symbol_type, p_size AS line_number FROM part)"


def part_symbols(t) -> DataFrame:
    kinds = F.array(*map(F.lit, ("VARIABLE", "FUNCTION", "STRUCTURE", "TRAIT")))
    d = t("part").select(F.col("p_brand").alias("filename"), F.col("p_name").alias("symbol"), kinds[F.col("p_size") % 4].alias("symbol_type"), F.col("p_size").alias("line_number"))
    return d.withColumn("normalized", T.normalized(F.col("symbol")))


@query(f"""WITH {_SYMBOLS}, w AS (SELECT min(symbol) AS a, max(symbol) AS z FROM d), m AS (SELECT filename, CASE WHEN {_LOW.format('symbol')} = {_LOW.format('a')} THEN 1 ELSE 0 END + CASE WHEN {_LOW.format('symbol')} = {_LOW.format('z')} THEN 2 ELSE 0 END AS bit FROM d, w)
SELECT filename, CAST(bit_or(bit) AS INTEGER) AS definite, CAST(count(*) AS INTEGER) AS n FROM m WHERE bit > 0 GROUP BY 1""")
def qry01_by_definition(t) -> DataFrame:
    d = part_symbols(t)
    low, high = d.agg(F.min("symbol"), F.max("symbol")).first()
    q = R.parse(f'"{low}" "{high}"')
    return R.by_definition(d, q).select("filename", "definite", F.size("defined").alias("n"))


@query("""SELECT doc_id, CAST(CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'schen') THEN 2 ELSE 0 END AS INTEGER) AS found
FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(text), 'schen')""")
def qry03_trigram_masks(t) -> DataFrame:
    """Terms that a text may have by the stored trigrams, then those that it has."""
    docs = t("documents")
    q = R.parse("tion schen")
    may = R.by_trigrams(I.stored_postings(docs, "doc_id", "text").withColumnRenamed("doc_id", "filename"), q).withColumnRenamed("filename", "doc_id")
    low = F.lower("text")
    bits = [F.when(F.col("possible").bitwiseAND(F.lit(1 << i)) != 0, F.contains(low, F.lit(w)).cast("int") * (1 << i)).otherwise(0) for i, w in enumerate(q.terms)]
    return docs.select("doc_id", "text").join(may, "doc_id").select("doc_id", (bits[0] + bits[1]).alias("found")).where("found > 0")


_VARIED = """v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'third_party/' WHEN 1 THEN 'a/migrations/' ELSE 'src/' END || p_name AS filename, p_partkey % 4 AS n_matches, p_size / 100.0 AS coverage, p_size % 13 AS position,
  p_partkey % 7 = 0 AS whole, p_partkey % 4 > 1 AND p_partkey % 3 = 0 AS in_order, p_partkey % 14 = 0 AS exact, p_size AS occurrences, p_partkey % 2 AS normalized, p_retailprice / 1000 AS page_rank,
  p_partkey % 4 AS border, p_partkey % 3 AS complete, p_partkey % 6 AS k, p_name FROM part)"""


@query(f"""WITH {_VARIED}, m AS (SELECT *, 10 + least(occurrences, 10) - 3 * normalized + CASE WHEN n_matches > 0 OR whole THEN 10 + 100 * coverage + 10 * n_matches ELSE 0 END + 50.0 * position / length(filename)
    + CASE WHEN whole AND in_order THEN 20 * n_matches ELSE 0 END + 10 * log2(page_rank) + CASE WHEN exact THEN 40 ELSE 0 END AS s FROM v),
n AS (SELECT *, (CASE WHEN contains(filename, '/migrations/') THEN s / 2 WHEN starts_with(filename, 'third_party') THEN s / 3 ELSE s END)
  + CASE k WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 5 WHEN 3 THEN 80 WHEN 4 THEN 100 ELSE 45 END + 10 * bit_count(complete::INT) + 5 * bit_count(border::INT) AS r FROM m)
SELECT p_partkey, round(CASE WHEN border <> 3 THEN r / 2 ELSE r END - 0.25 * length(filename), 6) AS score FROM n""")
def qry06_score(t) -> DataFrame:
    """By part, one of: no definition; a variable named as a term; the same variable twice; a function
    named as a term; two structures (above the most); a variable and a trait."""
    q = R.parse("alpha beta")
    d = lambda s, k: F.struct(F.lit(s).alias("symbol"), F.lit(k).alias("symbol_type"), F.lit(1).alias("line_number"))
    cases = [F.array().cast(f"array<{R._DEFINITION}>"), F.array(d("alpha", "VARIABLE")), F.array(d("x", "VARIABLE"), d("x", "VARIABLE")), F.array(d("beta", "FUNCTION")), F.array(d("A", "STRUCTURE"), d("B", "STRUCTURE")), F.array(d("x", "VARIABLE"), d("y", "TRAIT"))]
    k = F.col("p_partkey")
    defined = cases[0]
    for i, c in enumerate(cases):
        defined = F.when(k % 6 == i, c).otherwise(defined)
    name = F.concat(F.when(k % 5 == 0, "third_party/").when(k % 5 == 1, "a/migrations/").otherwise("src/"), "p_name")
    v = t("part").select("p_partkey", name.alias("filename"), (k % 4).cast("int").alias("n_matches"), (F.col("p_size") / 100).alias("coverage"), (F.col("p_size") % 13).alias("position"), (k % 7 == 0).alias("whole"), ((k % 4 > 1) & (k % 3 == 0)).alias("in_order"), (k % 14 == 0).alias("exact"), F.array("p_size").alias("occurrences"), (k % 2).alias("normalized"), (F.col("p_retailprice") / 1000).alias("page_rank"), (k % 4).cast("int").alias("border"), (k % 3).cast("int").alias("complete"), defined.alias("defined"))
    return R.score(v, q).select("p_partkey", F.round("score", 6).alias("score"))


_WANTED = "heat ing"


@query(f"""WITH f AS (SELECT {_FILE} AS filename, text FROM documents), p AS (SELECT filename, lower(text) AS x, lower(filename) AS n FROM f)
SELECT filename FROM p WHERE (contains(x, 'heat') OR contains(n, 'heat')) AND (contains(x, 'ing') OR contains(n, 'ing'))""")
def qry04_candidates(t) -> DataFrame:
    """Candidates by all three ways, eliminated by their masks, then verified."""
    f = files(t)
    index = _small_index(t, f)
    q = R.parse(_WANTED)
    return R.verified(R.remaining(R.candidates(index, q), q), index["files"], q).select("filename")


def _small_index(t, f: DataFrame) -> dict[str, DataFrame]:
    """Of the documents: ranks are 1, definitions are the parts'."""
    flagged = f.withColumns({"file_type": T.file_type(F.col("filename")), "is_test": T.is_test(F.col("filename")), "is_ugly": T.is_ugly(F.col("content")), "page_rank": F.lit(1.0)})
    return {"files": flagged, "definitions": part_symbols(t), "trigrams": I.stored_postings(f, "filename", "content")}


@query(f"""WITH f AS (SELECT {_FILE} AS filename, text FROM documents), p AS (SELECT filename, text, least((length(lower(text)) - length(replace(lower(text), 'heat', ''))) // 4, 10) AS h, least((length(lower(text)) - length(replace(lower(text), 'ing', ''))) // 3, 10) AS n FROM f)
SELECT filename, CAST(h AS INTEGER) AS heat, CAST(n AS INTEGER) AS ing FROM p WHERE h > 0 AND n > 0""")
def qry05_verified(t) -> DataFrame:
    q = R.parse(_WANTED)
    f = files(t)
    index = _small_index(t, f)
    found = R.verified(R.remaining(R.candidates(index, q), q), index["files"], q)
    n = [F.expr(f"size(filter(spans, s -> s.term = {i}))") for i in range(2)]
    return found.select("filename", n[0].alias("heat"), n[1].alias("ing")).where("heat > 0 and ing > 0")


# entities

_ENTITIES = "e AS (SELECT p_brand || '::' || p_name AS name, [p_brand || '::' || p_name, p_name] AS keywords FROM part)"


def part_entities(t) -> DataFrame:
    name = F.concat_ws("::", "p_brand", "p_name")
    return t("part").select(name.alias("name"), F.array(name, "p_name").alias("keywords"))


@query(f"WITH {_ENTITIES}, w AS (SELECT min(p_name) AS n FROM part) SELECT DISTINCT name FROM e, w WHERE {_LOW.format('keywords[2]')} = {_LOW.format('n')} OR {_LOW.format('keywords[1]')} = {_LOW.format('n')}")
def qry10_entities(t) -> DataFrame:
    term = t("part").agg(F.min("p_name")).first()[0]
    return R.entities_for(part_entities(t), R.parse(f'"{term}"')).select("name").distinct()


@query(f"WITH {_ENTITIES}, k AS (SELECT {_LOW.format('unnest(keywords)')} AS keyword, name FROM e) SELECT keyword, name FROM k WHERE starts_with(keyword, 'brand') ORDER BY keyword, name LIMIT 11")
def topk03_suggested_entities(t) -> DataFrame:
    return R.suggested_entities(part_entities(t), R.parse("def:x Brand"))


@query(f"SELECT {_FILE} AS filename, text AS content FROM documents WHERE doc_id = 7")
def qry12_document(t) -> DataFrame:
    """A file by its name: the filter on what the name is made of reaches the scan."""
    return files(lambda name: t(name).where("doc_id = 7"))


@query(f"""SELECT filename, CAST(count(*) AS BIGINT) AS n_files FROM (SELECT {_FILE} AS filename FROM documents) GROUP BY 1""")
def map06_key_by_hash(t) -> DataFrame:
    """Files under 64-bit ids of their names; equal names have one id."""
    return files(t).groupBy(T.file_id(F.col("filename")).alias("id")).agg(F.any_value("filename").alias("filename"), F.count("*").alias("n_files")).select("filename", "n_files")


@query(f"""SELECT filename, regexp_matches(filename, '\\.rs$') AND regexp_matches(filename, 'tests?\\.rs$') OR regexp_matches(filename, '\\.py$') AND (contains(filename, '/test_') OR contains(filename, '/tests/')) AS is_test
FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'a/tests/x.py' WHEN 1 THEN 'a/test_x.py' WHEN 2 THEN 'a/x_test.rs' WHEN 3 THEN 'a/testing.rs' ELSE 'a/x.rs' END AS filename FROM documents)""")
def str10_test_files(t) -> DataFrame:
    names = F.array(*map(F.lit, ("a/tests/x.py", "a/test_x.py", "a/x_test.rs", "a/testing.rs", "a/x.rs")))
    return t("documents").select(names[(F.col("doc_id") % 5).cast("int")].alias("filename")).select("filename", T.is_test(F.col("filename")).alias("is_test"))


# build targets and what depends on them

_TARGETS = "g AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


@query(f"""WITH RECURSIVE {_TARGETS}, direct AS (SELECT 'r' || n_regionkey AS id FROM nation WHERE n_nationkey < 3 UNION SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey < 3),
r AS (SELECT id FROM direct UNION SELECT src FROM g JOIN r ON dst = id) SELECT id FROM r EXCEPT SELECT id FROM direct""")
def agg15_indirect_targets(t) -> DataFrame:
    """All that depends on changed targets, less these themselves."""
    edges = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    edges = edges.unionByName(t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst")))
    some = t("nation").where("n_nationkey < 3")
    direct = some.select(F.explode(F.array(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"))).alias("id"))
    return G.dependents(edges, direct)


@query("""SELECT 'd' || s_nationkey || '/BUILD' AS filename, '//d' || s_nationkey || ':t' || s_suppkey AS canonical_name, CAST(0 AS INTEGER) AS line_number, 'd' || s_nationkey || '/a.rs' AS first_file,
 '//d' || s_nationkey || ':t' || (s_suppkey - 1) || ',//x/y,//d' || s_nationkey || '/z:w' AS dependencies FROM supplier""")
def str09_build_targets(t) -> DataFrame:
    content = F.concat(F.lit('java_lib(\n  name = "t'), "s_suppkey", F.lit('",\n  srcs = ["a.rs", "b.rs"],\n  deps = [":t'), F.col("s_suppkey") - 1, F.lit('", "//x/y", "z:w"],\n)\n'))
    f = t("supplier").select(F.concat(F.lit("d"), "s_nationkey", F.lit("/BUILD")).alias("filename"), content.alias("content"))
    return symbols.build_targets(f).select("filename", "canonical_name", "line_number", F.col("files")[0].alias("first_file"), F.array_join("dependencies", ",").alias("dependencies"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS target, 'p' || l_partkey AS file FROM lineitem), d AS (SELECT DISTINCT l_orderkey AS target, l_suppkey AS needs FROM lineitem WHERE l_suppkey IN (SELECT l_orderkey FROM lineitem) AND l_orderkey <= 60)
SELECT DISTINCT a.file AS src, b.file AS dst FROM d JOIN e a ON a.target = d.target JOIN e b ON b.target = d.needs WHERE a.file <> b.file""")
def grf03_file_edges(t) -> DataFrame:
    """Edges of targets as edges of their files: the files of a target on those of what it needs."""
    line = t("lineitem")
    sources = line.select(F.col("l_orderkey").alias("target"), F.concat(F.lit("p"), "l_partkey").alias("file")).distinct()
    needs = line.where("l_orderkey <= 60").select(F.col("l_orderkey").alias("target"), F.col("l_suppkey").alias("needs")).distinct()
    return G.file_edges(sources, needs)


# versions


_CELLS = "c AS (SELECT CAST(user_id AS VARCHAR) AS row, event_type AS col, epoch_us(ts) AS ts, max_by(value, event_id) AS data, max_by(event_id % 10 = 0, event_id) AS deleted FROM events GROUP BY 1, 2, 3)"


def _cells(t) -> DataFrame:
    from quarry.plans.queries_versions import cells

    return cells(t)


@query(f"WITH {_CELLS}, n AS (SELECT row, col, max(ts) AS ts, arg_max(data, ts) AS data, arg_max(deleted, ts) AS deleted FROM c WHERE ts <= 1705000000000000 GROUP BY 1, 2) SELECT row || '/' || col AS path, data FROM n WHERE NOT deleted")
def ver01_snapshot(t) -> DataFrame:
    """All files of a repository as of an index."""
    return V.snapshot(_cells(t), 1_705_000_000_000_000)


@query("""WITH f AS (SELECT o_custkey AS change, 'src/f' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.swp' ELSE '.rs' END AS filename, o_orderkey % 50 AS index, o_orderstatus = 'F' AS reverted FROM orders)
SELECT filename FROM f WHERE change % 10 = 1 AND index <= 30 AND NOT reverted AND NOT ends_with(filename, '.swp')""")
def ver04_changed_files(t) -> DataFrame:
    name = F.concat(F.lit("src/f"), "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, ".swp").otherwise(".rs"))
    f = t("orders").where("o_custkey % 10 = 1").select(name.alias("filename"), (F.col("o_orderkey") % 50).alias("index"), (F.col("o_orderstatus") == "F").alias("reverted"))
    return V.changed_files(f, 30, [r"\.swp$"]).select("filename")


@query("""SELECT c_custkey AS path, sha256(c_name) AS sha, c_name AS data FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 4 <> 0""")
def ver09_blobs_by_path(t) -> DataFrame:
    """Paths to hashes to what is stored under them; hashes that nothing is stored under are skipped."""
    c = t("customer").select(F.col("c_custkey").alias("path"), F.sha2("c_name", 256).alias("sha"), F.col("c_name").alias("data"))
    return V.blobs_by_path(c.where("path % 9 = 0").select("path"), c.select("path", "sha"), c.where("path % 4 <> 0").select("sha", "data"))


@query("""WITH o AS (SELECT o_orderpriority AS name, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS version FROM orders)
SELECT name, CAST(max(version) AS INTEGER) AS version, arg_max(o_totalprice, version) AS config FROM o GROUP BY 1""")
def ver11_registry(t) -> DataFrame:
    """Publishing gives each name's configurations ascending versions; the newest are listed."""
    return V.registry(t("orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("config")), "name", "at")


@query("""WITH u AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) SELECT coalesce(u.status, 'NEW') AS status, c_custkey AS id, c_name AS title FROM customer LEFT JOIN u ON id = c_custkey""")
def ver12_moved_by_status(t) -> DataFrame:
    """Rows under their status; an update moves a row from the old status to the new one."""
    rows = t("customer").select(F.lit("NEW").alias("status"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    updates = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"))
    return V.moved(rows, updates)


@query("""SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1-%' AND o_orderkey >= 100 ORDER BY o_orderkey LIMIT 20""")
def flt07_change_list(t) -> DataFrame:
    """A page of changes: status, owner and repository prefix, where to go on, how many."""
    c = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("key"))
    return V.change_list(c, status="O", prefix="1-", starting_from=100, limit=20).select("id", "status")


@query("""SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM (SELECT event_id FROM events WHERE value >= 1 LIMIT 1000000)""")
def lim02_capped_log(t) -> DataFrame:
    from quarry.operators import logs as L

    return L.capped(t("events").where("value >= 1")).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("""SELECT conv_id, turn, replace(text, chr(10), ' ') AS rebuilt FROM conversations WHERE turn > 0""")
def arr04_byte_diffs(t) -> DataFrame:
    """The byte ranges in which each turn differs from the one before, applied to that one."""
    c = t("conversations")
    lines = lambda x: F.replace(x, F.lit(" "), F.lit("\n"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), lines(F.col("text")).alias("old"))
    pairs = c.select("conv_id", "turn", lines(F.col("text")).alias("new")).join(before, ["conv_id", "turn"])
    out = V.apply_byte_diffs(V.byte_diffs(pairs, "old", "new", ["conv_id", "turn", "old"]), "old", ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.replace(F.decode("data", "utf-8"), F.lit("\n"), F.lit(" ")).alias("rebuilt"))
