"""Line dedup by overlapping three-line windows.

Each three consecutive lines that aren't blank are a window, known by 96 bits of hashes. A window
that occurs more than once is kept at its first occurrence (the smallest id, then the first
place) and covers its lines at every later one; the covered lines of all windows of a document are
merged and removed. Blank lines (nothing but spaces) count as no line: windows reach across them,
and they stay.

Occurrences are counted with map-side sums. The 2000 most frequent windows, a table of fixed
size, are found by a broadcast join; no other can have more than a 2000th of all rows, and these
are found by a shuffled join. Only DataFrame functions are used.

Defined cases: null and empty texts and those with fewer than three lines have no window and
stay as they are; a null id comes before all others; rows that repeat an id and its text are one
document, changed alike; a text may lose all its lines and is then empty, not dropped; extra
columns are kept, n_chars follows the text where the table has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FREQUENT = 2000


def _windows(docs: DataFrame) -> DataFrame:
    """_id, _mark, h1, h2, places (of the window's lines in the text's), place (the first)."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.hash(x).alias("g"), (F.trim(x) == "").alias("blank")))
    full = F.filter(lines, lambda x: ~x["blank"])
    # explode keeps the array from being computed anew for each of its uses
    held = docs.where("text is not null").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"), F.explode(F.array(full)).alias("l")).where(F.size("l") >= 3)
    n = F.size("l") - 2
    three = F.arrays_zip(F.slice("l", F.lit(1), n).alias("a"), F.slice("l", F.lit(2), n).alias("b"), F.slice("l", F.lit(3), n).alias("c"))
    w = held.select("_id", "_mark", F.explode(three).alias("w"))
    return w.select("_id", "_mark", F.xxhash64("w.a.h", "w.b.h", "w.c.h").alias("h1"), F.hash("w.a.g", "w.b.g", "w.c.g").alias("h2"), F.col("w.a.i").alias("place"), F.array("w.a.i", "w.b.i", "w.c.i").alias("places"))


def covered(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """_id, _mark, gone: the places of the lines to remove, for documents that have some."""
    windows = common.written(_windows(docs))
    counted = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_mark", "place")).alias("first"))
    repeated = common.written(counted.where("n > 1"))
    most = repeated.orderBy(F.desc("n"), "h1", "h2").limit(frequent)
    often = F.broadcast(common.written(most))
    on = ["h1", "h2"]
    later = ~F.struct("_id", "_mark", "place").eqNullSafe(F.col("first"))
    hot = windows.join(often, on).where(later).select("_id", "_mark", "places")
    rest = windows.join(often, on, "left_anti").join(repeated.join(often, on, "left_anti"), on).where(later).select("_id", "_mark", "places")
    return hot.unionByName(rest).groupBy("_id", "_mark").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("gone"))


def dedup_lines(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """docs with repeated windows' lines removed; also _lines and _removed, their numbers (columns
    of docs with these names are replaced)."""
    return _deduped(docs.drop("_lines", "_removed"), frequent, True)


def _deduped(docs: DataFrame, frequent: int, numbers: bool) -> DataFrame:
    docs, back = common.renamed(docs, "doc_id", "text", "n_chars")
    gone = common.written(covered(docs, frequent))
    marked = docs.withColumn("_of", F.xxhash64("text"))
    on = marked["doc_id"].eqNullSafe(gone["_id"]) & (marked["_of"] == gone["_mark"])
    joined = marked.join(gone.hint("merge"), on, "left")  # the same plan at every size
    held = joined.withColumn("_split", F.explode(F.array(F.split("text", "\n"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("gone"))
    text = F.array_join(F.transform(kept, lambda i: F.col("_split")[i]), "\n")
    out = held.withColumns({"text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(text), "_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("_split")).cast("long"), "_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*back, *(["_lines", "_removed"] if numbers else []))


def without_repeats(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """docs with their own columns alone."""
    return _deduped(docs, frequent, False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), "text")


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), kept AS (
  SELECT doc_id, i, line,
    lead(i) OVER w AS i2, lead(line) OVER w AS line2, lead(i, 2) OVER w AS i3, lead(line, 2) OVER w AS line3
  FROM lines WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, i, i2, i3, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, i) AS nth
  FROM kept WHERE i3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM ranked WHERE nth > 1
), texts AS (
  SELECT l.doc_id, coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS text, count(g.i) AS n_removed
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE t.text END AS text
FROM documents d LEFT JOIN texts t USING (doc_id)
"""
