"""Texts of candidates are joined and looked into once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import index, ranked


def test_verification_looks_into_each_text_once(spark: SparkSession) -> None:
    texts = [("a.py", "heat and ing"), ("a.py", "heating"), ("b.py", "heat"), ("c.py", "xheatx sing HEAT"), ("d.py", None)]
    files = spark.createDataFrame(texts, "filename string, content string").withColumns({"file_type": F.lit("PYTHON"), "is_test": F.lit(False), "is_ugly": T.is_ugly(F.col("content")), "page_rank": F.lit(1.0)})
    definitions = spark.createDataFrame([], "filename string, symbol string, symbol_type string, line_number int, normalized string")
    built = {"files": files, "definitions": definitions, "trigrams": index.trigram_postings(files.withColumn("content", F.lower("content")))}
    q = ranked.parse("heat ing")
    found = ranked.verified(ranked.remaining(ranked.candidates(built, q), q), files, q).select("filename", "content", "occurrences", "border", "complete")
    # two files of one name are two results; the count of trigrams lost both
    got = sorted((r.filename, r.content, sorted(r.occurrences), r.border, r.complete) for r in found.collect())
    assert got == [("a.py", "heat and ing", [1, 1], 3, 3), ("a.py", "heating", [1, 1], 3, 0), ("c.py", "xheatx sing HEAT", [1, 2], 3, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_candidates_of_texts_without_a_term_in_the_index_come_by_name(spark: SparkSession, tmp_path) -> None:
    """All three ways together over the stored lists, as SQL over documents has it."""
    spark.createDataFrame([(1, "heat", "en", "ing"), (2, "x", "en", "ing_heat"), (3, None, "en", "heating"), (4, "heat\ning", None, None), (5, "he at in g", "en", "s"), (4, "ing", None, None)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", "p", 1)], "p_brand string, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    from quarry.plans import queries_code  # noqa: F401
    from quarry.plans.registered import QUERIES

    got = sorted(r.filename for r in QUERIES["qry04_candidates"](spark, str(tmp_path)).collect())
    assert got == ["en/src_heating/doc_3.py", "en/src_ing/doc_1.rs", "en/src_ing_heat/doc_2.rs", "xx/src_/doc_4.rs"]
