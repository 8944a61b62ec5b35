"""The stored index names files by their places in a run, and has each key once."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.plans import index, queries_index, ranked  # noqa: F401
from quarry.plans.registered import QUERIES


@pytest.mark.parametrize("listed", [1, 40, 1 << 19])
def test_a_key_is_stored_once_however_many_trigrams_its_file_has(spark: SparkSession, tmp_path, monkeypatch: pytest.MonkeyPatch, listed: int) -> None:
    monkeypatch.setattr(index, "LISTED", listed)
    texts = [("same name.py", "Heating"), ("same name.py", "ing\nheat"), (None, "a heat"), ("none.py", None), ("short.py", "ab\ncd"), *((f"{'long/' * 40}{i}.py", f"heat {i} \U0001f600é nation") for i in range(200))]
    path = str(tmp_path / f"t{listed}")
    spark.createDataFrame(texts, "filename string, content string").repartition(6).write.parquet(path)
    files = spark.read.parquet(path)
    got = sorted(((r.trigram, r.filename) for r in index.stored_postings(files, "filename", "content").collect()), key=repr)
    assert got == sorted(((g, k) for k, t in texts if t for g in {x[i : i + 3] for x in t.lower().split("\n") for i in range(len(x) - 2)}), key=repr)
    may = ranked.by_trigrams(index.stored_postings(files, "filename", "content"), ranked.parse("heat nation")).where("possible = 3").count()
    assert may == 200
    stored = spark.read.parquet(next(v for k, v in index._STORED.items() if f"t{listed}/" in k[2]))
    # before: each file's name in the list of each of its trigrams
    assert stored.agg(F.sum(F.size("keys"))).first()[0] == len(texts)
    assert stored.where("trigram = ''").count() == stored.select("run").distinct().count()


def test_two_words_are_looked_up_in_the_index_once(spark: SparkSession, tmp_path) -> None:
    texts = [(1, "the nation heats"), (2, "nation\nheat"), (3, "heat"), (4, "ti on he at"), (5, None), (6, "action, theatre"), (7, "Nation HEAT"), (8, "tio ion hea eat")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["join14_trigram_and"](spark, str(tmp_path))
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 6]
    # before: one for each word
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
