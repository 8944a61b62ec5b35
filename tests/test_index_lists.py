"""The stored index: posting lists made and sorted where the files are, with nothing shuffled."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.plans import index, ranked, search


@pytest.mark.parametrize("signs", [1, 5, 1 << 17])
def test_pairs_equal_brute_force(monkeypatch: pytest.MonkeyPatch, signs: int) -> None:
    monkeypatch.setattr(index, "SIGNS", signs)
    rng = random.Random(1)
    cases = [[""], [], ["ab", "c"], *(["".join(rng.choice("abé\n\r\U0001f600") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5))] for _ in range(200))]
    for texts in cases:
        grams, gram, file = index._pairs(texts)
        text = grams.tobytes().decode("utf-32-le")
        assert [(text[3 * g : 3 * g + 3], f) for g, f in zip(gram.tolist(), file.tolist(), strict=True)] == sorted({(x[i : i + 3], f) for f, t in enumerate(texts) for x in t.split("\n") for i in range(len(x) - 2)})


def test_the_index_is_stored_as_lists_without_a_shuffle(spark: SparkSession, tmp_path, monkeypatch: pytest.MonkeyPatch) -> None:
    texts = [("Heating\nStation", 1), (None, 2), ("ab", 3), *((f"nation {i % 7}\nheat {i}", i) for i in range(4, 400))]
    spark.createDataFrame(texts, "text string, id long").repartition(8).write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    plans: list[str] = []
    write = index.write_postings
    monkeypatch.setattr(index, "write_postings", lambda lists, *rest: (plans.append(lists._jdf.queryExecution().executedPlan().toString()), write(lists, *rest)))
    got = index.stored_postings(files, "id", "text")
    assert "Exchange" not in plans[0]
    expected = sorted({(x[i : i + 3], k) for t, k in texts if t for x in t.lower().split("\n") for i in range(len(x) - 2)})
    assert sorted((r.trigram, r.id) for r in got.collect()) == expected
    path = next(v for k, v in index._STORED.items() if str(tmp_path) in k[2])
    stored = spark.read.parquet(path).withColumn("part", F.input_file_name()).collect()
    assert len(stored) < len(expected) / 4
    by_part: dict[str, list[str]] = {}
    for r in stored:
        by_part.setdefault(r.part, []).append(r.trigram)
    assert all(v == sorted(v) for v in by_part.values())
    may = ranked.by_trigrams(got.withColumnRenamed("id", "filename"), ranked.parse("heat ation")).collect()
    assert {r.filename: r.possible for r in may} == {1: 3, **{i: 3 for i in range(4, 400)}}


def test_candidates_of_a_phrase_are_counted_in_one_shuffle(spark: SparkSession) -> None:
    files = spark.createDataFrame([(1, "the and"), (2, "the\nand he a"), (3, None), (4, "and the, then the and"), (4, "the an")], "id long, text string")
    found = search.trigram_candidates(index.trigram_postings(files.withColumn("text", F.lower("text")), "id", "text"), "the and", "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(r.id for r in found.collect()) == [1, 4]
    got = search.phrase_search(files, index.trigram_postings(files, "id", "text"), "the and", "id", "text").collect()
    assert [(r.id, r.occurrences) for r in got] == [(1, 1), (4, 1)]
