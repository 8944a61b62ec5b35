"""Repeated rows, null and odd ids, hot texts and long unbroken texts."""

from __future__ import annotations

import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontam, langid, packing, pii, simhash, tokens

from .test_operators import docs


def test_runs_of_texts_are_bounded(spark: SparkSession) -> None:
    import pyarrow as pa

    texts = ["é" * 5, None, "abc", "x" * 40, "", None, "yy"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": range(7)})
    got = list(common.pieces(iter([batch, batch.slice(7)]), "text", 12))
    assert [t for _, ts in got for t in ts] == texts and [len(ts) for _, ts in got] == [2, 1, 1, 3]
    assert [b.column("n").to_pylist() for b, _ in got] == [[0, 1], [2], [3], [4, 5, 6]]


def test_pii_takes_long_unbroken_texts_and_repeated_rows(spark: SparkSession) -> None:
    p = pii.Permuter("k")
    began = time.time()
    for text in ("a1" * 500_000, "a" * 10**6 + "@", "1." * 300_000, "a@" * 300_000, "a@b." * 200_000, "+1 " * 200_000, "0123456789abcdef" * 60_000):
        pii.pseudonymised(p, text)
    assert time.time() - began < 20
    assert pii.pseudonymised(p, "._-@mail.org x")[1] == [] and pii.pseudonymised(p, "(a.b@mail.org)")[1] == ["email"] and pii.pseudonymised(p, "a" * 65 + "@mail.org")[1] == []
    given = docs(spark, ["on 2024-02-29", "on 2024-02-29", "two words"], ids=[1, 1, None]).withColumns({"n_pii": F.lit("own"), "pii_kinds": F.lit("own")})
    out = pii.pseudonyms(given, "k").collect()
    assert len({r.text for r in out if r.doc_id == 1}) == 1 and sorted(r.n_pii for r in out) == [0, 1, 1] and all(r["score"] == "own score" for r in out)
    with pytest.raises(ValueError):
        pii.pseudonyms(given, "")


def test_language_of_hot_texts_numbers_and_long_words(spark: SparkSession) -> None:
    rows = [(i, "hello there you", "en") for i in range(20_000)] + [(-1, "½ ² ¾", "en"), (-2, "x" * 10**6, None), (-3, "bonjour à vous", "fr"), (-4, None, "fr")]
    out = langid.language(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8), per_class=50).where("doc_id < 0 or doc_id = 7").toPandas().set_index("doc_id")
    assert out.lang_pred[-1] == out.lang_pred[-4] == "und" and out.lang_pred[7] == "en" and out.lang_pred[-2] in ("en", "fr")


def test_counts_of_repeated_rows(spark: SparkSession) -> None:
    got = tokens.token_counts(docs(spark, ["one two"] * 3, ids=[1, 1, None])).collect()
    assert len(got) == 3 and len({tuple(r)[1:] for r in got}) == 1


def test_long_items_are_cut_without_loss(spark: SparkSession) -> None:
    rng = random.Random(3)
    item = [f"w{rng.randrange(40)}" for _ in range(500)]
    texts = [" ".join(item[i : i + 14]) for i in range(0, 480, 7)] + [" ".join(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "w1 w2 w3"), (None, "w4 w5")], "item_id long, text string")
    one, many = (sorted(map(tuple, decontam.contamination(docs(spark, texts, clash=False), bench, 10, block_words=n).collect())) for n in (10**6, 170))
    assert one == many and all(r[5] for r in one)


@pytest.mark.parametrize("kind", ["int", "string", "decimal(20,0)", "double", "binary"])
def test_packing_carries_ids_of_any_type(spark: SparkSession, kind: str) -> None:
    given = docs(spark, ["one two three"] * 3 + [None], ids=[1, 1, 2, None], clash=False).withColumn("doc_id", F.col("doc_id").cast("string").cast(kind))
    out = packing.pack(given, packing.tokenizer_text())
    assert out.schema["doc_id"].dataType == given.schema["doc_id"].dataType
    ids = [r.doc_id for r in out.select("doc_id").distinct().collect()]
    assert len(ids) == 3 and None in ids and (kind != "decimal(20,0)" or Decimal(1) in ids)


def test_weights_of_more_sources_than_queues(spark: SparkSession) -> None:
    rows = [(i, " ".join(["word"] * 40), f"s{i % 30:02}") for i in range(600)]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights: dict = {f"s{i:02}": 1.0 for i in range(30)} | {"s17": 71.0, "gone": 5.0}
    out = packing.pack(given, packing.tokenizer_text(), weights, window=128, max_queues=8).toPandas()
    of = given.toPandas().set_index("doc_id").source
    heavy = out[out.doc_id.map(of) == "s17"]
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()
    # seven tenths of each window are of the heavy source while it lasts
    first = heavy[heavy.sequence_id < 5].length.sum() / out[out.sequence_id < 5].length.sum()
    assert 0.66 < first < 0.75


def test_near_copies_without_ids(spark: SparkSession) -> None:
    rng = random.Random(2)
    base = [" ".join(rng.choices("abcdefghij", k=6) + [f"w{i}.{k}" for k in range(80)]) for i in range(6)]
    texts = [x for t in base for x in (t, t + " more", t)]
    given = docs(spark, texts, ids=[None] * 6 + list(range(12)))
    kept = simhash.drop_near_copies(given).collect()
    assert sorted({r.text.split()[6] for r in kept}) == [f"w{i}.0" for i in range(6)] and len({r.text for r in kept}) == 6
    assert len([r for r in kept if r.doc_id is not None]) == 4
    got = {(r.doc_id, r.keeper) for r in simhash.near_copies(given).collect()}
    assert {k for i, k in got if i is not None} == {0, 3, 6, 9}
