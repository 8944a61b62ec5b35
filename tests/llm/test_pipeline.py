"""The pipeline's stages, one after the other, against brute force on what each is given."""

from __future__ import annotations

import inspect
from pathlib import Path

import corpus_pipeline
import numpy as np
from pyspark.sql import SparkSession

from quarry.llm import decontam, packing, queries, simhash, toxicity

from .test_operators import classes, dedup_brute, jaccard

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark: SparkSession, tmp_path: Path) -> None:
    given = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 350 or doc_id > 900").orderBy("doc_id")
    given.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    sf, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.orderBy("doc_id").collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        out = spark.read.parquet(f"{sf}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
            kept[name] = after = {r.doc_id: r.text for r in out.orderBy("doc_id").collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
            assert set(after) == {i for i, bad in scores.items() if not bad} and any(scores.values())
        elif name == "line_dedup":
            assert list(after.values()) == dedup_brute(list(before.values())) and after != before
        elif name == "simhash_near_dedup":
            ids, words = sorted(before), {i: set(simhash.shingles(t, 5)) for i, t in before.items()}
            of: dict[bytes, list[int]] = {}
            for i in ids:
                for s in words[i] or {b""}:
                    of.setdefault(s, []).append(i)
            linked = {(a, b) for same in of.values() for a in same for b in same if a > b}
            group = classes(ids, [(a, b) for a, b in linked if jaccard(before[a], before[b]) >= 0.8])
            assert set(after) == {i for i in ids if group[i] == i} and len(after) < len(before)
        elif name == "benchmark_decontamination":
            w = {i: decontam.words(t) for i, t in before.items()}
            grams = {m: {tuple(v[k : k + m]) for _, t in items if min(10, len(v := decontam.words(t))) == m for k in range(len(v) - m + 1)} for m in range(1, 11)}
            assert set(after) == {i for i, v in w.items() if not any(tuple(v[k : k + m]) in g for m, g in grams.items() if g for k in range(len(v) - m + 1))}
            assert len(after) < len(before)
        else:
            rows = out.toPandas()
            assert set(rows.doc_id) == set(before)
            assert (rows.groupby("doc_id").length.sum() == rows.groupby("doc_id").doc_tokens.first()).all()
            fill = rows.groupby("sequence_id").length.sum().to_numpy()
            assert (np.sort(fill)[1:] == packing.WINDOW).all()
        docs = out
    run = {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "doc_tokens", "ids_crc32").collect() if r.doc_tokens < 50}
    assert {i for i, _, _ in run} <= set(kept["benchmark_decontamination"])


def test_queries_are_registered() -> None:
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
