"""Continuation counts of the toxicity model."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import SparkSession

from quarry.llm import toxicity


def test_words_before_are_counted_without_a_ceiling(spark: SparkSession) -> None:
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(x for w in words[i : i + 50] for x in (w, "the")) for i in range(0, 5000, 50)]
    texts += [" ".join(rng.choices(["a", "b", "c", "the"], k=rng.randint(1, 9))) for _ in range(200)] + ["", None]
    toxic = [rng.randint(0, 1) for _ in texts]
    n, d, before = Counter(), Counter(), defaultdict(set)
    for t, c in zip(texts, toxic, strict=True):
        w = (t or "").split()
        d.update((x, c) for x in set(w))
        for x, y in zip(w, [None, *w], strict=False):
            n[x, c] += 1
            before[x].add(y)
    key = {x: int(toxicity.word_keys([x])[0].view("int64")[0]) for x in before}
    got = {r.key: tuple(r)[1:] for r in toxicity.word_counts(spark.createDataFrame(list(zip(texts, toxic)), "text string, toxic int").repartition(5)).collect()}
    assert got == {key[x]: (n[x, 1], n[x, 0], d[x, 1], d[x, 0], len(before[x])) for x in before}
    assert got[key["the"]][-1] > 5000
