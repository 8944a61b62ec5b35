"""The two Kneser-Ney models against plain dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quarry.llm import toxicity


def plain(texts: list[str], toxic: list[int], least: float) -> tuple[dict[str, list[float]], list[float]]:
    """Each word's probability by class (ordinary, toxic), and that of the freed mass."""
    n, d, before = [Counter(), Counter()], [Counter(), Counter()], defaultdict(set)
    for t, c in zip(texts, toxic, strict=True):
        w = t.split()
        n[c].update(w)
        d[c].update(set(w))
        for x, y in zip(w, [None, *w], strict=False):
            before[x].add(y)
    docs = [toxic.count(c) for c in (0, 1)]

    def evidence(x: str) -> float:
        expected = [docs[c] * (d[0][x] + d[1][x]) / sum(docs) for c in (0, 1)]
        return 2 * sum(d[c][x] * math.log(d[c][x] / expected[c]) for c in (0, 1) if d[c][x])

    total, out, freed = sum(map(len, before.values())), defaultdict(list), []
    for c in (0, 1):
        off = {x: min(n[c][x], 0.75) if evidence(x) >= least else n[c][x] for x in before}
        size = sum(n[c].values())
        freed.append(sum(off.values()) / size)
        for x in before:
            out[x].append((n[c][x] - off[x]) / size + freed[c] * len(before[x]) / total)
    return out, freed


@pytest.mark.parametrize("least", [0.0, 3.0, toxicity.LEAST_EVIDENCE])
def test_differences_are_those_of_two_distributions(spark: SparkSession, least: float) -> None:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts, toxic = [], []
    for i in range(240):
        w = rng.choices(words, k=rng.randint(1, 40))
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            w.insert(rng.randrange(len(w)), rng.choice(["cad", "rotter"]))
        texts.append(" ".join(w))
    p, freed = plain(texts, toxic, least)
    assert all(abs(sum(v[c] for v in p.values()) - 1) < 1e-9 for c in (0, 1))
    counts = toxicity.word_counts(spark.createDataFrame(list(zip(texts, toxic, strict=True)), "text string, toxic int"))
    ratios, base = toxicity.log_ratios(counts, sum(toxic), len(toxic) - sum(toxic), least_evidence=least, least_ratio=0.0)
    assert base == pytest.approx(math.log(freed[1] / freed[0]))
    got = {r.key: r["ratio"] for r in ratios.collect()}
    assert 1 <= len(got) <= len(p)
    for x, (ordinary, bad) in p.items():
        key = int(toxicity.word_keys([x])[0].view(np.int64)[0])
        assert got.get(key, 0.0) == pytest.approx(math.log(bad / ordinary) - base, abs=1e-9)
    # a text's difference is that of its two log-likelihoods a word
    table = toxicity.common.Lookup(np.array(list(got), np.int64).view(np.uint64), np.array(list(got.values())))
    for t, d in zip(texts, toxicity.differences(table, texts), strict=True):
        w = t.split()
        assert d == pytest.approx(sum(math.log(p[x][1] / p[x][0]) for x in w) / len(w) - base, abs=1e-6)


def test_blocks_of_words_change_nothing(spark: SparkSession) -> None:
    rng = random.Random(4)
    rows = []
    for i in range(600):
        bad = int(i % 5 == 0)
        rows.append((i, " ".join([*rng.choices([f"w{k}" for k in range(200)], k=30), *([rng.choice(["cad", "rotter", "bounder", "blighter"])] * bad)]), bad))
    rows += [rows[0], (7, rows[7][1], 1 - rows[7][2]), (None, "cad", 1), (9999, None, 1)]  # repeated, and with two labels
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    one, many = (sorted(map(tuple, toxicity.toxicity(docs, labels, max_words=n).collect()), key=repr) for n in (1 << 20, 2))
    assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in many] and all(a[2] == pytest.approx(b[2], abs=1e-6) for a, b in zip(one, many, strict=True))
    assert 80 < sum(r[3] for r in one) < 160


def test_long_texts_are_read_in_runs(monkeypatch: pytest.MonkeyPatch) -> None:
    rng = random.Random(5)
    texts = [" ".join("ab"[: rng.randint(1, 2)] * rng.randint(1, 9) for _ in range(80)), "x" * 300, None, "a " * 70]
    want = toxicity.word_keys(texts)
    monkeypatch.setattr(toxicity, "RUN", 40)
    got = toxicity.word_keys(texts)
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and len(got[0]) == 151
