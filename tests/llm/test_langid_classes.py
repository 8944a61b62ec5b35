"""What language ID learns from."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quarry.llm import langid


def test_every_language_is_learned_and_copies_count_once(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = [(f"text {i} of l{n}", f"l{n:03}") for n in range(130) for i in range(3 if n < 100 else 2)]
    # languages made mostly of one text, drawn by none or by all of its copies
    rows += [(f"hot {k}", f"hot{k}") for k in range(6) for _ in range(300)] + [(f"rare {k} {i}", f"hot{k}") for k in range(6) for i in range(4)]
    given: dict = {}
    monkeypatch.setattr(langid.Network, "train", lambda self, x, y: given.update(x=x, y=y))
    langs, tables = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4), per_class=10)
    assert langs == sorted({lang for _, lang in rows}) and len(tables["bias"]) == 136
    assert np.bincount(given["y"]).tolist() == [len({t for t, lang in rows if lang == x}) for x in langs]
