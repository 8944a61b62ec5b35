"""Language identification by a byte convolutional network.

Fixed windows of bytes; filters of several widths over byte embeddings; the largest value of each
filter in the window; a softmax. Training is plain numpy on the driver, on a bounded sample:
`per_class` windows of each language at most, one from each distinct text that a hash of the text
chooses (the bound is this parameter; every language is learned, however many there are).
Whole texts are judged: each is cut into windows, and the windows' probabilities are averaged by
the bytes they hold. Since a filter is linear in its bytes, it becomes sums of table entries for
pairs of bytes, so a window costs a few gathers for each byte.

Defined cases: a text that is null or has no letter is `und` with score 0; with no training rows
everything is `und`; null languages aren't learned; equal probabilities go to the first language
in order; repeated rows are judged alike, and copies of a text are one draw of the sample; a text of any length is read whole. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, WIDTHS, FILTERS, DIM = 192, (2, 3, 4), 16, 12
#: Of training texts too: a letter is what Unicode says is one.
_LETTER = regex.compile(r"\p{L}")


class Network:
    """Weights: byte embeddings, for each width a (width * DIM, FILTERS) matrix and its biases,
    and the output layer."""

    def __init__(self, classes: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.w = {"embed": rng.normal(0, 0.3, (256, DIM)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "bias": np.zeros(classes)}
        for k in WIDTHS:
            self.w[f"conv{k}"] = rng.normal(0, (k * DIM) ** -0.5, (k * DIM, FILTERS))
            self.w[f"b{k}"] = np.zeros(FILTERS)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of windows x and classes y."""
        w, n = self.w, len(x)
        emb = w["embed"][x]
        pooled, back = [], []
        for k in WIDTHS:
            at = x.shape[1] - k + 1
            wide = np.concatenate([emb[:, i : i + at] for i in range(k)], axis=2)
            z = wide @ w[f"conv{k}"] + w[f"b{k}"]
            top = z.argmax(1)
            pooled.append(np.take_along_axis(z, top[:, None], 1)[:, 0])
            back.append((wide, top))
        h = np.concatenate(pooled, 1)
        r = np.maximum(h, 0)
        p = np.exp((q := r @ w["out"] + w["bias"]) - q.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        grad = {"out": r.T @ p, "bias": p.sum(0), "embed": np.zeros_like(w["embed"])}
        dh = (p @ w["out"].T) * (h > 0)
        for i, (k, (wide, top)) in enumerate(zip(WIDTHS, back, strict=True)):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            seen = np.take_along_axis(wide, top[:, :, None], 1)  # window, filter, k * DIM
            grad[f"conv{k}"] = np.einsum("nfe,nf->ef", seen, d)
            grad[f"b{k}"] = d.sum(0)
            de = (d[:, :, None] * w[f"conv{k}"].T[None]).reshape(n, FILTERS, k, DIM)
            for j in range(k):
                np.add.at(grad["embed"], np.take_along_axis(x, top + j, 1), de[:, :, j])
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 11, steps: int = 450) -> None:
        """`epochs` times over the windows, oftener if that makes fewer than `steps` steps."""
        epochs = max(epochs, -(-steps * batch // max(1, len(x))))
        rng, t = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick, t = order[i : i + batch], t + 1
                for k, g in self.step(x[pick], y[pick]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> dict[str, np.ndarray]:
        """For each width: table of the first byte pair, and what further bytes add."""
        out = {"out": self.w["out"], "bias": self.w["bias"]}
        for k in WIDTHS:
            single = [self.w["embed"] @ self.w[f"conv{k}"][j * DIM : (j + 1) * DIM] for j in range(k)]
            for j in range(0, k, 2):
                if j + 1 < k:
                    pair = (single[j][None, :, :] + single[j + 1][:, None, :]).reshape(65536, FILTERS)  # low byte first
                else:
                    pair = single[j]
                out[f"{k}.{j}"] = np.ascontiguousarray(pair + (self.w[f"b{k}"] if j == 0 else 0), np.float32)
        return out


def probabilities(tables: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Class probabilities of windows x (n, WINDOW) of bytes."""
    pairs = x[:, :-1].astype(np.int32) | (x[:, 1:].astype(np.int32) << 8)
    pooled = []
    for k in WIDTHS:
        n = x.shape[1] - k + 1
        z = tables[f"{k}.0"][pairs[:, :n]]
        for j in range(2, k, 2):
            z += tables[f"{k}.{j}"][(pairs if j + 1 < k else x)[:, j : j + n]]
        pooled.append(z.max(1))
    q = np.maximum(np.concatenate(pooled, 1), 0) @ tables["out"] + tables["bias"]
    p = np.exp(q - q.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def windows(data: bytes) -> np.ndarray:
    """Whole data as rows of WINDOW bytes, the last filled up with zeros."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def judge(tables: dict[str, np.ndarray], texts: list, step: int = 256) -> np.ndarray:
    """Average probabilities of each text's windows, weighted by their bytes."""
    data = [prepared(t) if t else b"" for t in texts]
    x = np.concatenate([windows(d) for d in data]) if data else np.zeros((0, WINDOW), np.uint8)
    of = np.repeat(np.arange(len(data)), [-(-len(d) // WINDOW) for d in data])
    sums = np.zeros((len(data), len(tables["bias"])))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        np.add.at(sums, of[i : i + step], probabilities(tables, part) * (part != 0).sum(1, keepdims=True))
    return sums / np.maximum(sums.sum(1, keepdims=True), 1e-12)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, draw, text) to one window of each text, at a place that the draw decides."""
    for batch, texts in common.pieces(batches, "text"):
        draws = batch.column("draw").to_pylist()
        found = []
        for t, draw in zip(texts, draws, strict=True):
            x = windows(prepared(t))
            found.append(x[int(draw * 7919) % max(1, len(x) - 1)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array(found, pa.binary())], names=["lang", "draw", "window"])


def train(docs: DataFrame, per_class: int = 1200) -> tuple[list[str], dict[str, np.ndarray]]:
    """From docs (text, lang), all of which may be learned from: languages in order, tables."""
    draw = (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)).alias("draw")
    rows = docs.where("lang is not null and text is not null and text rlike '\\\\p{L}'").select("lang", "text", draw)
    # copies of a text are one draw, here and in the sample
    counts = {r["lang"]: r["count"] for r in rows.select("lang", F.xxhash64("text").alias("of")).distinct().groupBy("lang").count().collect()}
    if not counts:
        return [], {}
    share = docs.sparkSession.createDataFrame([(k, min(1.0, 1.2 * per_class / n)) for k, n in counts.items()], "lang string, share double")
    chosen = rows.join(F.broadcast(share), "lang").where("draw <= share").select("lang", "draw", "text")
    sample = chosen.transform(common.in_arrow, _sampled, "lang string, draw double, window binary").distinct().toPandas().sort_values(["lang", "draw", "window"])
    sample = sample.groupby("lang").head(per_class)
    langs = sorted(counts)
    net = Network(len(langs))
    net.train(np.stack([np.frombuffer(w, np.uint8) for w in sample["window"]]), np.searchsorted(langs, sample["lang"]))
    return langs, net.tables()


def identify(docs: DataFrame, langs: list[str], tables: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tables = shared.value
        for batch, texts in common.pieces(batches, "text"):
            known = np.array([bool(langs) and bool(t) and _LETTER.search(t) is not None for t in texts], bool)
            p = judge(tables, texts) if langs else np.zeros((len(texts), 1))
            best = p.argmax(1)
            names = [langs[i] if ok else "und" for i, ok in zip(best, known, strict=True)]
            yield common.keep_columns(batch, ["doc_id"], {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(known, np.clip(p.max(1), 0, 1), 0.0), pa.float64())})

    return docs.select("doc_id", "text").transform(common.in_arrow, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language(docs: DataFrame, per_class: int = 1200) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the rows that aren't held out."""
    langs, tables = train(docs.where(~common.in_fold() & F.col("doc_id").isNotNull()).select("text", "lang"), per_class)
    return identify(docs, langs, tables).select("doc_id", common.in_fold().alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(common.table(spark, sf_dir, "documents"))
