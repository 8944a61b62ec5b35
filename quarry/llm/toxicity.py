"""Toxicity by class-conditional Kneser-Ney models.

Expressions are words. Each class (toxic, ordinary) is a history of its own: a word's probability
is its discounted count in the class, and the mass that the discounts free goes to a backoff
model that both classes share, Kneser-Ney continuation counts (the number of distinct words
before it, over all training texts). The discount is absolute for words whose document counts tell
the classes apart by a G-squared test and a least ratio; of a word that is rare, or that both
classes use alike, the discount is the whole count, so that both models know it by the shared
backoff alone; else chance counts of every topic and language would drown the few words that matter. Both models are
distributions: their probabilities sum to one. A text's score is a logistic function of the
difference of its two log-likelihoods, divided by its number of words.

Words that both models know by backoff alone have one and the same difference, that of the freed
masses; it is the origin of the scale on which differences are spread, so scoring looks up the
other words only. These are broadcast in blocks of `max_words` words at most; each further block is
one more pass over the texts, so no word is left out.

Counts come from every distinct labelled training text and are summed in Spark, first a row for each pair
of a word and the word before it, then a row for each word, so that the distinct words before are
counted one by one (the start of a text counts as one of them).

Defined cases: a null or empty text has a difference of 0; null ids are never trained on and not
held out; of several labels for an id the highest counts; repeated rows are scored alike; with labels of one class only, or none, every text gets the share of label 1
(0.0 without labels). Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: LEAST_EVIDENCE: what G-squared passes by chance for one word in ten thousand; with both at 0 all words have the same discount.
DISCOUNT, LEAST_EVIDENCE, LEAST_RATIO, SPREAD = 0.75, 15.13, 1.0, 200.0
#: Bytes of text whose words are found at once.
RUN = 1 << 18
_SEPARATE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_STEP = 0x9E3779B97F4A7C15
_COUNTS = "key long, before long, n_toxic long, n_ordinary long, d_toxic long, d_ordinary long"


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number and of its inverse."""
    return [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x % 2**64, np.uint64)])) for x in (_STEP, pow(_STEP, -1, 2**64))]


_UP, _DOWN = _powers(RUN + 1)


def _run_keys(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and first bytes of the words of a run that begins and ends with a blank."""
    change = np.diff((b != 32).view(np.int8))
    starts, ends = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
    up, down = (_UP, _DOWN) if len(b) <= RUN else _powers(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    key = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))) | np.uint64(1), starts


def word_keys(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A nonzero 64-bit key of each word (runs of letters and digits, in lower case) of the texts,
    and the index of its text. Long texts are read in runs that end between words."""
    parts = [b" " + (t or "").lower().encode("utf-8", "replace").translate(_SEPARATE) + b" " for t in texts]
    edges, data = np.cumsum([len(p) for p in parts]), b"".join(parts)
    keys, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at + 1 < len(data):
        end = len(data)
        if end - at > RUN:
            end = data.rfind(b" ", at + 1, at + RUN) + 1 or data.find(b" ", at + RUN) + 1
        key, starts = _run_keys(np.frombuffer(data, np.uint8, end - at, at))
        keys.append(key)
        places.append(starts + at)
        at = end - 1  # the blank between two runs ends one and begins the other
    return np.concatenate(keys), np.searchsorted(edges, np.concatenate(places), side="right")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) rows to counts of words and of documents with them by class, for each word
    before, summed within about a megabyte of text; a document counts where a word comes first."""
    for batch, texts in common.pieces(batches, "text"):
        key, doc = word_keys(texts)
        if not len(key):
            continue
        toxic = np.array(batch.column("toxic").to_pylist(), bool)[doc]
        first_of_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
        before = np.where(first_of_doc, np.uint64(0), np.concatenate([key[:1], key[:-1]]))
        by = np.lexsort((doc, key))
        new_doc = np.zeros(len(key), bool)
        new_doc[by] = np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (doc[by][1:] != doc[by][:-1])])
        by = np.lexsort((before, key))
        key, before, toxic, new_doc = key[by], before[by], toxic[by], new_doc[by]
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (before[1:] != before[:-1])]))
        columns = [key[at].view(np.int64), before[at].view(np.int64)] + [np.add.reduceat(x.astype(np.int64), at) for x in (toxic, ~toxic, new_doc & toxic, new_doc & ~toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _COUNTS.split(", ")])


def word_counts(learned: DataFrame) -> DataFrame:
    """(key, n_toxic, n_ordinary, d_toxic, d_ordinary, words_before) of rows (text, toxic)."""
    sums = [F.sum(c).alias(c) for c in ("n_toxic", "n_ordinary", "d_toxic", "d_ordinary")]
    return learned.transform(common.in_arrow, count_words, _COUNTS).groupBy("key", "before").agg(*sums).groupBy("key").agg(*sums, F.count("*").alias("words_before"))


def differences(model: common.Lookup, texts: list) -> np.ndarray:
    """The length-normalised difference of log-likelihoods of each text, less that of a text that
    both models know by backoff alone, as far as the words of `model` make it."""
    key, doc = word_keys(texts)
    value, _ = model.get(key)
    n = np.bincount(doc, minlength=len(texts))
    return np.bincount(doc, value, len(texts)) / np.maximum(n, 1)


def spread(difference: str) -> Column:
    """The difference on a scale on which a few words in a long text still count."""
    return F.signum(difference) * F.log1p(F.abs(difference) * SPREAD)


def _calibrate(rows: list) -> tuple[float, float]:
    """Logistic regression of (difference, label, count) rows."""
    x, y, n = (np.array(v, float) for v in zip(*rows, strict=True))
    scale = 1 / max(float(np.sqrt(np.average(x**2, weights=n))), 1e-6)
    z = np.stack([x * scale, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        grad = z @ (n * (p - y)) + 1e-3 * w
        hess = (z * (n * np.maximum(p * (1 - p), 1e-9))) @ z.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0] * scale), 0.0), float(w[1])


class Model:
    """What scoring needs: broadcast blocks of the table and the calibration."""

    def __init__(self, blocks: list[Broadcast], slope: float = 0.0, offset: float = 0.0) -> None:
        self.blocks, self.slope, self.offset = blocks, slope, offset

    def score(self) -> Column:
        return 1 / (1 + F.exp(-(self.slope * spread("_difference") + self.offset)))


def with_difference(docs: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """docs (with a column text) and _difference."""
    out = docs.withColumn("_difference", F.lit(0.0))
    names, schema = docs.columns, out.schema
    for number, block in enumerate(blocks):

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            model = common.Lookup(*block.value)
            for batch, texts in common.pieces(batches, "text"):
                d = batch.column("_difference").to_numpy() + differences(model, texts)
                yield common.keep_columns(batch, names, {"_difference": pa.array(d)})

        out = (common.written(out) if number else out).transform(common.in_arrow, run, schema)
    return out


def log_ratios(counts: DataFrame, docs_toxic: int, docs_ordinary: int, discount: float = DISCOUNT, least_evidence: float = LEAST_EVIDENCE, least_ratio: float = LEAST_RATIO) -> tuple[DataFrame, float]:
    """Of the words that a class knows by more than backoff (key, ratio): by how much their log
    ratio of probabilities exceeds that of all other words, which is returned with them. counts as
    `word_counts` gives them. No words if a class has none."""
    both, docs = F.col("d_toxic") + F.col("d_ordinary"), docs_toxic + docs_ordinary

    def part(c: str, n: int) -> Column:
        return F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * docs / (both * n))).otherwise(0.0)

    # of documents with the word, with half a one more in each class
    apart = F.abs(F.log((F.col("d_toxic") + 0.5) / (docs_toxic + 1)) - F.log((F.col("d_ordinary") + 0.5) / (docs_ordinary + 1)))
    told = (2 * (part("d_toxic", docs_toxic) + part("d_ordinary", docs_ordinary)) >= least_evidence) & (apart >= least_ratio)
    classes = ("n_toxic", "n_ordinary")
    judged = counts.withColumns({"told": told} | {f"off_{c}": F.when(told, F.least(F.col(c), F.lit(discount))).otherwise(F.col(c)) for c in classes})
    t = judged.agg(F.sum("words_before").alias("wb"), *(F.sum(x + c).alias(x + c) for c in classes for x in ("", "off_"))).first()
    if not all(t[c] for c in classes):
        return counts.select("key", F.lit(0.0).alias("ratio")).limit(0), 0.0
    freed = [t[f"off_{c}"] / t[c] for c in classes]
    back = F.col("words_before") / t["wb"]
    p = [(F.col(c) - F.col(f"off_{c}")) / t[c] + f * back for c, f in zip(classes, freed, strict=True)]
    base = math.log(freed[0] / freed[1])
    return judged.where("told").select("key", (F.log(p[0] / p[1]) - base).alias("ratio")), base


def train(labelled: DataFrame, max_words: int = 1 << 20, **options: float) -> Model:
    """labelled: text, toxic (0 or 1), neither null. Seven of eight texts are counted, the rest
    calibrate."""
    spark = labelled.sparkSession
    texts = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    part = F.pmod(F.xxhash64("text"), F.lit(8))
    docs = {r["toxic"]: r["count"] for r in texts.where(part != 0).groupBy("toxic").count().collect()}
    blocks = []
    if docs.get(0) and docs.get(1):
        ratios = common.settled(lambda: log_ratios(common.written(word_counts(texts.where(part != 0))), docs[1], docs[0], **options)[0])
        n = -(-ratios.count() // max_words)
        for i in range(n):
            kept = ratios.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).toArrow()
            blocks.append(spark.sparkContext.broadcast((kept.column("key").to_numpy().view(np.uint64), kept.column("ratio").to_numpy().astype(np.float32))))
    scored = with_difference(texts.where(part == 0), blocks)
    held = scored.groupBy(F.round(spread("_difference"), 2).alias("x"), "toxic").count().collect()
    share = texts.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    if not blocks or len({r["toxic"] for r in held}) < 2:
        return Model(blocks, 1.0 if blocks else 0.0, math.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    return Model(blocks, *_calibrate([(r["x"], r["toxic"], r["count"]) for r in held]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of docs (doc_id, text)."""
    out = with_difference(docs.select("doc_id", "text"), model.blocks).select("doc_id", model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (text, toxic) of labelled documents that are not held out. A text counts once in
    a class, else groups of copies would pass for evidence: of its documents the smallest id is
    taken, which numbers alone decide, so no text is shuffled for it."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("of")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~common.in_fold())
    known = rows.select("doc_id", "of").join(common.small(marks.where(~common.in_fold())), "doc_id")
    firsts = common.written(known.groupBy("of", "toxic").agg(F.min("doc_id").alias("doc_id")))
    return rows.join(common.small(firsts), ["doc_id", "of"]).select("text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_words: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from its training rows."""
    model = train(labelled_documents(docs, labels), max_words)
    return score(docs, model, threshold).select("doc_id", common.in_fold().alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_words: int = 1 << 20) -> DataFrame:
    """docs without those predicted toxic; all their columns. Each row is judged by itself, so
    no join brings scores back."""
    model = train(labelled_documents(docs, labels), max_words)
    inner, back = common.renamed(docs, "text")
    return with_difference(inner, model.blocks).where(model.score() < threshold).select(*back)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
