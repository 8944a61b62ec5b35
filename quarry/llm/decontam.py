"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all windows of `size` consecutive words of the benchmark items; an item with fewer
words, but not none, is one pattern. All patterns of one length m form a searcher: a table of
blocks (two neighbouring words) tells how far the search may shift when a block ends at a
position; a block at the end of patterns has shift 0 and a bucket, by its hash, of those patterns'
first blocks and words, and direct comparison confirms an occurrence. A text is split once; most
positions are skipped unread.

The items are compiled on the driver in blocks of at most `block_words` words (some 600 bytes each),
so that what is broadcast is bounded whatever the size of the benchmark or of one item; each further
block is one more pass over the documents, whose marks are carried in columns.

Defined cases: null has no words (n_words 0, nothing hit); items without words match nothing; an
item that occurs twice is listed once for each distinct id; null item ids are left out of the list
but their windows hit; repeated documents are judged alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of items compiled at once: some 600 bytes each, so 60 MB on the driver and in a worker.
BLOCK_WORDS = 100_000
#: A-Z to lower case, digits and a-z and all beyond ASCII as they are, the rest to blanks.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORDS).split() if text else []


class Searcher:
    """Wu-Manber tables of distinct patterns of m words; a block is min(2, m) words."""

    def __init__(self, m: int, patterns: dict[tuple, set]) -> None:
        self.m, self.size = m, min(2, m)
        self.most = m - self.size + 1
        self.shift: dict[Any, int] = {}
        self.bucket: dict[Any, dict[tuple, tuple]] = {}
        for p, items in patterns.items():
            for end in range(self.size, m + 1):
                block = p[end - 1] if self.size == 1 else p[end - 2 : end]
                self.shift[block] = min(self.shift.get(block, self.most), m - end)
            self.bucket.setdefault(block, {})[p] = tuple(items)

    def find(self, w: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(first word, items) of each occurrence."""
        m, n, most, shift, bucket = self.m, len(w), self.most, self.shift.get, self.bucket
        at = m - 1
        if self.size == 1:
            for i, x in enumerate(w):
                if x in bucket:
                    yield i, bucket[x][(x,)]
            return
        while at < n:
            block = (w[at - 1], w[at])
            step = shift(block, most)
            if step:
                at += step
                continue
            items = bucket[block].get(tuple(w[at - m + 1 : at + 1]))
            if items is not None:
                yield at - m + 1, items
            at += 1


def compiled(items: list[tuple], size: int) -> list[Searcher]:
    """items: (id, words)."""
    by: dict[int, dict[tuple, set]] = {}
    for item, w in items:
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
    return [Searcher(m, p) for m, p in sorted(by.items())]


def hits(text: str | None, searchers: list[Searcher]) -> tuple[int, list[int], set]:
    """Number of words, the spans of hit words (first, end, ...; joined and ascending), items."""
    w = words(text)
    spans, items = [], set()
    for s in searchers:
        for first, which in s.find(w):
            spans.append((first, first + s.m))
            items.update(which)
    return len(w), joined(spans), items


def joined(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def _blocks(benchmark: DataFrame, size: int, block_words: int) -> Iterator[list[tuple]]:
    """The items, as they stream to the driver, in blocks of at most `block_words` words; a longer
    item is cut, each cut once more with the words that windows across it need."""
    held, n = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        w = words(text)
        for at in range(0, max(1, len(w) - size + 1), block_words):
            part = w[at : at + block_words + size - 1]
            if held and n + len(part) > block_words:
                yield held
                held, n = [], 0
            held.append((item, part))
            n += len(part)
    yield held


def marked(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of docs, with _words (long), _spans (array of long), _items (array of string)."""
    spark, names = docs.sparkSession, docs.columns
    extra = {"_words": pa.int64(), "_spans": pa.list_(pa.int64()), "_items": pa.list_(pa.string())}
    out = docs.withColumns({"_words": F.lit(0).cast("long"), "_spans": F.array().cast("array<long>"), "_items": F.array().cast("array<string>")})
    schema = out.schema
    for number, block in enumerate(_blocks(benchmark, size, block_words)):
        shared = spark.sparkContext.broadcast(compiled(block, size))

        def search(batches: Iterator[pa.RecordBatch], shared: Any = shared) -> Iterator[pa.RecordBatch]:
            searchers = shared.value
            for batch, texts in common.pieces(batches, "text"):
                counts, spans, items = [], [], []
                before = zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), strict=True)
                for t, (old, had) in zip(texts, before, strict=True):
                    n, new, found = hits(t, searchers)
                    counts.append(n)
                    spans.append(joined([*zip(old[::2], old[1::2], strict=True), *zip(new[::2], new[1::2], strict=True)]) if old else new)
                    items.append(sorted({*had, *(x for x in found if x is not None)}))
                yield common.keep_columns(batch, names, {k: pa.array(v, extra[k]) for k, v in zip(extra, (counts, spans, items), strict=True)})

        out = (common.written(out) if number else out).transform(common.in_arrow, search, schema)
    return out


def n_hit() -> Any:
    """Hit words of _spans: ends less starts."""
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: x - a)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, **options: Any) -> DataFrame:
    """docs without the documents that hold a window of an item; all their columns."""
    inner, back = common.renamed(docs, "text")
    return marked(inner, benchmark, size, **options).where(F.size("_spans") == 0).select(*back)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, **options: Any) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated."""
    out = marked(docs.select("doc_id", "text"), benchmark, size, **options)
    return out.select("doc_id", F.col("_words").alias("n_words"), n_hit().alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), (F.size("_spans") > 0).alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark
), patterns AS (
  SELECT DISTINCT id AS item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(10, len(w)) AS m FROM words WHERE kind = 'b' AND len(w) > 0))
), places AS (
  SELECT id AS doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT DISTINCT m FROM patterns) WHERE kind = 'd' AND len(w) >= m)
), found AS (
  SELECT doc_id, item_id, i, m FROM places JOIN patterns USING (m, p)
), hit AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS spot FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit ON hit.doc_id = id LEFT JOIN items ON items.doc_id = id WHERE kind = 'd'
"""
