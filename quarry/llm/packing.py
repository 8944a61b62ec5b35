"""Mixture-controlled packing by deficit round-robin.

Documents queue by source. In each round every queue's deficit counter grows by its share of a
window, and the queue sends the whole tokens of its counter and carries the fraction on. The
rounds, one after the other, are a gapless stream of tokens that is cut into windows; so every
window is full, and its tokens follow the target proportions to within a token per queue. Queues
with no tokens left drop out and the rest share the window: such phases number at most one for
each queue, and their bounds need only the queues' totals. All else is closed-form arithmetic:
a document's place in its queue is a prefix sum, and the pieces into which rounds and windows
cut it follow from that place alone. Nothing passes whole through one task.

Tokens are written once, with each row's place inside its partition; places across partitions
come from a window over (partition, queue) sums.

Defined cases: null text is empty and has its end token alone; a null source is a queue of its
own; repeated rows are packed as often as they come; an empty table gives no pieces; ids of any type,
and repeated or null ones, are carried as they are. Sources beyond `max_queues` share queues by hash.
Other columns are not read.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW, END_ID, MAX_QUEUES = 4096, 2, 256
#: Separators to Python that the tokenizer doesn't count as white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: What may not be cut at each change between letters and other signs: an apostrophe, and what
#: isn't ASCII or a Latin letter whose lower case doesn't depend on its neighbours.
_UNUSUAL = re.compile("['\x80-\xbf\xd7\xf7İƀ-\U0010ffff]")
#: The byte-level alphabet, by its rule: printable bytes are themselves, the others follow 255.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGN = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_BLANK, _LETTER, _SIGN, _DIGIT = 0, 1, 2, 3
_BY_SIGN = np.array([_BLANK if c in b" \t\n\r\x0b\x0c" else _LETTER if c > 127 or 97 <= c <= 122 else _DIGIT if 48 <= c <= 57 else _SIGN for c in range(256)], np.uint8)
_BY_BLANK = np.array([_BLANK if c == 32 else _SIGN for c in range(256)], np.uint8)
_STEP = 0x9E3779B97F4A7C15


class WordIds:
    """Ids of whole texts. The tokenizer encodes each distinct run of signs once: no token spans
    white space, nor in plain Latin texts a change between letters, digits and other signs; so a
    run's ids don't depend on its neighbours. Runs are found by a 64-bit hash of their bytes and
    kept up to a bound. Texts with what may be a special token, or with separators that only
    Python splits at, go to the tokenizer whole."""

    def __init__(self, tokenizer_json: str, most_words: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.t, self.most = Tokenizer.from_str(tokenizer_json), most_words
        self.t.no_truncation()
        self.t.no_padding()
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.at = common.Lookup(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.start, self.n, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n, 1 << 18) + 1
            self.power, self.inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x % 2**64, np.uint64)])) for x in (_STEP, pow(_STEP, -1, 2**64)))

    def _forget(self) -> None:
        """Keeps the half that was learned first: frequent words come early."""
        kept = len(self.n) // 2
        old = (self.at.keys != 0) & (self.at.values < kept)
        self.at = common.Lookup(self.at.keys[old], self.at.values[old])
        self.start, self.n, self.flat = self.start[:kept], self.n[:kept], self.flat[: self.start[kept]]

    def _learn(self, words: list[bytes], letters: np.ndarray) -> None:
        """letters: which are lower-case Latin letters alone, so that the model's merges give them."""
        model, ids = self.t.model, [None] * len(words)
        for i in np.flatnonzero(letters):
            w = words[i]
            ids[i] = [x.id for x in model.tokenize(w.decode() if w.isascii() else "".join([_BYTE_SIGN[b] for b in w]))]
        other = np.flatnonzero(~letters)
        for at in range(0, len(other), 2000):  # an encoding is far larger than its ids
            some = other[at : at + 2000]
            for i, x in zip(some, self.t.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False), strict=True):
                ids[i] = x.ids
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.n, self.flat = np.concatenate([self.n, n]), np.concatenate([self.flat, flat])

    def _of(self, texts: list[bytes], classes: np.ndarray) -> list[np.ndarray]:
        text = b" ".join([*texts, b""])
        b = np.frombuffer(text, np.uint8)
        kind = classes[b]
        change = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(b)]])
        full = kind[starts] != _BLANK
        starts, ends = starts[full], ends[full]
        self._powers(len(b))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b + np.uint64(1)) * self.power[: len(b)], dtype=np.uint64)])
        key = (sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)
        key = (key ^ (key >> np.uint64(31))) | np.uint64(1 << 63)
        at, hit = self.at.get(key)
        if not hit.all():
            if len(self.n) > self.most:
                self._forget()
                at, hit = self.at.get(key)
            missing = np.flatnonzero(~hit)
            new, first = np.unique(key[missing], return_index=True)
            where = missing[first]
            known = len(self.n)
            self._learn([text[i:j] for i, j in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], kind[starts[where]] == _LETTER)
            self.at.add(new, np.arange(known, known + len(new)))
            at[missing] = self.at.get(key[missing])[0]
        n = self.n[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])]
        edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return [ids[total[i] : total[j]] for i, j in pairwise(edges.tolist())]

    def __call__(self, texts: list) -> list[np.ndarray]:
        out: list[Any] = [None] * len(texts)
        plain, spaced = [], []
        for i, t in enumerate(texts):
            t = t or ""
            if any(s in t for s in self.special) or _ODD_SPACE.search(t):
                out[i] = np.array(self.t.encode(t, add_special_tokens=False).ids, np.uint32)
            elif _UNUSUAL.search(t):
                spaced.append((i, " ".join(t.split()).encode()))
            else:
                plain.append((i, t.lower().encode()))
        for group, classes in ((plain, _BY_SIGN), (spaced, _BY_BLANK)):
            if group:
                for (i, _), ids in zip(group, self._of([b for _, b in group], classes), strict=True):
                    out[i] = ids
        return out


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: Any) -> Iterator[pa.RecordBatch]:
    """(doc_id, queue, text) to ids with the end token, as little-endian bytes of the narrowest
    width, and the row's place in its queue inside this partition."""
    ids_of = WordIds(tokenizer.value)  # goes with the task: a worker that kept it would hold it for good
    part, sent = TaskContext.get().partitionId(), {}
    for batch, texts in common.pieces(batches, "text", 1 << 18):
        ids = [np.append(x, np.uint32(END_ID)) for x in ids_of(texts)]
        place = []
        for q, x in zip(batch.column("queue").to_pylist(), ids, strict=True):
            place.append(sent.get(q, 0))
            sent[q] = place[-1] + len(x)
        packed = [(x.astype("<u2") if x.max() < 65536 else x.astype("<u4")).tobytes() for x in ids]
        more = {"part": pa.array([part] * len(ids), pa.int32()), "place": pa.array(place, pa.int64()), "n": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array(packed, pa.binary())}
        yield common.keep_columns(batch, ["doc_id", "queue"], more)
    del ids_of
    common.release()


def phases(totals: dict[int, int], weights: dict[int, float], window: int = WINDOW) -> list[dict]:
    """Stretches of rounds with the same queues: rates per round, what each queue had sent
    before, where the stretch begins in the stream, its whole rounds. A stretch ends with a
    part round, in which the queues that run out send their rest."""
    left, sent, begin, out = {q: n for q, n in totals.items() if n > 0}, dict.fromkeys(totals, 0), 0, []
    while left:
        share = {q: max(weights.get(q, 0.0), 0.0) for q in left}
        if not sum(share.values()):
            share = {q: float(n) for q, n in left.items()}
        over = math.fsum(share.values())
        rate = {q: window * share[q] / over for q in sorted(left) if share[q] > 0}
        rounds = min(int(left[q] // r) for q, r in rate.items())
        while rounds and any(math.floor(rounds * r) > left[q] for q, r in rate.items()):
            rounds -= 1
        done = {q: math.floor(rounds * r) for q, r in rate.items()}
        last = {q: left[q] - done[q] for q, r in rate.items() if left[q] - done[q] <= r + 1}
        queues, at = sorted(rate), begin + sum(done.values())
        rest = {}
        for q in queues:
            if last.get(q):
                rest[q] = at
                at += last[q]
        before = {q: sent[q] for q in queues}
        for q in queues:
            sent[q] += done[q] + last.get(q, 0)
            left[q] -= done[q] + last.get(q, 0)
            if not left[q]:
                del left[q]
        out.append({"queues": queues, "rate": [rate[q] for q in queues], "sent": before, "done": done, "begin": begin, "rest": rest, "over": {q: sent[q] for q in queues}})
        begin = at
    return out


def _round_of(x: int, rate: float) -> int:
    """The round (from 0) that sends a queue's token x: the first r with floor((r+1)*rate) > x."""
    r = max(0, int((x + 1) / rate) - 2)
    while math.floor((r + 1) * rate) <= x:
        r += 1
    return r


def cuts(queue: int, first: int, last: int, plan: list[dict]) -> Iterator[tuple[int, int, int]]:
    """Runs (first token, end, place in the stream) of a queue's tokens [first, last)."""
    for p in plan:
        if queue not in p["sent"]:
            continue
        base, done = p["sent"][queue], p["done"][queue]
        lo, hi = max(first - base, 0), min(last - base, done)
        if lo < hi:
            i = p["queues"].index(queue)
            rates = np.array(p["rate"])
            rate = p["rate"][i]
            r = _round_of(lo, rate)
            while lo < hi:
                a, b = math.floor(r * rate), math.floor((r + 1) * rate)
                if b > lo:
                    before = np.floor(r * rates)
                    place = p["begin"] + int(before.sum()) + int((np.floor((r + 1) * rates[:i]) - before[:i]).sum())
                    end = min(hi, b)
                    yield base + lo, base + end, place + lo - a
                    lo = end
                r += 1
        if queue in p["rest"]:
            start = base + done
            lo, hi = max(first, start), min(last, p["over"][queue])
            if lo < hi:
                yield lo, hi, p["rest"][queue] + lo - start


def _pieces(batches: Iterator[pa.RecordBatch], plan: Any, window: int) -> Iterator[pa.RecordBatch]:
    schedule = plan.value
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        types = [batch.schema.field("doc_id").type] + [pa.int64()] * 6
        rows: list[list] = [[] for _ in names]
        for doc, q, ids, n, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "ids", "n", "first")), strict=True):
            wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
            runs: list[list[int]] = []
            for lo, hi, place in cuts(q, first, first + n, schedule):
                if runs and runs[-1][1] == lo and runs[-1][2] + lo - runs[-1][0] == place:
                    runs[-1][1] = hi  # the next round follows at once
                else:
                    runs.append([lo, hi, place])
            for lo, hi, place in runs:
                while lo < hi:
                    seq, offset = divmod(place, window)
                    end = min(hi, lo + window - offset)
                    for column, v in zip(rows, (doc, lo - first, end - lo, zlib.crc32(wide[lo - first : end - first].tobytes()), n, seq, offset), strict=True):
                        column.append(v)
                    place, lo = place + end - lo, end
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer_json: str, weights: dict[str | None, float] | None = None, window: int = WINDOW, max_queues: int = MAX_QUEUES) -> DataFrame:
    """Pieces of the documents' ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. weights: target proportions by source; by default the proportions of the tokens, with
    which all queues end together. `max_queues` bounds what the schedule is computed from: of more
    sources the half with the highest weights have queues of their own, and the others share the
    rest by hash, each queue with the weights of its sources together."""
    spark = docs.sparkSession
    sources = [r[0] for r in docs.select("source").distinct().limit(max_queues + 1).collect()]
    order = lambda s: (s is not None, s)
    named = weights or {}
    own = sorted(sources, key=order) if len(sources) <= max_queues else sorted(named, key=lambda s: (-named[s], order(s)))[: max_queues // 2]
    share = max(1, max_queues - len(own))
    others = F.pmod(F.xxhash64("source"), F.lit(share)).cast("int") + len(own)
    names = spark.createDataFrame([(s, i) for i, s in enumerate(own)], "own string, number int")
    queued = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source").join(F.broadcast(names), F.col("source").eqNullSafe(F.col("own")), "left").select("doc_id", "text", F.coalesce("number", others).alias("queue"))
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)
    id_field = docs.schema["doc_id"].dataType
    encoded = common.written(queued.transform(common.in_arrow, lambda it: _encode(it, tokenizer), f"doc_id {id_field.simpleString()}, queue int, part int, place long, n long, ids binary"))
    sums = encoded.groupBy("part", "queue").agg(F.sum("n").alias("sum_n"))
    before = F.coalesce(F.sum("sum_n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = common.written(sums.select("part", "queue", before.alias("before"), "sum_n"))
    totals = {r["queue"]: r["n"] for r in starts.groupBy("queue").agg(F.sum("sum_n").alias("n")).collect()}
    target = {q: float(n) for q, n in totals.items()}
    if weights is not None:
        rest = [(s, float(w)) for s, w in named.items() if s not in set(own)]
        hashed = spark.createDataFrame(rest, "source string, weight double").join(docs.select("source").distinct(), "source", "left_semi") if rest and len(sources) > max_queues else None
        target = {i: float(named.get(s, 0.0)) for i, s in enumerate(own)}
        target |= {r["queue"]: r["weight"] for r in hashed.groupBy(others.alias("queue")).agg(F.sum("weight").alias("weight")).collect()} if hashed is not None else {}
    plan = phases(totals, target, window)
    shared = spark.sparkContext.broadcast(plan)
    placed = encoded.join(common.small(starts.select("part", "queue", "before")), ["part", "queue"]).select("doc_id", "queue", "ids", "n", (F.col("place") + F.col("before")).alias("first"))
    return placed.transform(common.in_arrow, lambda it: _pieces(it, shared, window), f"doc_id {id_field.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer file's content, read on the driver; the path is a parameter."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_text(tokenizer_path))
