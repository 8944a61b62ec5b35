"""Token counts by a linear longest-match automaton.

The vocabulary's pieces are a trie with two roots: of pieces that begin a word and of those that
continue one. Each node has a failure link, the node that stands for what is left when the
greedy pieces of its string are taken off, and the number of those pieces. Reading a word's bytes
moves along the trie or, where it ends, along failure links while the counts add up; so a word's
length in pieces takes time linear in its bytes, and no piece is built.

The automaton is built once, on the driver, from the vocabulary file (its size is the
vocabulary's) and broadcast. Words are what white space separates; a byte-level vocabulary has
every single byte, so each word has pieces. A word that can't be matched counts as one token.

Defined cases: null and empty texts have 0 words and tokens; repeated rows count alike; any length
of text or word; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common


def byte_vocabulary(path: str | None = None) -> tuple[list[bytes], list[bytes]]:
    """Of a byte-level tokenizer file: the pieces that begin a word (their blank is taken off)
    and those that continue one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    with open(path, encoding="utf-8") as f:
        pieces = [bytes(sign[c] for c in p) for p in json.load(f)["model"]["vocab"] if all(c in sign for c in p)]
    first = [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1]
    return first + [bytes([b]) for b in range(256) if bytes([b]) not in set(first)], [p for p in pieces if p[:1] != b" "]


class Automaton:
    """goto: node << 8 | byte to node; fail: node to node or -1; popped: pieces taken off on the
    way to fail. Node 0 is the root of words, node 1 that of continuations."""

    def __init__(self, first: list[bytes], more: list[bytes]) -> None:
        self.goto: dict[int, int] = {}
        ends: set[int] = set()
        n = 2
        for root, pieces in ((0, first), (1, more)):
            for p in pieces:
                at = root
                for c in p:
                    at, old = self.goto.get(at << 8 | c, n), at
                    if at == n:
                        self.goto[old << 8 | c] = n
                        n += 1
                if p:
                    ends.add(at)
        below: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, v in self.goto.items():
            below[k >> 8].append((k & 255, v))
        self.fail, self.popped = [-1] * n, [0] * n
        level = [0, 1]
        while level:
            for u in level:
                for c, v in below[u]:
                    if v in ends:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, taken = self.fail[u], self.popped[u]
                    while z != -1 and z << 8 | c not in self.goto:
                        taken += self.popped[z]
                        z = self.fail[z]
                    if z != -1:
                        self.fail[v], self.popped[v] = self.goto[z << 8 | c], taken
            level = [v for u in level for _, v in below[u]]

    def count(self, word: bytes) -> int:
        goto, fail, popped = self.goto, self.fail, self.popped
        u = n = 0
        for c in word:
            v = goto.get(u << 8 | c)
            while v is None:
                if fail[u] == -1:
                    return 1
                n += popped[u]
                u = fail[u]
                v = goto.get(u << 8 | c)
            u = v
        while u > 1:
            if fail[u] == -1:
                return 1
            n += popped[u]
            u = fail[u]
        return n


class _Counts(dict):
    """Words' counts; the words learned first, which are the frequent ones, stay."""

    def __init__(self, automaton: Automaton, most: int = 400_000) -> None:
        super().__init__()
        self.count, self.most = automaton.count, most

    def __missing__(self, word: str) -> int:
        n = self.count(word.encode("utf-8", "replace"))
        if len(self) < self.most:
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(*byte_vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get: Any = _Counts(shared.value).__getitem__
        for batch, texts in common.pieces(batches, "text"):
            split = [(t or "").split() for t in texts]
            yield common.keep_columns(batch, ["doc_id"], {"n_words": pa.array([len(w) for w in split], pa.int64()), "n_tokens": pa.array([sum(map(get, w)) for w in split], pa.int64())})

    return docs.select("doc_id", "text").transform(common.in_arrow, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
