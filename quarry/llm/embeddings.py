"""Embedding near-dedup by lattice hashing.

Each table projects the unit vectors at random to `blocks` times 8 dimensions, shifts them and
decodes each 8 to the nearest point of the E8 lattice; the points together are the cell. A
vector is kept in its own cell and looks into the `probes` cells besides its own that differ in
one block by a minimal vector of the lattice, those nearest to it. What meets in a cell is first
compared by sign sketches, whose distance tells apart all but a few in a million of the
pairs far from the limit, then by the cosine in double precision.

Equal vectors are one row until the end, with their number, so copies are never paired. The number
of blocks follows from the number of different vectors, so that unlike vectors that meet stay about
as many for each vector however large the table is (a block lets one in 50 pass); the number of
tables follows from the blocks, so that a pair at cosine 0.95 meets with a chance of 0.997, a closer
one more likely. No bucket has a limit.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links
with nothing and is its own component; a null id takes no part in links and has a null component;
vectors of another length than most are compared with those of their own length only; repeated
rows are vectors of their own; other columns, as the label, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PROBES, SCALE, SKETCH = 8, 0.45, 4
#: Chance by simulation that a pair at cosine 0.95 meets in a table of two blocks, and by what each
#: further block multiplies it; share of unlike vectors that a block lets pass; how many may meet.
MEET, FURTHER, PASS, UNLIKE = 0.70, 0.57, 1 / 50, 200
_PAIRS = [[(i, s), (j, t)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
#: The 240 minimal vectors of E8: two whole steps, or all halves with an even number of plus signs.
MINIMAL = np.array([[dict(p).get(k, 0) for k in range(8)] for p in _PAIRS] + [h for h in product((0.5, -0.5), repeat=8) if h.count(0.5) % 2 == 0], float)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0) * (near.sum(-1, keepdims=True) % 2 != 0)
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice points: of D8, or of D8 shifted by halves."""
    whole, half = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1))[..., None], whole, half)


def _hash(cells: np.ndarray) -> np.ndarray:
    """Cells (n, dims) of halves to 64 bits."""
    key = np.full(len(cells), np.uint64(0x9E3779B97F4A7C15))
    for column in (cells * 2).astype(np.int64).view(np.uint64).T:
        key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


class Lattice:
    """Projections for one number of dimensions; the same on every executor."""

    def __init__(self, dims: int, tables: int, blocks: int, probes: int) -> None:
        rng = np.random.default_rng(dims * 1000 + blocks)
        self.blocks, self.probes = blocks, probes
        self.project = rng.normal(size=(tables, dims, 8 * blocks)) * SCALE
        self.shift = rng.uniform(-0.5, 0.5, (tables, 8 * blocks))
        self.signs = rng.normal(size=(dims, 64 * SKETCH))

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1, bitorder="little").view(np.int64)

    def cells(self, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each table the keys (n, 1 + probes), a vector's own cell first."""
        n = len(unit)
        for t, (g, b) in enumerate(zip(self.project, self.shift, strict=True)):
            x = (unit @ g + b).reshape(n, self.blocks, 8)
            point = decode_e8(x)
            gain = ((x - point) @ MINIMAL.T).reshape(n, -1)
            best = np.argpartition(-gain, min(self.probes, gain.shape[1] - 1), axis=1)[:, : self.probes]
            keys = [_hash(point.reshape(n, -1))]
            for k in range(best.shape[1]):
                moved = point.copy()
                moved[np.arange(n), best[:, k] // 240] += MINIMAL[best[:, k] % 240]
                keys.append(_hash(moved.reshape(n, -1)))
            yield t, np.stack(keys, 1)


def _keys(batches: Iterator[pa.RecordBatch], tables: int, blocks: int, probes: int) -> Iterator[pa.RecordBatch]:
    """(id, vector) of one length each to rows (id, dims, sketch, own, keys of a table)."""
    made: dict[int, Lattice] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            lengths = np.array([len(v) for v in batch.column("vector")])
            for dims in np.unique(lengths):
                rows = np.flatnonzero(lengths == dims)
                v = np.array([batch.column("vector")[int(i)].as_py() for i in rows], np.float64)
                unit = v / np.abs(v).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                lattice = made.get(dims) or made.setdefault(dims, Lattice(int(dims), tables, blocks, probes))
                sketch = lattice.sketch(unit).tolist()
                ids = batch.column("id").take(pa.array(rows))
                for t, keys in lattice.cells(unit):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(rows), dims), pa.int32()), pa.array(np.full(len(rows), t), pa.int32()), pa.array(sketch, pa.list_(pa.int64())), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["id", "dims", "table", "sketch", "keys"])


def _cosines(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4000):
            batch = whole.slice(at, 4000)
            x, y = (batch.column(c).flatten().to_numpy().astype(np.float64) for c in ("va", "vb"))
            lengths = np.diff(batch.column("va").offsets.to_numpy())
            edges = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
            if not len(edges):
                continue
            top = [np.repeat(np.maximum.reduceat(np.abs(v), edges), lengths) for v in (x, y)]
            x, y = x / top[0], y / top[1]
            dot, xx, yy = (np.add.reduceat(v, edges) for v in (x * y, x * x, y * y))
            yield batch.select(["a", "b"]).filter(pa.array(dot / np.sqrt(xx * yy) >= least))


def sketch_limit(least: float, bits: int = 64 * SKETCH) -> int:
    """Bits in which sketches of vectors at the least cosine differ at most, but for five
    standard deviations."""
    p = np.arccos(least) / np.pi
    return int(np.ceil(bits * p + 5 * np.sqrt(bits * p * (1 - p))))


def blocks_for(n: int) -> int:
    return max(2, math.ceil(math.log(max(n, 1) / UNLIKE) / -math.log(PASS)))


def tables_for(blocks: int, missed: float = 0.002) -> int:
    return math.ceil(math.log(missed) / math.log(1 - MEET * FURTHER ** (blocks - 2)))


def near_vectors(vectors: DataFrame, least: float = 0.95, blocks: int | None = None, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept; `blocks` by the number of vectors where not given."""
    good = F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", F.coalesce(good, F.lit(False)).alias("good"))
    named = rows.select("vec_id", "good", "embedding", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    classes = common.written(named.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.any_value("embedding").alias("vector")))
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    blocks = blocks or blocks_for(classes.count())
    tables = tables_for(blocks)
    keyed = common.written(classes.select("id", "vector").transform(common.in_arrow, lambda it: _keys(it, tables, blocks, probes), f"id {id_type}, dims int, table int, sketch array<long>, keys array<long>"))
    words = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]
    own = keyed.select(F.col("id").alias("a"), "dims", "table", F.col("keys")[0].alias("key"), *words)
    look = keyed.select(F.col("id").alias("b"), "dims", "table", F.explode("keys").alias("key"), *(w.alias(f"r{i}") for i, w in enumerate(words)))
    apart = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"r{i}"))) for i in range(SKETCH)), F.lit(0))
    met = own.join(look, ["dims", "table", "key"]).where((F.col("a") != F.col("b")) & (apart <= sketch_limit(least)))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    va, vb = (classes.select(F.col("id").alias(c), F.col("vector").alias(f"v{c}")) for c in "ab")
    links = common.written(pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").transform(common.in_arrow, lambda it: _cosines(it, least), f"a {id_type}, b {id_type}"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(classes.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "id")
    groups = common.components(links).withColumnRenamed("node", "id")
    result = common.written(classes.select("h1", "h2", "id", "copies").join(counts, "id", "left").join(groups, "id", "left").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component")))
    linked = named.where("good").select("vec_id", "h1", "h2").join(result, ["h1", "h2"]).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT vec_id, b FROM reached JOIN links ON other = a
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
), lowest AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN lowest USING (vec_id)
"""
