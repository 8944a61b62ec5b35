"""The text and code index: files, trigrams, keywords, definitions, links with ranks, entities.

Postings are made distinct inside each file, and kept as lists of files, before anything is shuffled."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import symbols
from quarry.functions import text as T
from quarry.operators import graph
from quarry.operators.batches import in_arrow, pieces
from quarry.operators.tables import shared_dir, spread, written


def lines(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, line_number from 0, line)."""
    return files.select(key, F.posexplode(F.split(content, "\n")).alias("line_number", "line"))


#: Bytes of texts whose files share posting lists, and signs that are looked at together.
LISTED, SIGNS = 1 << 19, 1 << 17


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams (rows of three code points, ascending), and the pairs of one's number and a
    text's, ascending. A line end stands between texts, so that none crosses it."""
    joined = "\n".join(texts)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    grams, held = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    for i in range(0, max(len(joined) - 2, 0), SIGNS):
        signs = np.frombuffer(joined[i : i + SIGNS + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        inside = (signs[:-2] != 10) & (signs[1:-1] != 10) & (signs[2:] != 10)
        code, found = pd.factorize((signs[:-2] << 42 | signs[1:-1] << 21 | signs[2:])[inside])
        pair = pd.unique(code * len(texts) + owner[i : i + len(signs) - 2][inside])
        grams, place = np.unique(np.concatenate([grams, found]), return_inverse=True)
        old = len(place) - len(found)
        held = np.concatenate([[place[held[0]], held[1]], [place[old:][pair // len(texts)], pair % len(texts)]], axis=1)
    pair = np.unique(held[0] * len(texts) + held[1])
    return np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4"), pair // max(len(texts), 1), pair % max(len(texts), 1)


def _listed(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct trigrams, ascending, where each one's list ends, and the lists: places of texts."""
    grams, gram, place = _pairs(["" if t is None else t for t in texts])
    text = grams.tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.searchsorted(gram, np.arange(len(grams) + 1)).astype(np.int32)
    return [text[i : i + 3] for i in range(0, len(text), 3)], ends, place.astype(np.int32)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches, "content", LISTED):
        grams, ends, place = _listed(texts)
        keys = pa.ListArray.from_arrays(pa.array(ends), batch.column("key").take(pa.array(place)))
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), keys], names=["trigram", "keys"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    for run, (batch, texts) in enumerate(pieces(batches, "content", LISTED), first):
        grams, ends, place = _listed(texts)
        places = pa.ListArray.from_arrays(pa.array(np.concatenate([ends[:1], ends])), pa.array(place))
        named = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("key"))
        keys = pa.concat_arrays([named, pa.nulls(len(grams), named.type)])
        yield pa.RecordBatch.from_arrays([pa.array(["", *grams], pa.string()), pa.array(np.full(len(keys), run)), places, keys], names=["trigram", "run", "places", "keys"])


def posting_lists(files: DataFrame, key: str = "filename", content: str = "content") -> DataFrame:
    """(trigram, keys): three characters of a line, never across lines, and the files that have them; a
    row for each run of files of some LISTED bytes, with a file's key once."""
    named = spread(files.select(F.col(key).alias("key"), F.col(content).alias("content")))
    return in_arrow(named, _lists, f"trigram string, keys array<{files.schema[key].dataType.simpleString()}>")


def placed_lists(files: DataFrame, key: str, content: str) -> DataFrame:
    """(trigram, run, places, keys): as `posting_lists`, but a list has a file's place in its run, and a
    row of the empty trigram the run's keys. So each key is there once, however long it is and however
    many trigrams its file has."""
    named = spread(files.select(F.col(key).alias("key"), F.col(content).alias("content")))
    return in_arrow(named, _places, f"trigram string, run long, places array<int>, keys array<{files.schema[key].dataType.simpleString()}>")


def trigram_postings(files: DataFrame, key: str = "filename", content: str = "content") -> DataFrame:
    """(trigram, key), once for each file."""
    return posting_lists(files, key, content).select("trigram", F.explode("keys").alias(key))


def keyword_counts(files: DataFrame, key: str = "filename", content: str = "content", least: int = 4) -> DataFrame:
    """(key, token, occurrences) of each file."""
    return spread(files.select(key, content)).select(key, F.explode(T.tokens(F.col(content), least)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("occurrences"))


def keywords(files: DataFrame, content: str = "content", least: int = 4) -> DataFrame:
    """(normalized, keyword, occurrences): spellings below their normal form, of over 4 bytes."""
    words = spread(files.select(content)).select(F.explode(T.tokens(F.col(content), least)).alias("keyword")).withColumn("normalized", T.normalized(F.col("keyword")))
    return words.where(F.octet_length("normalized") > 4).groupBy("normalized", "keyword").agg(F.count("*").alias("occurrences"))


def definitions(files: DataFrame) -> DataFrame:
    """(filename, symbol, symbol_type, line_number, end_line_number, normalized) of all definitions."""
    found = symbols.file_definitions(spread(files.select("filename", T.file_type(F.col("filename")).alias("file_type"), "content")))
    return found.withColumn("normalized", T.normalized(F.col("symbol")))


#: Bytes of a row group of the stored index.
GROUP_BYTES = 8 << 20


def write_postings(lists: DataFrame, path: str) -> None:
    """Posting lists, those of a task's files sorted by trigram: a look-up reads the pages that may have
    its trigrams. Nothing is shuffled, so the cost of a file doesn't depend on how many there are."""
    lists.sortWithinPartitions("trigram").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(path)


_STORED: dict[tuple, str] = {}


def stored_postings(files: DataFrame, key: str, content: str) -> DataFrame:
    """(trigram, key) of the trigram index of texts in lower case, a table that is written at its first
    use in a session and read from then on. Files that were changed since are another table."""
    spark = files.sparkSession
    of = (spark.sparkContext.applicationId, key, *sorted(files.inputFiles()))
    if of not in _STORED:
        path = f"{shared_dir(spark).rstrip('/')}/quarry-index-{uuid.uuid4().hex}"
        write_postings(placed_lists(files.select(key, F.lower(content).alias(content)), key, content), path)
        _STORED[of] = path
        atexit.register(shutil.rmtree, path.removeprefix("file:"), ignore_errors=True)
    stored = spark.read.parquet(_STORED[of])
    lists, named = stored.where("trigram <> ''").select("trigram", "run", "places"), stored.where("trigram = ''").select("run", "keys")
    return lists.join(named, "run").select("trigram", F.explode(F.transform("places", lambda p: F.get("keys", p))).alias(key))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(filename, target, resolved): an import's file is, first, the name itself; then the name
    below a proper ancestor of the importing file's directory, the shortest first; then the
    shortest file that ends with it. The first two are equi-joins. So is the third: files are
    keyed by each of their path suffixes, which are as many as a path has parts."""
    names = files.select(F.col("filename").alias("resolved"))
    i = imports.select("filename", "target").distinct()
    up = F.split("filename", "/")
    above = i.select("filename", "target", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size(up) - 2, F.lit(0))), lambda n: F.concat(F.array_join(F.slice(up, 1, n), "/"), F.when(n > 0, "/").otherwise(""), F.col("target")))).alias("step", "path"))
    near = above.join(names, F.col("path") == F.col("resolved")).select("filename", "target", "resolved", F.when(F.col("step") == 0, 0).otherwise(1).alias("way"), "step")
    parts = F.split("resolved", "/")
    suffixes = names.select("resolved", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("target"))
    far = i.join(suffixes, "target").select("filename", "target", "resolved", F.lit(2).alias("way"), F.length("resolved").alias("step"))
    best = F.min_by("resolved", F.struct("way", "step", "resolved"))
    return near.unionByName(far).groupBy("filename", "target").agg(best.alias("resolved"))


def link_graph(files: DataFrame, imports: DataFrame) -> DataFrame:
    """files with imports, dependents (sorted arrays of names) and page_rank."""
    edges = written(imports.select(F.col("filename").alias("src"), F.col("resolved").alias("dst")))
    ranks = graph.page_rank(files.select(F.col("filename").alias("id")), edges)
    keyed = graph.both_ways(edges)
    arrays = keyed.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("src") == F.col("key"), F.col("dst")))).alias("imports"), F.sort_array(F.collect_list(F.when(F.col("src") != F.col("key"), F.col("src")))).alias("dependents"))
    empty = F.array().cast("array<string>")
    out = files.join(arrays.withColumnRenamed("key", "filename"), "filename", "left").join(ranks.withColumnRenamed("id", "filename"), "filename")
    return out.withColumns({"imports": F.coalesce("imports", empty), "dependents": F.coalesce("dependents", empty)}).withColumnRenamed("rank", "page_rank")


def enclosing(found: DataFrame) -> DataFrame:
    """Definitions with the structure that has an end and was last begun before each (inside, and its
    until); a window over one file's definitions."""
    w = Window.partitionBy("filename").orderBy("line_number").rangeBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when((F.col("symbol_type") == "STRUCTURE") & (F.col("end_line_number") > 0), F.struct(F.col("symbol").alias("inside"), F.col("end_line_number").alias("until"))), ignorenulls=True).over(w)
    return found.withColumn("_s", begun).select(*found.columns, "_s.inside", "_s.until")


def entities(found: DataFrame) -> DataFrame:
    """(name, keywords, kind, filename, line_number): structures and traits by their names, functions
    by theirs or, inside of a structure, as `Structure::function`; functions of files in which no
    structure begins before them are none."""
    s = enclosing(found).where("symbol_type <> 'VARIABLE' and (symbol_type <> 'FUNCTION' or inside is not null)")
    within = (F.col("symbol_type") == "FUNCTION") & (F.col("line_number") < F.col("until"))
    name = F.when(within, F.concat_ws("::", "inside", "symbol")).otherwise(F.col("symbol"))
    return s.select(name.alias("name"), F.when(within, F.array(name, "symbol")).otherwise(F.array("symbol")).alias("keywords"), F.col("symbol_type").alias("kind"), "filename", "line_number")


def target_entities(targets: DataFrame) -> DataFrame:
    """(name, keywords, kind, filename, line_number, files, dependencies) of build targets."""
    return targets.select(F.col("canonical_name").alias("name"), F.array("canonical_name", "name").alias("keywords"), F.lit("TARGET").alias("kind"), "filename", "line_number", "files", "dependencies")


def build_index(files: DataFrame, imports: DataFrame) -> dict[str, DataFrame]:
    """All tables of the index of files (filename, content) and their imports (filename, target)."""
    flagged = files.withColumns({"file_type": T.file_type(F.col("filename")), "is_test": T.is_test(F.col("filename")), "is_ugly": T.is_ugly(F.col("content"))})
    resolved = resolve_imports(imports, files)
    defined = definitions(files)
    return {"files": link_graph(flagged, resolved), "trigrams": trigram_postings(files.withColumn("content", F.lower("content"))), "keywords": keywords(files), "definitions": defined, "entities": entities(defined)}
