"""Versions of trees and texts: snapshot diffs, overlays, histories, line diffs and merges."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.batches import in_arrow, release, runs


def snapshot_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer by key of the rows that differ in some column: key, left and right structs (one
    is null where the key is new or gone), and change (added, removed, modified)."""
    a, b = (t.select(key, F.struct(*columns).alias(n)) for t, n in ((left, "left"), (right, "right")))
    both = a.join(b, key, "full").where(~F.col("left").eqNullSafe(F.col("right")))
    return both.withColumn("change", F.when(F.col("left").isNull(), "added").when(F.col("right").isNull(), "removed").otherwise("modified"))


def patch_states(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Two patches against one base, (key, state): what the step from old to new does to each path.
    States are added, modified, removed; a path that only the old patch has is reverted."""
    a, b = old.select(key, F.col("state").alias("was")), new.select(key, F.col("state").alias("now"))
    step = F.when(F.col("now").isNull(), "reverted").when(F.col("was").isNull(), F.col("now")).when((F.col("was") == "removed") & (F.col("now") != "removed"), "added").when((F.col("now") == "removed") & (F.col("was") != "removed"), "removed").when((F.col("was") == "removed") & (F.col("now") == "removed"), "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(key, step.alias("state"))


def layered(layers: list[DataFrame], key: str, value: str) -> DataFrame:
    """The value of the first layer that has the key: one aggregation over all layers."""
    tagged = [t.select(key, F.lit(i).alias("layer"), value) for i, t in enumerate(layers)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.min_by(F.struct("layer", value), "layer").alias("v")).select(key, "v.layer", f"v.{value}")


def basis_diff(changes: DataFrame, versions: DataFrame, after: int, upto: int) -> DataFrame:
    """Paths touched by changes with after < index <= upto: n_changes, and the data as of both
    ends (null: absent). changes: path, index; versions: row = path, ts = index, data, deleted."""
    touched = changes.where((F.col("index") > after) & (F.col("index") <= upto)).groupBy("path").agg(F.count("*").alias("n_changes"))
    seen = versions.join(touched.select(F.col("path").alias("row")), "row", "left_semi")

    def end(at: int, name: str) -> DataFrame:
        newest = seen.where(F.col("ts") <= at).groupBy("row").agg(F.max_by(F.struct("data", "deleted"), "ts").alias("v"))
        return newest.select(F.col("row").alias("path"), F.when(~F.col("v.deleted"), F.col("v.data")).alias(name))

    return touched.join(end(after, "old"), "path", "left").join(end(upto, "new"), "path", "left")


def directory(files: DataFrame, prefix: str, depth: int, path: str = "path") -> DataFrame:
    """Entries of exactly a depth below a prefix."""
    return files.where(F.col(path).startswith(prefix) & (F.size(F.split(F.col(path), "/")) == depth))


def history(versions: DataFrame, key: str, order: str, value: Column, out: str = "versions") -> DataFrame:
    """Each key's versions in order, as an array."""
    return versions.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("v")))), lambda x: x["v"]).alias(out))


def staged(changes: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Changes (key, data, deleted) that do something: no deletes of what is absent and no edits
    to what is there already."""
    b = base.select(key, F.col("data").alias("_base"), F.lit(True).alias("_there"))
    out = changes.join(b, key, "left")
    real = F.when(F.col("deleted"), F.col("_there").isNotNull()).otherwise(F.col("_there").isNull() | ~F.col("data").eqNullSafe(F.col("_base")))
    return out.where(real).select(*changes.columns)


def three_way(base: DataFrame, remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """(key, base, remote, local, state) of each path that the remote changed: take_remote where
    the local is as the base, same where both agree, else conflict (for `merge_texts`)."""
    sides = [t.select(key, F.col("data").alias(n)) for t, n in ((base, "base"), (remote, "remote"), (local, "local"))]
    out = sides[0].join(sides[1], key, "full").join(sides[2], key, "full").where(~F.col("base").eqNullSafe(F.col("remote")))
    state = F.when(F.col("local").eqNullSafe(F.col("base")), "take_remote").when(F.col("local").eqNullSafe(F.col("remote")), "same").otherwise("conflict")
    return out.withColumn("state", state)


def snapshot(versions: DataFrame, at: int) -> DataFrame:
    """(path, data) of every file as of an index; versions: row, col, ts, data, deleted."""
    newest = versions.where(F.col("ts") <= at).groupBy("row", "col").agg(F.max_by(F.struct("data", "deleted"), "ts").alias("v"))
    return newest.where("not v.deleted").select(F.concat_ws("/", "row", "col").alias("path"), "v.data")


def changed_files(files: DataFrame, at: int, ignored: list[str]) -> DataFrame:
    """A change's files (filename, index, reverted) as of a snapshot: the newest of each name, without
    reverted ones and names that match an ignored pattern."""
    newest = files.where(F.col("index") <= at).groupBy("filename").agg(F.max_by("reverted", "index").alias("reverted"))
    return reduce(lambda d, p: d.where(~F.col("filename").rlike(p)), ignored, newest.where("not reverted"))


def blobs_by_path(paths: DataFrame, files: DataFrame, blobs: DataFrame, strict: bool = False) -> DataFrame:
    """(path, sha, data): each path's hash, then what is stored under it. A hash without a blob is
    skipped; a path without a file is an error if strict, else skipped."""
    if strict and paths.join(files, "path", "left_anti").limit(1).count():
        raise KeyError("there is a path without a file")
    return paths.distinct().join(files, "path").join(blobs, "sha").select("path", "sha", "data")


def published(configs: DataFrame, name: str, order: str) -> DataFrame:
    """configs with ascending versions from 1 for each name."""
    return configs.withColumn("version", F.row_number().over(Window.partitionBy(name).orderBy(order)))


def registry(configs: DataFrame, name: str, order: str) -> DataFrame:
    """The newest version of each name: the number of its versions, and what came last."""
    rest = [c for c in configs.columns if c not in (name, order)]
    newest = configs.groupBy(name).agg(F.count("*").cast("int").alias("version"), F.max_by(F.struct(*rest), order).alias("v"))
    return newest.select(name, "version", "v.*")


def moved(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """rows (status, id and more) after updates (id, status, at): each row is under its newest status
    and under no other; updates of unknown ids do nothing."""
    last = updates.groupBy("id").agg(F.max_by("status", "at").alias("_new"))
    return rows.join(last, "id", "left").select(F.coalesce("_new", "status").alias("status"), *(c for c in rows.columns if c != "status"))


def change_list(changes: DataFrame, status: str | None = None, prefix: str = "", starting_from: int | None = None, limit: int = 1000) -> DataFrame:
    """A page of changes (id, status, key) in order of id."""
    out = changes.where(F.col("status") == status) if status else changes
    out = out.where(F.col("key").startswith(prefix)) if prefix else out
    out = out.where(F.col("id") >= starting_from) if starting_from is not None else out
    return out.orderBy("id").limit(limit)


#: Bits of the table of a longest common subsequence that are held at once (32 MB).
TABLE_BITS = 1 << 28


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs. Common ends go first; between them the table of
    lengths is a bit for each pair, a row at a time as one integer, and halved beyond TABLE_BITS."""
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out = [(i, i) for i in range(head)] + [(head + i, head + j) for i, j in _between(x, y)]
    return out + [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)]


def _rows(a: list, b: list) -> Iterator[int]:
    """For each head of a, the empty one first: bit j is 0 where b[: j + 1] has a longer
    subsequence in common with it than b[:j]."""
    at: dict = {}
    for j, v in enumerate(b):
        at[v] = at.get(v, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    yield row
    for v in a:
        if hit := row & at.get(v, 0):
            row = ((row + hit) | (row - hit)) & full
        yield row


def _between(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        for ahead in _rows(a[:half], b):
            pass
        for behind in _rows(a[: half - 1 : -1], b[::-1]):
            pass
        # where b is cut: the most in common before and after
        n = best = len(b) - behind.bit_count()
        cut, bits, back = 0, f"{ahead:0{len(b)}b}"[::-1], f"{behind:0{len(b)}b}"
        for j in range(len(b)):
            n += (bits[j] == "0") - (back[j] == "0")
            if n > best:
                best, cut = n, j + 1
        return common_subsequence(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in common_subsequence(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif rows[i - 1] >> (j - 1) & 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            i -= 1
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[str, object]]:
    """Patience diff as (=, -, +) steps: ends in common first, then the elements that are unique
    on both sides keep their order, and what lies between is diffed in its turn."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    steps: list[tuple[str, object]] = [("=", v) for v in a[:head]]
    nx, ny = Counter(x), Counter(y)
    once = {v for v, n in nx.items() if n == 1 and ny[v] == 1}
    ux, uy = [i for i, v in enumerate(x) if v in once], [j for j, v in enumerate(y) if v in once]
    pairs = [(ux[i], uy[j]) for i, j in common_subsequence([x[i] for i in ux], [y[j] for j in uy])]
    if pairs:
        i = j = 0
        for p, q in [*pairs, (len(x), len(y))]:
            steps += patience(x[i:p], y[j:q])
            if p < len(x):
                steps.append(("=", x[p]))
            i, j = p + 1, q + 1
    else:
        steps += [("-", v) for v in x] + [("+", v) for v in y]
    return steps + [("=", v) for v in a[len(a) - tail :]]


def byte_ranges(old: bytes, new: bytes) -> list[tuple[int, int, str, bytes]]:
    """(start, end, kind, data) by which bytes of old are added to, modified or removed, in order;
    line by line for texts, whole for anything else."""
    try:
        a, b = (re.findall(r"[^\n]*\n|[^\n]+", x.decode()) for x in (old, new))
    except UnicodeDecodeError:
        return [(0, len(old), "modified", new)]
    out, at, start, data, gone = [], 0, 0, [], 0
    for op, line in [*patience(a, b), ("=", "")]:
        if op == "+":
            data.append(str(line).encode())
        elif op == "-":
            gone += len(str(line).encode())
        else:
            if data or gone:
                out.append((start, start + gone, "modified" if data and gone else "added" if data else "removed", b"".join(data)))
            at = start + gone + len(str(line).encode())
            start, data, gone = at, [], 0
    return out


def patched(old: bytes, ranges: list) -> bytes:
    """The new side of byte ranges; ranges beyond the old side are an error."""
    out, at = [], 0
    for start, end, _, data in ranges:
        if start < at or max(start, end) > len(old):
            raise ValueError("a range lies outside of the text")
        out += [old[at:start], bytes(data)]
        at = end
    return b"".join([*out, old[at:]])


def applied(steps: list[tuple[str, object]]) -> list:
    """The new side of a diff."""
    return [v for op, v in steps if op != "-"]


def merge3(base: list, ours: list, theirs: list) -> tuple[list, int]:
    """A three-way merge of lines and its number of conflicts; a conflict keeps both sides between
    marks. Lines that all three share, by the diffs of each side to the base, divide the zones."""
    ma, mb = dict(common_subsequence(base, ours)), dict(common_subsequence(base, theirs))
    stable = [(i, ma[i], mb[i]) for i in range(len(base)) if i in ma and i in mb] + [(len(base), len(ours), len(theirs))]
    out: list = []
    conflicts = 0
    o = a = b = 0
    for i, j, k in stable:
        zone = base[o:i], ours[a:j], theirs[b:k]
        if zone[1] == zone[2] or zone[2] == zone[0]:
            out += zone[1]
        elif zone[1] == zone[0]:
            out += zone[2]
        else:
            conflicts += 1
            out += ["<<<<<<<", *zone[1], "=======", *zone[2], ">>>>>>>"]
        out += base[i : i + 1]
        o, a, b = i + 1, j + 1, k + 1
    return out, conflicts


#: Bytes of texts whose results are held at once.
RUN_BYTES = 1 << 18


def _of_texts(rows: DataFrame, texts: list[str], keep: list[str], make: Callable[..., tuple], made: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """keep and the columns `made` (types for Spark and Arrow), which `make` gives for each row's texts;
    null is empty. Results leave Python a run of RUN_BYTES of texts at a time, so a worker holds no more
    of them, however many rows its task has."""
    types = {c: rows.schema[c].dataType.simpleString() for c in keep} | {c: t for c, (t, _) in made.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, texts, RUN_BYTES):
                done = [make(*(x or "" for x in t)) for t in zip(*(part.column(c).to_pylist() for c in texts), strict=True)]
                more = [pa.array(c, t) for c, (_, t) in zip(zip(*done, strict=True), made.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *more], names=list(types))
        release()

    return in_arrow(rows.select(*dict.fromkeys([*keep, *texts])), run, ", ".join(f"{c} {t}" for c, t in types.items()))


def diff_texts(pairs: DataFrame, a: str, b: str, keep: list[str], by: str = " ") -> DataFrame:
    """keep, steps (array of op and value), n_same, n_removed, n_added of two text columns' parts."""

    def make(x: str, y: str) -> tuple:
        steps = patience(x.split(by), y.split(by))
        n = Counter(op for op, _ in steps)
        return steps, n["="], n["-"], n["+"]

    step = pa.list_(pa.struct([("op", pa.string()), ("value", pa.string())]))
    made = {"steps": ("array<struct<op: string, value: string>>", step)} | {c: ("long", pa.int64()) for c in ("n_same", "n_removed", "n_added")}
    return _of_texts(pairs, [a, b], keep, make, made)


def merge_texts(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, merged, n_conflicts of columns base, remote and local, line by line."""

    def make(*texts: str) -> tuple:
        merged, n = merge3(*(x.split("\n") for x in texts))
        return "\n".join(merged), n

    return _of_texts(rows, ["base", "local", "remote"], keep, make, {"merged": ("string", pa.string()), "n_conflicts": ("long", pa.int64())})


_RANGES = "array<struct<start: long, end: long, kind: string, data: binary>>"


def byte_diffs(pairs: DataFrame, old: str, new: str, keep: list[str]) -> DataFrame:
    """keep and ranges (`byte_ranges`) of two text columns; null is empty."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("data", pa.binary())]))
    return _of_texts(pairs, [old, new], keep, lambda x, y: (byte_ranges(x.encode(), y.encode()),), {"ranges": (_RANGES, kind)})


def apply_byte_diffs(diffs: DataFrame, old: str, keep: list[str]) -> DataFrame:
    """keep and data (binary): the old text with its ranges applied. Slices of bytes and a fold; no
    Python."""
    whole = F.encode(F.coalesce(old, F.lit("")), "utf-8")
    part = lambda a, b: F.substring(whole, (a + 1).cast("int"), (b - a).cast("int"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.encode(F.lit(""), "utf-8").alias("data"))
    folded = F.aggregate("ranges", first, lambda s, r: F.struct(r["end"].alias("at"), F.concat(s["data"], part(s["at"], r["start"]), r["data"]).alias("data")))
    return diffs.select(*keep, whole.alias("_whole"), folded.alias("_f")).select(*keep, F.concat("_f.data", F.substring("_whole", (F.col("_f.at") + 1).cast("int"), F.octet_length("_whole"))).alias("data"))
