"""Python data sources for two simple file formats.

recordio: records of a 4-byte little-endian length and a payload, in no order.
keyed: sorted (key, value) records, each a 2-byte key length, the key, a 4-byte value length, the
value. A path may be a file, a folder, or `base@N` for N shards; each file is one partition.
Both read and write; a truncated record ends its file (mode DROPMALFORMED) or is an error."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThanOrEqual, InputPartition, LessThan, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.operators.dataflow import shard_names


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_")))
    return shard_names(path)


def _exactly(f: Any, n: int, lenient: bool) -> bytes | None:
    data = f.read(n)
    if len(data) == n:
        return data
    if data and not lenient:
        raise ValueError(f"{f.name}: a record is cut short")
    return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.lenient = options["path"], options.get("mode", "FAILFAST").upper() == "DROPMALFORMED"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)]


class RecordReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            while (head := _exactly(f, 4, self.lenient)) is not None:
                data = _exactly(f, struct.unpack("<I", head)[0], self.lenient)
                if data is None:
                    if self.lenient:
                        return
                    raise ValueError(f"{f.name}: a record is cut short")
                yield (data,)


class KeyedReader(_Reader):
    """Key bounds are pushed down: reading stops behind the last key asked for."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.least, self.below, self.prefix = "", None, ""

    def pushFilters(self, filters: list) -> Iterator[Any]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                self.least, self.below = max(self.least, f.value), f.value + "\0" if self.below is None else min(self.below, f.value + "\0")
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("key",):
                self.least = max(self.least, f.value)
            elif isinstance(f, LessThan) and f.attribute == ("key",):
                self.below = f.value if self.below is None else min(self.below, f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",) and not self.prefix:
                self.prefix = f.value
            else:
                yield f

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            while (head := _exactly(f, 2, self.lenient)) is not None:
                key = _exactly(f, struct.unpack("<H", head)[0], self.lenient)
                size = _exactly(f, 4, self.lenient) if key is not None else None
                if size is None:
                    if self.lenient:
                        return
                    raise ValueError(f"{f.name}: a record is cut short")
                name, n = key.decode(), struct.unpack("<I", size)[0]
                if name < self.least or name < self.prefix:
                    f.seek(n, os.SEEK_CUR)
                    continue
                if (self.below is not None and name >= self.below) or (self.prefix and not name.startswith(self.prefix)):
                    return
                value = _exactly(f, n, self.lenient)
                if value is None:
                    return
                yield name, value


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool, keyed: bool) -> None:
        self.path, self.keyed = options["path"], keyed
        if overwrite and os.path.isdir(self.path):
            for f in _files(self.path):
                os.remove(f)

    def write(self, rows: Iterator[Any]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f".part-{uuid.uuid4().hex}")
        last = ""
        with open(name, "wb") as f:
            for row in rows:
                if self.keyed:
                    if row[0] < last:
                        raise ValueError("keys are out of order: sort within partitions first")
                    last, key = row[0], row[0].encode()
                    f.write(struct.pack("<H", len(key)) + key)
                value = bytes(row[-1])
                f.write(struct.pack("<I", len(value)) + value)
        return _Written(name)

    def commit(self, messages: list) -> None:
        for i, m in enumerate(messages):
            if m is not None:
                os.replace(m.name, os.path.join(self.path, f"part-{i:05d}-of-{len(messages):05d}-{uuid.uuid4().hex[:8]}"))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.name):
                os.remove(m.name)


class _Written(WriterCommitMessage):
    def __init__(self, name: str) -> None:
        self.name = name


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordio"

    def schema(self) -> str:
        return "value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite, keyed=False)


class KeyedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed"

    def schema(self) -> str:
        return "key string, value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return KeyedReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite, keyed=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
    spark.dataSource.register(KeyedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def crawl(spark: SparkSession, root: str, largest: int = 1_000_000) -> Any:
    """Files below a folder: filename, content (null where it isn't UTF-8 or is too long),
    is_binary, is_ugly. Hidden ones are left out."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    long = F.col("length") >= largest
    return files.where(~F.regexp_like("path", F.lit(r"/\.[^/]*"))).select(F.col("path").alias("filename"), F.when(~long, text).alias("content"), text.isNull().alias("is_binary"), long.alias("is_ugly"))
