"""Tables in the folder that all executors share: what iterations and stages write and read back.

Written tables cut lineage, so a lost executor costs its tasks alone. They are dropped as soon as
what was made from them is written itself (`settled`), else when the driver ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a temporary one will do on a master
    of one process; a cluster has to name one, since its executors share no local folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _LIVE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a scan can't be split that far (a file of one row group), for work
    that costs more than a shuffle of its rows; a table of enough splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """build() as a written table; all tables that were written on the way to it are dropped."""
    before = set(_LIVE)
    out = written(build())
    made = [p for p in _LIVE if p not in before]
    drop(out.sparkSession, made[:-1])
    return out


def drop(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _LIVE.remove(p)


def drop_table(df: DataFrame) -> None:
    """Drops the written table that df reads, if it is one."""
    for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop(df.sparkSession, [x for x in _LIVE if x.rsplit("/", 1)[-1] == p.rsplit("/", 1)[-1]])


@atexit.register
def _leave_nothing() -> None:
    """At the driver's end the session may be gone: what lies on a mounted path goes."""
    for p in _LIVE:
        shutil.rmtree(p.removeprefix("file:"), ignore_errors=True)
