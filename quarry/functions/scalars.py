"""Time, number and JSON functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_directory(seconds: Column) -> Column:
    """Epoch seconds as yyyy/MM/dd, in a session whose zone is UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy/MM/dd")


def duration_text(micros: Column) -> Column:
    """A duration in its largest whole unit."""
    s = micros / 1_000_000
    out = F.concat(F.floor(micros / 1000).cast("string"), F.lit(" ms"))
    for unit, size in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400)):
        n = F.floor(s / size)
        out = F.when(s >= size, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise(""))).otherwise(out)
    return out


def ttl_seconds(spec: Column) -> Column:
    """Seconds of `ttl=<n>` and a unit of s, m, h or d; null for anything else."""
    n = F.regexp_extract(spec, r"^ttl=(\d+)([smhd])$", 1).try_cast("long")
    unit = F.regexp_extract(spec, r"^ttl=(\d+)([smhd])$", 2)
    return n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)


def log2_or(x: Column, none: float = 0.0) -> Column:
    """log2, with a value of its own for what has no logarithm."""
    return F.when(x > 0, F.log2(x)).otherwise(F.lit(none))


def or_else(a: Column, b: Column) -> Column:
    """a unless it is null, empty, 0 or false (texts are compared as texts)."""
    return F.when(a.isNull() | a.cast("string").isin("", "0", "0.0", "false"), b).otherwise(a)


def newest_first_id(n: Column) -> Column:
    """Ids as texts whose order is newest first."""
    return F.lpad(F.hex(F.bitwise_not(n)), 16, "0")


def next_token(x: Column) -> Column:
    """A step of xorshift (13, 7, 17) on 64 bits."""
    a = x.bitwiseXOR(F.shiftleft(x, 13))
    b = a.bitwiseXOR(F.shiftrightunsigned(a, 7))
    return b.bitwiseXOR(F.shiftleft(b, 17))


def json_pairs(at: str, value: str) -> Column:
    """An aggregate: [[at, value], ...] in order, as JSON."""
    return F.to_json(F.sort_array(F.collect_list(F.array(F.col(at).cast("double"), F.col(value).cast("double")))))
