"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def union_probability(probabilities: Column) -> Column:
    """Probability that any of independent events happens; 0 for none."""
    return 1 - F.aggregate(probabilities, F.lit(1.0), lambda a, p: a * (1 - p))


def shard_of(key: str | Column, shards: int) -> Column:
    """Shard of a key, from 0, by a 64-bit hash."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def consistent_boolean(key: str | Column, probability: float) -> Column:
    """The same answer for a key each time; true for about this share of keys."""
    return fast_random(key) < probability


def uuid_range_shard(uuid: str | Column, shards: int) -> Column:
    """Shard of a UUID (either case) by equal ranges of its first 32 bits, so that shards follow the order of UUIDs."""
    head = F.conv(F.substring(F.regexp_replace(F.lower(uuid), "-", ""), 1, 8), 16, 10).cast("long")
    return F.floor(head * shards / F.lit(1 << 32)).cast("int")


def java_string_hash(text: str | Column) -> Column:
    """The 32-bit hash s[0] * 31 ** (n - 1) + ... of a text within the basic plane."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32)))
    return F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped).cast("int")


def bucket_path(scheme: str, bucket: str | Column, key: str | Column) -> Column:
    """scheme://bucket/key."""
    return F.concat(F.lit(f"{scheme}://"), bucket, F.lit("/"), F.regexp_replace(key, "^/+", ""))


def path_parts(path: str | Column) -> Column:
    """struct(scheme, bucket, key) of a path."""
    part = lambda i: F.regexp_extract(path, r"^([^:/]+)://([^/]+)/?(.*)$", i)
    return F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("key"))


def fast_random(key: str | Column, seed: int = 0) -> Column:
    """A number from 0 to below 1 for each key, the same each time for a seed, without any state."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
