"""Dealing rows out to tasks: by key, by an explicit shard, and what a worker's shard is."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal(df: DataFrame, shards: int, *key: str | Column, shard: Column | None = None) -> DataFrame:
    """Rows of a key in one of `shards` partitions: by the key's hash, or that of the whole row without a key.

    shard: an expression that gives the number of the partition instead, from 0.
    """
    if shard is not None:
        number = F.when((shard >= 0) & (shard < shards), shard).otherwise(F.raise_error(F.lit(f"[VALIDATION] a shard is from 0 to below {shards}")))
        return df.repartitionById(shards, number.cast("int"))
    return df.repartition(shards, *(key or df.columns))


def with_shard(df: DataFrame, name: str = "shard") -> DataFrame:
    """df with the number of the partition that each row is in."""
    return df.withColumn(name, F.spark_partition_id())


def worker_shards(workers: Sequence[str]) -> Callable[[str], int]:
    """The shard of each worker by name, whatever the order in which the workers are named."""
    places = {w: i for i, w in enumerate(sorted(set(workers)))}
    return places.__getitem__
