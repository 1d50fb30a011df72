"""Keyed joins of a left input with any number of right inputs.

Record joins give one nested record for each key: key, left (array of rows) and right (map from the index of an input to the
array of its rows, without empty arrays). All inputs are tagged and united, so any number of them costs one shuffle. Flat
joins give rows, and leave the strategy to the planner; use them where a key may hold very many rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class JoinMode(Enum):
    """LEFT: keys of the left. INNER: of the left and any right. FULL_INNER: of the left and all rights. OUTER: all keys."""

    LEFT = "left"
    INNER = "inner"
    FULL_INNER = "full_inner"
    OUTER = "outer"

    def keeps(self, left: Column, rights: Column, n: int) -> Column:
        """left: whether there are left rows; rights: the number of inputs on the right that have rows."""
        return {
            JoinMode.LEFT: left,
            JoinMode.INNER: left & (rights > 0),
            JoinMode.FULL_INNER: left & (rights == n),
            JoinMode.OUTER: F.lit(True),
        }[self]


def _row(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def _not_null(key: Column) -> Column:
    return F.when(key.isNull(), F.raise_error(F.lit("[VALIDATION] null join key"))).otherwise(key)


def join_records(
    left: DataFrame | None, rights: Sequence[DataFrame], left_key: str | None, right_key: str | Sequence[str], mode: JoinMode = JoinMode.INNER, ordered: bool = False
) -> DataFrame:
    """key, left, right: the nested record of each key that the mode keeps. Without a left input, left is always empty and the
    mode OUTER. Null keys fail the flow. ordered: records by key. All rights have the same columns. Rows in a record are in
    the order of their values, which makes results repeatable."""
    keys = [right_key] * len(rights) if isinstance(right_key, str) else list(right_key)
    right_type = rights[0].select(_row(rights[0]).alias("r")).schema["r"].dataType.simpleString() if rights else "struct<none:int>"
    left_type = left.select(_row(left).alias("l")).schema["l"].dataType.simpleString() if left is not None else "struct<none:int>"
    parts = [df.select(_not_null(F.col(k)).alias("key"), F.lit(i).alias("tag"), F.lit(None).cast(left_type).alias("l"), _row(df).cast(right_type).alias("r")) for i, (df, k) in enumerate(zip(rights, keys))]
    if left is not None:
        parts.append(left.select(_not_null(F.col(left_key)).alias("key"), F.lit(-1).alias("tag"), _row(left).alias("l"), F.lit(None).cast(right_type).alias("r")))
    else:
        mode = JoinMode.OUTER
    tagged = reduce(DataFrame.unionByName, parts)
    lists = [F.array_sort(F.collect_list(F.when(F.col("tag") == i, F.col("r")))).alias(f"r{i}") for i in range(len(rights))]
    grouped = tagged.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("tag") == -1, F.col("l")))).alias("left"), *lists)
    entries = F.filter(F.array(*(F.struct(F.lit(i).alias("key"), F.col(f"r{i}").alias("value")) for i in range(len(rights)))), lambda e: F.size(e["value"]) > 0)
    out = grouped.select("key", "left", F.map_from_entries(entries).alias("right"))
    out = out.where(mode.keeps(F.size("left") > 0, F.size("right"), len(rights)))
    return out.orderBy("key") if ordered else out


def lookup_join(left: DataFrame | None, rights: Sequence[DataFrame], left_key: str | None, right_key: str | Sequence[str], mode: JoinMode = JoinMode.INNER) -> DataFrame:
    """key, left, right: one record for each left row, which holds one left row at most; OUTER adds the keys that only rights
    have. Null keys match null keys. The rights are grouped by key and joined to the left; Spark broadcasts the groups if
    they are small, else both sides are shuffled."""
    grouped = join_records_nullable(rights, right_key)
    if left is None:
        return grouped.select("key", F.array().cast("array<struct<none:int>>").alias("left"), "right")
    items = left.select(F.col(left_key).alias("key"), _row(left).alias("row"))
    other = grouped.withColumnRenamed("key", "right_key")
    joined = items.join(other, items["key"].eqNullSafe(other["right_key"]), "left")
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast(_value_type(grouped)))
    out = joined.select("key", F.array("row").alias("left"), F.coalesce("right", empty).alias("right"))
    out = out.where(mode.keeps(F.lit(True), F.size("right"), len(rights)))
    if mode is JoinMode.OUTER:
        keys = items.select(F.col("key").alias("left_key")).distinct()
        alone = grouped.join(keys, grouped["key"].eqNullSafe(keys["left_key"]), "left_anti")
        out = out.unionByName(alone.select("key", F.array().cast(out.schema["left"].dataType).alias("left"), "right"))
    return out


def join_records_nullable(rights: Sequence[DataFrame], right_key: str | Sequence[str]) -> DataFrame:
    """key, right: rows of all rights by key, null keys included."""
    keys = [right_key] * len(rights) if isinstance(right_key, str) else list(right_key)
    parts = [df.select(F.col(k).alias("key"), F.lit(i).alias("tag"), _row(df).alias("r")) for i, (df, k) in enumerate(zip(rights, keys))]
    lists = [F.array_sort(F.collect_list(F.when(F.col("tag") == i, F.col("r")))).alias(f"r{i}") for i in range(len(rights))]
    grouped = reduce(DataFrame.unionByName, parts).groupBy("key").agg(*lists)
    entries = F.filter(F.array(*(F.struct(F.lit(i).alias("key"), F.col(f"r{i}").alias("value")) for i in range(len(rights)))), lambda e: F.size(e["value"]) > 0)
    return grouped.select("key", F.map_from_entries(entries).alias("right"))


def _value_type(grouped: DataFrame) -> str:
    return f"array<{grouped.schema['right'].dataType.valueType.simpleString()}>"


def items_count() -> Column:
    """Rows in a record."""
    return F.size("left") + F.aggregate(F.transform(F.map_values("right"), F.size), F.lit(0), lambda a, b: a + b)


def single_left() -> Column:
    """The first left row of a record, or null."""
    return F.get("left", 0)


def single_right(index: int) -> Column:
    """The first row that the right input of this index has in a record, or null."""
    return F.get(F.element_at("right", F.lit(index)), 0)


def flat_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Rows of a two-input join: inner, left, outer, left_semi or left_anti. Spark broadcasts a side that is small, and splits
    frequent keys at run time."""
    return left.join(right, left[left_key] == right[right_key], how)


def flat_records(records: DataFrame, index: int = 0, outer: bool = False) -> DataFrame:
    """key, left, right: a row for each pair of a left row and a row of one right input in the records."""
    explode = F.explode_outer if outer else F.explode
    pairs = records.select("key", explode("left").alias("left"), F.element_at("right", F.lit(index)).alias("rights"))
    return pairs.select("key", "left", explode("rights").alias("right"))
