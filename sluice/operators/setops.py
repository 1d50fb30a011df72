"""Distinct set operations, merges and concatenation of inputs with equal columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def union(inputs: Sequence[DataFrame], ordered: bool = False) -> DataFrame:
    """Distinct rows of any input."""
    out = reduce(DataFrame.unionByName, inputs).distinct()
    return out.orderBy(*out.columns) if ordered else out


def intersect(inputs: Sequence[DataFrame], ordered: bool = False, spark: SparkSession | None = None, schema: str | None = None) -> DataFrame:
    """Distinct rows that every input has; of no inputs, none."""
    if not inputs:
        return _empty(spark, schema)
    out = reduce(lambda a, b: a.intersect(b.select(*a.columns)), inputs[1:], inputs[0].distinct())
    return out.orderBy(*out.columns) if ordered else out


def subtract(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """Distinct rows of the left that the right doesn't have."""
    out = left.subtract(right.select(*left.columns))
    return out.orderBy(*out.columns) if ordered else out


def by_membership(inputs: Sequence[DataFrame], keep: Callable[[Column], Column]) -> DataFrame:
    """Distinct rows for which `keep` holds of the array of indices of the inputs that have them, in one shuffle."""
    columns = inputs[0].columns
    tagged = reduce(DataFrame.unionByName, (df.withColumn("_tag", F.lit(i)) for i, df in enumerate(inputs)))
    grouped = tagged.groupBy(*columns).agg(F.array_sort(F.collect_set("_tag")).alias("_tags"))
    return grouped.where(keep(F.col("_tags"))).select(*columns)


def merge(inputs: Sequence[DataFrame], *order_by: str | Column) -> DataFrame:
    """All rows of all inputs in order, repeats kept."""
    return reduce(DataFrame.unionByName, inputs).orderBy(*order_by)


def concat(inputs: Sequence[DataFrame], position: str | None = None, ordered: bool = True) -> DataFrame:
    """The rows of the inputs one after another: `input` tells which; by `position` inside, if named."""
    out = reduce(DataFrame.unionByName, (df.withColumn("input", F.lit(i)) for i, df in enumerate(inputs)))
    return out.orderBy("input", *([position] if position else [])) if ordered else out


def union_all(inputs: Sequence[DataFrame]) -> DataFrame:
    """All rows of all inputs, in no order."""
    return reduce(DataFrame.unionByName, inputs)
