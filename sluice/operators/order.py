"""Sorting, top k, head, skip, and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.scalars import consistent_boolean
from sluice.session import written


def sort(df: DataFrame, *order_by: str | Column) -> DataFrame:
    """All rows in order, repeats kept; spills as it must."""
    return df.orderBy(*order_by)


def top_k(df: DataFrame, k: int, *order_by: Column) -> DataFrame:
    """The first k rows in the order: each task keeps its own k."""
    return df.orderBy(*order_by).limit(k)


def head(df: DataFrame, k: int, *order_by: str | Column) -> DataFrame:
    """The first k rows in the order; any k without one."""
    return (df.orderBy(*order_by) if order_by else df).limit(k)


def positioned(df: DataFrame, *order_by: str | Column) -> DataFrame:
    """df in order, as a written table with `_id`, which rises with the order, and `_part`, the range of the order a row is in.

    One sort by ranges, whose tasks each write their rows: nothing meets in one task. Numbers in `_id` have gaps.
    """
    ordered = df.orderBy(*order_by).withColumn("_id", F.monotonically_increasing_id())
    return written(ordered, "positioned").withColumn("_part", F.shiftright("_id", 33))


def skip(df: DataFrame, k: int, *order_by: str | Column) -> DataFrame:
    """All rows but the first k in the order, in that order. Counts by range tell where the k-th row is."""
    rows = positioned(df, *order_by)
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # one a task
    left, cut = k, None
    for part, n in counts:
        if left < n:
            cut = (part, left)
            break
        left -= n
    if cut is None:
        return df.limit(0)
    # Within a range numbers have no gaps.
    return rows.where(F.col("_id") >= (cut[0] << 33) + cut[1]).orderBy("_id").drop("_id", "_part")


def sample_share(df: DataFrame, share: float, seed: int | None = None) -> DataFrame:
    """Each row with this probability."""
    return df.sample(False, share, seed)


def sample_exact(df: DataFrame, m: int, seed: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """m rows, each set as likely as any other, without replacement; back in the order given. Each task keeps its own m."""
    rows = df.withColumn("_draw", F.rand(seed)).orderBy("_draw").limit(m).drop("_draw")
    return rows.orderBy(*order_by) if order_by else rows


def sample_consistent(df: DataFrame, key: str, probability: float) -> DataFrame:
    """Rows whose key's hash is below the probability: a key is always in, or always out."""
    return df.where(consistent_boolean(key, probability))


def sorted_distinct_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Distinct lines in the order of their bytes."""
    return df.select(column).distinct().orderBy(column)


def sample_lines(df: DataFrame, m: int, seed: int | None = None) -> DataFrame:
    """m lines, back in the order of their places: df has `value`, and `file_order` and `line` of read_text(positions=True)."""
    return sample_exact(df, m, seed, ["file_order", "line"])
