"""Reductions by family and by runs, distinct, grouping, counts and statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

from sluice.operators import order


def reduce_by(df: DataFrame, family: Sequence[str | Column], **aggregates: Column) -> DataFrame:
    """One row for each family. Aggregates are summed up in parts before the shuffle. Null families are one family."""
    return df.groupBy(*family).agg(*(a.alias(k) for k, a in aggregates.items()))


def reduce_opaque(df: DataFrame, family: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One call of a Python function for each family, whose rows meet in one task."""
    return df.groupBy(*family).applyInPandas(function, schema)


def fold(df: DataFrame, family: Sequence[str], value: str, order_by: Sequence[str], start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, name: str = "result") -> DataFrame:
    """A fold of each family's values in order, by expressions: create, accumulate, finish."""
    listed = F.array_sort(F.collect_list(F.struct(*order_by, F.col(value).alias("_value"))))
    grouped = df.groupBy(*family).agg(F.transform(listed, lambda s: s["_value"]).alias("_values"))
    return grouped.select(*family, F.aggregate("_values", start, step, finish).alias(name))


def run_ids(df: DataFrame, family: str | Column, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str = "run") -> DataFrame:
    """df with the number of the run of equal families that each row is in.

    Without `partition_by` the rows are sorted by ranges. Each range counts its own runs, and takes over from the range
    before how many runs there were, and its last family: one row a range.
    """
    family = F.col(family) if isinstance(family, str) else family
    if partition_by:
        return _numbered(df, family, Window.partitionBy(*partition_by).orderBy(*order_by), name)
    rows = _numbered(order.positioned(df.withColumn("_f", F.struct(family.alias("f"))), *order_by), F.col("_f.f"), Window.partitionBy("_part").orderBy("_id"), "_own")
    ends = rows.groupBy("_part").agg(F.min_by("_f", "_id").alias("first"), F.max_by("_f", "_id").alias("last"), F.max("_own").alias("n")).collect()
    before, at, last = [], 0, None
    for r in sorted(ends, key=lambda r: r["_part"]):
        at -= last is not None and last == r["first"]  # the run goes on
        before.append((r["_part"], at))
        at, last = at + r["n"], r["last"]
    table = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return rows.join(F.broadcast(table), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_id", "_part", "_f", "_own", "_before")


def _numbered(df: DataFrame, family: Column, order_: WindowSpec, name: str) -> DataFrame:
    last = F.lag(F.struct(family.alias("f"))).over(order_)
    new = F.when(last.isNull() | ~last["f"].eqNullSafe(family), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(order_.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def reduce_runs(df: DataFrame, family: str, order_by: Sequence[str], partition_by: Sequence[str] = (), **aggregates: Column) -> DataFrame:
    """One row for each run of consecutive equal families; a family may have several runs."""
    runs = run_ids(df, family, order_by, partition_by)
    return runs.groupBy(*partition_by, "run", family).agg(*(a.alias(k) for k, a in aggregates.items()))


def collect_runs(df: DataFrame, family: str, value: str, order_by: Sequence[str], limit: int | None = None, fail: bool = False, partition_by: Sequence[str] = (), name: str = "items") -> DataFrame:
    """The values of each run in order. limit: a longer run is cut there, or with `fail` fails the flow."""
    runs = run_ids(df, family, order_by, partition_by)
    if limit is not None:
        place = F.row_number().over(Window.partitionBy(*partition_by, "run").orderBy(*order_by))
        runs = runs.withColumn("_place", place)
        if fail:
            runs = runs.withColumn(value, F.when(F.col("_place") > limit, F.raise_error(F.lit(f"[EXCESSIVE] a run has more than {limit} items"))).otherwise(F.col(value)))
        else:
            runs = runs.where(F.col("_place") <= limit)
    listed = F.array_sort(F.collect_list(F.struct(*order_by, F.col(value).alias("_value"))))
    return runs.groupBy(*partition_by, "run", family).agg(F.transform(listed, lambda s: s["_value"]).alias(name))


def distinct(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or one row for each value of some columns."""
    return df.distinct() if columns is None else df.dropDuplicates(list(columns))


def group_contiguous(df: DataFrame, family: Sequence[str], order_by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Rows of a family stand together in one partition, in the order given."""
    out = df.repartition(partitions, *family) if partitions else df.repartition(*family)
    return out.sortWithinPartitions(*family, *order_by)


def count(df: DataFrame, name: str = "count") -> DataFrame:
    """One row with the number of rows; 0 for none."""
    return df.agg(F.count(F.lit(1)).alias(name))


def action_stats(df: DataFrame, category: str, start: str, end: str, now: Column) -> DataFrame:
    """Of each category: actions that run (begun, but not ended by `now`), that are completed, and the total and average
    seconds of those. start, end: timestamps; a null end hasn't come yet."""
    done = F.col(end).isNotNull() & (F.col(end) <= now)
    took = F.when(done, F.unix_micros(end) - F.unix_micros(start))
    open_ = F.when((F.col(start) <= now) & ~done, 1).otherwise(0)
    total = F.coalesce(F.sum(took), F.lit(0)) / 1e6
    completed = F.count(took)
    return df.groupBy(category).agg(F.sum(open_).alias("running"), completed.alias("completed"), total.alias("total"), F.when(completed > 0, total / completed).alias("average"))


def event_counts(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    """Events of each category, and of a duration the sum and mean."""
    more = [F.sum(value).alias("total"), F.avg(value).alias("mean")] if value else []
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("events"), *more)
