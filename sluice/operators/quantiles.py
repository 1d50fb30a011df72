"""Exact nearest-rank percentiles, and quantile sketches that merge."""

from __future__ import annotations

import bisect
import math
import threading
from collections import deque
from collections.abc import Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sluice.operators.order import positioned


def percentile(df: DataFrame, value: str | Column, p: float, family: Sequence[str] = ()) -> DataFrame:
    """The value of rank max(1, round half up(p * n)) in rising order, exactly; null for an empty input (no row, by family). Nulls don't count.

    Equal values are counted before any ordering, so that only the histogram is ordered. Without families it is ordered by
    ranges, and counts by range tell in which one the rank is.
    """
    if not 0 <= p <= 1:
        raise ValueError("a percentile is between 0 and 1")
    value = F.col(value) if isinstance(value, str) else value
    counts = df.select(*family, value.alias("value")).where(F.col("value").isNotNull()).groupBy(*family, "value").agg(F.count(F.lit(1)).alias("n"))
    if not family:
        return _percentile_of_all(counts, p)
    whole = Window.partitionBy(*family)
    running = F.sum("n").over(whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*family, "value", running.alias("reach"), F.sum("n").over(whole).alias("total"))
    target = F.greatest(F.lit(1), F.floor(F.lit(float(p)) * F.col("total") + 0.5))
    return ranked.where(F.col("reach") >= target).groupBy(*family).agg(F.min("value").alias("percentile"))


def _percentile_of_all(counts: DataFrame, p: float) -> DataFrame:
    rows = positioned(counts, "value")
    parts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.sum("n").alias("n")).collect())  # one a task
    left = max(1, math.floor(p * sum(n for _, n in parts) + 0.5))
    for part, n in parts:
        if left <= n:
            break
        left -= n
    else:
        return counts.agg(F.min(F.col("value")).alias("percentile"))
    reach = F.sum("n").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.where(F.col("_part") == part).withColumn("reach", reach).where(F.col("reach") >= left).agg(F.min("value").alias("percentile"))


@runtime_checkable
class QuantileEstimator(Protocol):
    """What estimates quantiles of numbers added to it."""

    def add(self, value: float) -> None: ...
    def size(self) -> int: ...
    def quantile(self, q: float) -> float: ...
    def cdf(self, x: float) -> float: ...


class WindowEstimator:
    """A QuantileEstimator on the driver of the last `most` numbers, exactly; threads may share it."""

    def __init__(self, most: int = 10_000) -> None:
        self._kept: deque[float] = deque(maxlen=most)
        self._lock = threading.Lock()

    def add(self, value: float) -> None:
        with self._lock:
            self._kept.append(value)

    def size(self) -> int:
        return len(self._kept)

    def _sorted(self) -> list[float]:
        with self._lock:
            return sorted(self._kept)

    def quantile(self, q: float) -> float:
        values = self._sorted()
        return values[min(len(values) - 1, max(0, math.ceil(q * len(values)) - 1))] if values else math.nan

    def cdf(self, x: float) -> float:
        values = self._sorted()
        return bisect.bisect_right(values, x) / len(values) if values else math.nan


def sketch(df: DataFrame, value: str | Column, family: Sequence[str] = (), k: int = 200) -> DataFrame:
    """A KLL sketch of the values of each family, in `sketch`."""
    value = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*family).agg(F.kll_sketch_agg_double(value.cast("double"), F.lit(k)).alias("sketch"))


def weighted(df: DataFrame, weight: str) -> DataFrame:
    """Each row as often as its whole weight says; rows of weight 0 or null go."""
    return df.where(F.col(weight) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int")))).drop("_copy")


def merge(sketches: DataFrame, family: Sequence[str] = ()) -> DataFrame:
    """Sketches of each family as one."""
    return sketches.groupBy(*family).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(q: float) -> Column:
    """The q-quantile of the column `sketch`."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))


def cdf(x: float) -> Column:
    """The share of values not above x in the column `sketch`."""
    return F.kll_sketch_get_rank_double("sketch", F.lit(float(x)))
