"""Sliding windows over event time, of tables or streams: averages, rates, quantiles, last values; unbounded flows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def _marked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if late and events.isStreaming else events


def _edges(out: DataFrame) -> DataFrame:
    return out.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def sliding(table: DataFrame, ts: str, length: str, slot: str, by: Sequence[str] = (), late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates of every window of `length` that begins at a multiple of `slot`. late: how long a stream waits for events."""
    grouped = _marked(table, ts, late).groupBy(F.window(ts, length, slot), *by)
    return _edges(grouped.agg(*(a.alias(k) for k, a in aggregates.items())))


def sliding_average(events: DataFrame, ts: str, value: str | Column, length: str, slot: str, by: Sequence[str] = (), late: str | None = None) -> DataFrame:
    """events and average of each window; sums are decimal, so that results don't depend on the order."""
    value = F.col(value) if isinstance(value, str) else value
    total = F.sum(value.cast("decimal(18,2)")).cast("double")
    return sliding(events, ts, length, slot, by, late, events=F.count(value), average=F.round(total / F.count(value), 6))


def sliding_rate(events: DataFrame, ts: str, length: str, slot: str, units: float, by: Sequence[str] = (), late: str | None = None) -> DataFrame:
    """events, and events a time unit, of each window of `units` units."""
    return sliding(events, ts, length, slot, by, late, events=F.count(F.lit(1)), rate=F.round(F.count(F.lit(1)) / units, 6))


def sliding_quantiles(events: DataFrame, ts: str, value: str, slot: str, slots: int, q: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Approximate quantiles of the slot of each row and the `slots` - 1 before it, from one sketch a slot that merges.

    Only slots with events are listed; what they look back on is by time.
    """
    table = events.groupBy(F.window(ts, slot), *by).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"))
    start = F.unix_timestamp(F.col("window.start").cast("timestamp"))
    step = F.unix_timestamp(F.col("window.end").cast("timestamp")) - start
    table = table.withColumn("_slot", (start / step).cast("long"))
    back = Window.partitionBy(*by).orderBy("_slot").rangeBetween(1 - slots, 0)
    merged = table.withColumn("merged", F.kll_merge_agg_double("sketch").over(back))
    named = {f"q{int(round(x * 100))}": F.kll_sketch_get_quantile_double("merged", F.lit(float(x))) for x in q}
    return _edges(merged.withColumns(named)).drop("sketch", "merged", "_slot")


def last_values(events: DataFrame, ts: str, k: int, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """The k latest rows of the table, or of each group."""
    order = [F.desc(ts), *(F.desc(t) for t in tie)]
    if not by:
        return events.orderBy(*order).limit(k)
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def last_values_stream(events: DataFrame, key: str, ts: str, value: str, k: int) -> DataFrame:
    """key, values: the k latest values of each key that a batch of the stream touched, kept in the stream's state."""
    types = {c: events.schema[c].dataType.simpleString() for c in (key, value)}

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, values = state.get if state.exists else ([], [])
        pairs = list(zip(times, values))
        for frame in frames:
            pairs += list(zip(frame[ts].astype("int64").tolist(), frame[value].tolist()))
            pairs = sorted(pairs, key=lambda p: p[0])[-k:]
        state.update(([p[0] for p in pairs], [p[1] for p in pairs]))
        yield pd.DataFrame({key: [keys[0]], "values": [[p[1] for p in pairs]]})

    out, kept = f"{key} {types[key]}, values array<{types[value]}>", f"times array<long>, values array<{types[value]}>"
    return events.select(key, ts, value).groupBy(key).applyInPandasWithState(update, out, kept, "update", "NoTimeout")


def stream_of(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_a_batch: int | None = None) -> DataFrame:
    """An unbounded table of the files that come into a folder."""
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).load(path)


def unbounded(spark: SparkSession, item: Callable[[Column], Column], rows_a_second: int = 100, name: str = "item") -> DataFrame:
    """item(i) for i from 0 on, as a stream."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_a_second).load().select(item(F.col("value")).alias(name), "timestamp")


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Starts a flow that gives each batch to an action, with its number; goes on from the checkpoint after a stop."""
    writer = stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
