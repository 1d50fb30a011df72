"""Row-wise operators: map, flat map, filter, text lines to columns, metrics, order validation, progress, tees."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from sluice.operators.order import positioned
from sluice.session import written


def map_rows(df: DataFrame, *columns: Column | str) -> DataFrame:
    """One row for each row, by column expressions."""
    return df.select(*columns)


def map_opaque(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One row, or any number, for each row, by a Python function of pandas frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield function(frame)

    return df.mapInPandas(run, schema)


def flat_map(df: DataFrame, items: Column, name: str = "item", position: str | None = None) -> DataFrame:
    """A row for each element of an array expression; rows whose array is empty or null give none."""
    if position is None:
        return df.withColumn(name, F.explode(items))
    return df.select("*", F.posexplode(items).alias(position, name))


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true."""
    return df.where(condition)


def parse_csv(df: DataFrame, line: str, schema: str, separator: str = ",", strict: bool = True, trim: bool = True) -> DataFrame:
    """Lines in a flow to columns. Values are trimmed; strict: a line that doesn't fit the schema fails the flow."""
    options = {"sep": separator, "mode": "FAILFAST" if strict else "PERMISSIVE"}
    options |= {k: str(trim).lower() for k in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace")}
    parsed = df.withColumn("_csv", F.from_csv(line, schema, options))
    return parsed.select(*(c for c in df.columns if c != line), "_csv.*")


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and metrics of its rows that are there after the first action on it."""
    seen = Observation()
    return df.observe(seen, *(m.alias(k) for k, m in metrics.items())), seen


def for_each(df: DataFrame, action: Callable, finish: Callable[[], None] | None = None) -> None:
    """Runs an action on each row, on the executors; then `finish` once, here."""
    df.foreach(action)
    if finish is not None:
        finish()


def validate_order(df: DataFrame, order_by: Sequence[str], position: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """df; its use fails if a row's keys are below those of the row before it, by `position`.

    Without `partition_by` the rows are sorted by ranges of `position`. Each range checks itself, and its first row against
    the last of the range before: one row a range.
    """
    now = F.struct(*order_by)
    if partition_by:
        return _checked(df, F.lag(now).over(Window.partitionBy(*partition_by).orderBy(position)) > now)
    rows = positioned(df, position)
    ends = rows.groupBy("_part").agg(F.max_by(now, "_id").alias("last")).orderBy("_part").collect()  # one a task
    following = [(b["_part"], a["last"]) for a, b in zip(ends, ends[1:])]
    table = df.sparkSession.createDataFrame(following, df.sparkSession.createDataFrame([], "_part long").join(df.select(now.alias("_last")).limit(0)).schema)
    last = F.coalesce(F.lag(now).over(Window.partitionBy("_part").orderBy("_id")), F.col("_last"))
    return _checked(rows.join(F.broadcast(table), "_part", "left"), last > now).drop("_id", "_part", "_last")


def _checked(df: DataFrame, wrong: Column) -> DataFrame:
    out = df.withColumn("_order", F.when(wrong, F.raise_error(F.lit("[OUT_OF_ORDER] rows aren't in order"))).otherwise(F.lit(True).cast("boolean")))
    return out.where(F.coalesce(F.col("_order").cast("boolean"), F.lit(True))).drop("_order")


def chained(df: DataFrame, *steps: Callable[[DataFrame], object]) -> object:
    """What the last of the steps makes of what those before made of df: a compound operator, or with a sink at its end a
    compound sink."""
    for step in steps:
        df = step(df)
    return df


def tee(df: DataFrame, write: Callable[[DataFrame], object]) -> DataFrame:
    """Writes df and passes it on; it is computed once, and kept as a table in the shared folder."""
    kept = written(df, "tee")
    write(kept)
    return kept


class ProgressSteps:
    """Turns reports between 0 and 1 into whole steps of a range, each reported once, in rising order."""

    def __init__(self, report: Callable[[int], None], first: int = 0, last: int = 100, step: int = 1) -> None:
        self.report, self.first, self.last, self.step, self.sent = report, first, last, step, None

    def __call__(self, share: float) -> None:
        value = self.first + int((self.last - self.first) * min(max(share, 0.0), 1.0)) // self.step * self.step
        value = self.last if share >= 1 else value
        if self.sent is None or value > self.sent:
            self.sent = value
            self.report(value)


def with_progress(df: DataFrame, action: Callable[[DataFrame], object], report: Callable[[int], None], every: float = 0.2) -> object:
    """Runs an action on df and reports the share of tasks done in percent: 0 first, 100 last, rising in between."""
    sc = df.sparkSession.sparkContext
    group, steps, done = f"progress-{id(df)}", ProgressSteps(report), threading.Event()
    steps(0.0)

    def watch() -> None:
        tracker = sc.statusTracker()
        while not done.wait(every):
            stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in (getattr(tracker.getJobInfo(j), "stageIds", None) or [])]
            total = sum(s.numTasks for s in stages if s)
            if total:
                steps(min(0.99, sum(s.numCompletedTasks for s in stages if s) / total))

    thread = threading.Thread(target=watch, daemon=True)
    sc.setJobGroup(group, "progress")
    thread.start()
    try:
        return action(df)
    finally:
        done.set()
        thread.join()
        sc.setLocalProperty("spark.jobGroup.id", None)
        steps(1.0)


def least(shares: Sequence[float]) -> float:
    """The progress of a flow that is done when all its inputs are: 1 without inputs."""
    return min(shares, default=1.0)


def most(shares: Sequence[float]) -> float:
    """The progress of a flow that is done when any input is."""
    return max(shares, default=1.0)


def average(shares: Sequence[float]) -> float:
    """The progress of a flow that reads its inputs one after the other."""
    return sum(shares) / len(shares) if shares else 1.0
