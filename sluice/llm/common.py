"""Helpers of the corpus operators: shared tables, sizes, and functions over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where unset, a local one of a local session
    (tests); on a cluster that is an error, as each machine would write to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sluice-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, and lost executors can't lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """Size of the input by the planner's statistics, which cost nothing; counted where the planner has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 50:
        return size
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str | Column) -> Column:
    """crc32 of an id as text; a null id counts as an empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def schema_of(df: DataFrame, columns: Iterable[str], more: str) -> str:
    """DDL of some columns of df, and of more."""
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns), more])
