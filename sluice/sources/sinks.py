"""Sinks: collections, text, CSV, shards, queues, binary codecs, a database in a file."""

from __future__ import annotations

import queue
import shutil
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import TextIO

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sluice.functions import avro, coding
from sluice.functions.scalars import shard_of
from sluice.functions.scheduling import in_parallel
from sluice.sources.files import Storage
from sluice.sources.readers import END


def to_list(df: DataFrame) -> list:
    return df.collect()


def to_map(df: DataFrame, key: str, value: str, order_by: str | None = None) -> dict:
    """Value of each key; of several, that of the last row by `order_by`, or without it the greatest, so that the answer repeats."""
    last = F.max_by(value, order_by) if order_by else F.max(value)
    return {r[0]: r[1] for r in df.groupBy(key).agg(last).collect()}


def consume(df: DataFrame, finish: Callable[[], None] | None = None) -> None:
    """Computes every row and drops it."""
    df.write.format("noop").mode("overwrite").save()
    if finish is not None:
        finish()


def consume_all(frames: Sequence[DataFrame], threads: int = 4, finish: Callable[[], None] | None = None) -> None:
    """Computes several frames at a time."""
    in_parallel(frames, consume, threads)
    if finish is not None:
        finish()


def write_text(df: DataFrame, path: str, column: str = "value", compression: str = "none", mode: str = "errorifexists") -> None:
    """Lines to a folder of text files: none, gzip, bzip2 or deflate."""
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).option("compression", compression).text(path)


def to_writer(df: DataFrame, target: TextIO, column: str = "value", order_by: Sequence[str] = ()) -> int:
    """Lines to an open text file or the like, a partition in memory at a time; returns their number."""
    n = 0
    for row in (df.orderBy(*order_by) if order_by else df).select(F.col(column).cast("string")).toLocalIterator(prefetchPartitions=True):
        target.write(("" if row[0] is None else row[0]) + "\n")
        n += 1
    target.flush()
    return n


def write_json_lines(df: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    """A JSON object a line; nulls are written too."""
    df.write.mode(mode).option("compression", compression).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, separator: str = ",", header: bool = False, compression: str = "none", mode: str = "errorifexists") -> None:
    """CSV that keeps blanks, and null (nothing) apart from "" (quoted)."""
    options = {"sep": separator, "header": str(header).lower(), "compression": compression, "escape": "\"", "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode(mode).options(**options).csv(path)


def write_shards(df: DataFrame, path: str, shard: str | Column, format: str = "parquet", order_by: Sequence[str] = (), compression: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """A folder for each value of `shard`; returns shard and rows, read from what was written.

    order_by: rows of a shard are in this order in each file. A shard's rows aren't gathered in one task, so that a frequent
    value has several files.
    """
    out = df.withColumn("shard", F.col(shard) if isinstance(shard, str) else shard)
    if order_by:
        out = out.sortWithinPartitions("shard", *order_by)
    writer = out.write.mode(mode).partitionBy("shard")
    (writer.option("compression", compression) if compression else writer).format(format).save(path)
    kept = df.sparkSession.read.schema(out.schema).format(format).load(path)
    return kept.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


def write_hash_shards(df: DataFrame, path: str, key: str, shards: int, **options) -> DataFrame:
    """write_shards by the hash of a key."""
    return write_shards(df, path, shard_of(key, shards), **options)


def write_sequence_shards(df: DataFrame, path: str, shard: str, order_by: Sequence[str] = (), **options) -> DataFrame:
    """write_shards with each shard's rows gathered first, so that each has few files."""
    return write_shards(df.repartition(shard), path, shard, order_by=order_by, **options)


def to_queue(df: DataFrame, target: queue.Queue) -> int:
    """Rows to a queue, a partition in memory at a time; then END, or the exception that stopped them."""
    n = 0
    try:
        for row in df.toLocalIterator(prefetchPartitions=True):
            target.put(row)
            n += 1
    except Exception as e:
        target.put(e)
        raise
    target.put(END)
    return n


def to_queues(df: DataFrame, targets: Sequence[queue.Queue], key: str | None = None) -> list[int]:
    """Rows to one of several queues by the hash of a key (or of the row); END to all. Returns the rows of each."""
    dealt = df.withColumn("_shard", shard_of(key, len(targets)) if key else F.pmod(F.xxhash64(*df.columns), F.lit(len(targets))).cast("int"))
    counts = [0] * len(targets)
    try:
        for row in dealt.toLocalIterator(prefetchPartitions=True):
            targets[row["_shard"]].put(Row(**{c: row[c] for c in df.columns}))
            counts[row["_shard"]] += 1
    except Exception as e:
        for t in targets:
            t.put(e)
        raise
    for t in targets:
        t.put(END)
    return counts


def write_encoded(df: DataFrame, path: str, encode: Callable[[pd.DataFrame], bytes], name: str = "part") -> int:
    """A file of encoded rows for each batch of rows, written through Spark's file system from here; returns the files.

    encode runs on the executors; a batch's bytes are here one at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"data": [encode(frame)]})

    storage, n = Storage(df.sparkSession), 0
    for row in df.mapInPandas(run, "data binary").toLocalIterator():
        storage.put(f"{path.rstrip('/')}/{name}-{n:05d}.bin", bytes(row.data))
        n += 1
    return n


def write_integers(df: DataFrame, path: str, column: str, kind: str = "int32_le") -> int:
    return write_encoded(df.select(column), path, lambda f: coding.encode_integers(f[column], kind))


def write_delimited(df: DataFrame, path: str, column: str) -> int:
    """Messages with their lengths as varints before them."""
    return write_encoded(df.select(column), path, lambda f: coding.delimited(bytes(v) for v in f[column]))


def write_avro_data(df: DataFrame, path: str, record: dict) -> int:
    """Bare Avro data of the rows, by the Avro schema of a record with the columns in order."""
    return write_encoded(df, path, lambda f: avro.encode_stream(record, _plain(f)))


def write_avro(df: DataFrame, path: str, record: dict, codec: str = "deflate") -> int:
    """Avro container files of the rows."""
    return write_encoded(df, path, lambda f: avro.encode_container(record, _plain(f), codec))


#: Derby's types of the columns that write_derby takes.
DERBY_TYPES = {"smallint": "smallint", "int": "integer", "bigint": "bigint", "double": "double"}


def write_derby(df: DataFrame, path: str, name: str) -> str:
    """Numeric columns as a table of an embedded Derby database in a file, which any number of processes read; returns its URL.

    path: a new folder that the driver and all executors see as a local one. Only one process can write to the database: the
    executors write lines, and the driver loads them a file at a time. Derby's doubles have no NaN or infinity; those fail.
    """
    if unfit := [c for c, kind in df.dtypes if kind not in DERBY_TYPES]:
        raise ValueError(f"columns {unfit} aren't of types {list(DERBY_TYPES)}")
    write_csv(df.select("*", F.lit(1)), f"{path}/rows")  # so that no row is an empty line, which would be passed over
    lines = Path(Storage(df.sparkSession).local(f"{path}/rows"))
    built, packed = lines.parent / "db", lines.parent / "db.jar"
    url, quoted = f"jdbc:derby:directory:{built}", "\"" + name.replace("\"", "\"\"") + "\""
    connect = df.sparkSession._jvm.java.sql.DriverManager.getConnection
    connection = connect(f"{url};create=true")
    try:
        statement = connection.createStatement()
        columns = ", ".join("\"" + c.replace("\"", "\"\"") + f"\" {DERBY_TYPES[kind]}" for c, kind in df.dtypes)
        statement.execute(f"create table {quoted} ({columns})")
        load = connection.prepareCall("call SYSCS_UTIL.SYSCS_IMPORT_DATA(null, ?, null, ?, ?, null, null, 'UTF-8', 0)")
        for part in sorted(lines.glob("part-*")):
            if part.stat().st_size:
                load.setString(1, name)
                load.setString(2, ",".join(str(i + 1) for i in range(len(df.columns))))
                load.setString(3, str(part))
                load.execute()
                part.unlink()
    finally:
        connection.close()
        try:
            connect(f"{url};shutdown=true")
        except Py4JJavaError as e:  # a database that has shut down says so by an error
            if e.java_exception.getSQLState() != "08006":
                raise
    shutil.rmtree(lines)
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_STORED) as z:  # stored, so that pages are found without reading all before them
        for p in sorted(built.rglob("*")):
            z.write(p, p.relative_to(built.parent))
    shutil.rmtree(built)
    return f"jdbc:derby:jar:({packed})db"


def _plain(frame: pd.DataFrame) -> Iterator[tuple]:
    """Rows with Python's own types; what pandas holds as missing is None."""
    for row in zip(*(frame[c].astype(object).where(frame[c].notna(), None) for c in frame.columns)):
        yield tuple(v.item() if hasattr(v, "item") else v for v in row)


def identical(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
