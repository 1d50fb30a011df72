"""Sources: rows at hand, generated rows, text, CSV dialects, binary codecs, databases, URLs."""

from __future__ import annotations

import gzip
import itertools
import queue
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from sluice.errors import HttpFlowError, QueueFlowError, ValidationError
from sluice.functions import avro, coding
from sluice.session import shared_path
from sluice.sources.files import FileSelection

END = object()  # closes a queue


def from_rows(spark: SparkSession, rows: Iterable, schema: str, at_once: int = 100_000) -> DataFrame:
    """Rows at hand, or of an iterator. Of an iterator of more than `at_once` rows, so many at a time go to a table in the
    shared folder."""
    rows = iter(rows)
    part = list(itertools.islice(rows, at_once))
    df = spark.createDataFrame(part, schema)
    if len(part) < at_once:
        return df
    path = shared_path(spark, "rows")
    while part:
        df.write.mode("append").parquet(path)
        part = list(itertools.islice(rows, at_once))
        df = spark.createDataFrame(part, schema)
    return spark.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def failing(spark: SparkSession, message: str) -> DataFrame:
    """Fails when it is read."""
    return spark.range(1).select(F.raise_error(F.lit(f"[FLOW] {message}")).cast("string").alias("value"))


def generated(spark: SparkSession, count: int, item: Callable[[Column], Column], name: str = "item", partitions: int | None = None) -> DataFrame:
    """item(i) for i from 0 to below count."""
    return spark.range(0, count, 1, partitions).select(item(F.col("id")).alias(name))


def from_queue(spark: SparkSession, source: queue.Queue, schema: str, timeout: float | None = None) -> DataFrame:
    """Rows of a queue up to END; an exception in it fails the flow."""
    rows = []
    while (item := source.get(timeout=timeout)) is not END:
        if isinstance(item, Exception):
            raise QueueFlowError(str(item)) from item
        rows.append(item)
    return spark.createDataFrame(rows, schema)


def _paths(spark: SparkSession, source: str | Sequence[str] | FileSelection) -> list[str]:
    if isinstance(source, FileSelection):
        return [f.path for f in source.files(spark)]
    return [source] if isinstance(source, str) else list(source)


def read_text(spark: SparkSession, source: str | Sequence[str] | FileSelection, charset: str = "UTF-8", positions: bool = False) -> DataFrame:
    """Lines of files, in `value`; compressed by their extension (gz, bz2, zst, ...). positions: also the file, its place in
    the order of the selection, and the line's place, which rises within each file."""
    paths = _paths(spark, source)
    if not paths:
        return empty(spark, "value string" + ", file string, file_order int, line long" * positions)
    reader = spark.read
    if charset.upper() not in ("UTF-8", "UTF8"):
        # Text is read as UTF-8; for other charsets a one-column CSV without quotes decodes lines.
        options = {"encoding": charset, "sep": "\u0001", "quote": "", "escape": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "false", "nullValue": "\u0002", "emptyValue": ""}
        lines = reader.schema("value string").options(**options).csv(paths)
    else:
        lines = reader.text(paths)
    if not positions:
        return lines
    ranks = spark.createDataFrame(list(enumerate(paths)), "file_order int, _path string")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    lines = lines.join(F.broadcast(ranks), F.col("file") == F.col("_path"), "left")
    return lines.select("value", "file", F.coalesce("file_order", F.lit(0)).alias("file_order"), "line")


# The three dialects: "trimmed" trims every value; "exact" keeps blanks, and parts an unquoted empty value (null) from a quoted
# one (""); "literal" takes the word null as null. Only in "exact" is an unquoted empty text null.
DIALECTS = ("trimmed", "exact", "literal")
#: A value that no file holds, so that only unquoted empty values are null.
_NOTHING = "\u0001"


def read_csv(spark: SparkSession, source: str | Sequence[str] | FileSelection, schema: str, dialect: str = "trimmed", separator: str = ",", header: bool = False, skip: int = 0, charset: str = "UTF-8", multiline: bool = False) -> DataFrame:
    """Rows of CSV files in one of the DIALECTS, with the schema given; a record of another width fails the flow.

    skip: lines left out at the start of each file. multiline: quoted values may hold line ends; a file is then read by one
    task, which streams it. With `skip` a file is in one task's memory.
    """
    paths = _paths(spark, source)
    if not paths:
        return empty(spark, schema)
    fields = spark.createDataFrame([], schema).schema.fields
    if skip:
        rows = _skipped(spark, paths, fields, separator, skip + header, charset)
    else:
        trimmed = str(dialect == "trimmed").lower()
        options = {"sep": separator, "header": str(header).lower(), "encoding": charset, "multiLine": str(multiline).lower(), "mode": "FAILFAST", "quote": '"', "escape": '"', "nullValue": _NOTHING, "emptyValue": ""}
        options |= {"ignoreLeadingWhiteSpace": trimmed, "ignoreTrailingWhiteSpace": trimmed}
        rows = spark.read.schema(", ".join(f"`{f.name}` string" for f in fields)).options(**options).csv(paths)
    return rows.select(*(_typed(f, dialect).alias(f.name) for f in fields))


def _typed(field: StructField, dialect: str) -> Column:
    """A column read as text, by its dialect and type."""
    value, text = F.col(f"`{field.name}`"), field.dataType.simpleString() == "string"
    if dialect == "literal":
        value = F.when(value != "null", value) if not text else F.when(F.coalesce(value, F.lit("")) != "null", F.coalesce(value, F.lit("")))
    elif dialect == "trimmed":
        value = F.trim(F.coalesce(value, F.lit(""))) if text else value
    return value if text else F.when(F.trim(value) != "", F.trim(value).cast(field.dataType))


def _skipped(spark: SparkSession, paths: list[str], fields: Sequence[StructField], separator: str, skip: int, charset: str) -> DataFrame:
    whole = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                data = gzip.decompress(content) if path.endswith(".gz") else content
                for rows in _chunks(csv_rows(data.decode(charset), separator, True), 50_000, skip, len(fields)):
                    yield pd.DataFrame(rows, columns=[f.name for f in fields], dtype=object)

    return whole.mapInPandas(run, ", ".join(f"`{f.name}` string" for f in fields))


def csv_rows(text: str, separator: str = ",", exact: bool = True) -> Iterator[list[str | None]]:
    """Values of each record; exact: an unquoted empty value is None."""
    row, value, quoted, inside, i = [], [], False, False, 0

    def ended() -> str | None:
        out = "".join(value)
        return None if exact and not quoted and not out else out

    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                value.append('"')
                i += 1
            elif c == '"':
                inside = False
            else:
                value.append(c)
        elif c == '"' and not "".join(value).strip():
            inside, quoted, value = True, True, []
        elif c == separator or c in "\r\n":
            row.append(ended())
            value, quoted = [], False
            if c != separator:
                i += text[i : i + 2] == "\r\n"
                yield row
                row = []
        elif not (quoted and c.isspace()):
            value.append(c)
        i += 1
    if row or value or quoted:
        row.append(ended())
        yield row


def _chunks(rows: Iterator[list], size: int, skip: int, width: int) -> Iterator[list[list]]:
    rows = itertools.islice(rows, skip, None)
    while part := list(itertools.islice(rows, size)):
        for r in part:
            if len(r) != width:
                raise ValidationError(f"{len(r)} values where {width} are due")
        yield part


def read_records(spark: SparkSession, source: str | Sequence[str] | FileSelection, decode: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """Items that a function decodes from each whole file, a file a task; gz files are unpacked first."""
    paths = _paths(spark, source)
    if not paths:
        return empty(spark, schema)
    names = spark.createDataFrame([], schema).columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                items = iter(decode(gzip.decompress(content) if path.endswith(".gz") else content))
                while part := list(itertools.islice(items, 50_000)):
                    yield pd.DataFrame(part, columns=names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, schema)


def read_integers(spark: SparkSession, source: str | Sequence[str] | FileSelection, kind: str = "int32_le") -> DataFrame:
    """Fixed-width integers, in `value`."""
    width = {"int16": "int", "int32": "int", "int64": "long"}[kind.split("_")[0]]
    return read_records(spark, source, lambda data: ((v,) for v in coding.decode_integers(data, kind)), f"value {width}")


def read_delimited(spark: SparkSession, source: str | Sequence[str] | FileSelection) -> DataFrame:
    """Messages with their lengths as varints before them (as protocol buffers are streamed), in `value`."""
    return read_records(spark, source, lambda data: ((m,) for m in coding.undelimited(data)), "value binary")


def read_protobuf(spark: SparkSession, source: str | Sequence[str] | FileSelection, message: Callable[[], object], fields: Sequence[str], schema: str) -> DataFrame:
    """Fields of length-delimited messages of a generated class."""

    def decode(data: bytes) -> Iterator[tuple]:
        for part in coding.undelimited(data):
            m = message()
            m.ParseFromString(part)
            yield tuple(getattr(m, f) for f in fields)

    return read_records(spark, source, decode, schema)


def read_avro_data(spark: SparkSession, source: str | Sequence[str] | FileSelection, record: dict, schema: str) -> DataFrame:
    """Records of files of bare Avro data, by the record's Avro schema; schema: their columns."""
    return read_records(spark, source, lambda data: avro.decode_stream(record, data), schema)


def read_avro(spark: SparkSession, source: str | Sequence[str] | FileSelection, schema: str) -> DataFrame:
    """Records of Avro container files, by the schemas in them; schema: their columns. Needs no module of Spark."""
    return read_records(spark, source, avro.decode_container, schema)


def read_json_lines(spark: SparkSession, source: str | Sequence[str] | FileSelection, schema: str) -> DataFrame:
    """Rows of files with a JSON object a line; a line that doesn't fit fails the flow."""
    paths = _paths(spark, source)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths) if paths else empty(spark, schema)


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """Rows of a SELECT. partition: a numeric column, its bounds, and how many tasks read ranges of it."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, n = partition
    reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low)
    return reader.option("upperBound", high).option("numPartitions", n).load()


def read_url(spark: SparkSession, url: str, charset: str = "UTF-8", timeout: float = 2.0) -> DataFrame:
    """Lines behind a URL, fetched here; redirects are followed, and another status than 200 fails."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            if getattr(answer, "status", 200) not in (200, None):
                raise HttpFlowError(answer.status, url)
            data = answer.read()
    except urllib.error.HTTPError as e:
        raise HttpFlowError(e.code, url) from e
    text = (gzip.decompress(data) if url.endswith(".gz") else data).decode(charset)
    return spark.createDataFrame([(line,) for line in text.splitlines()], "value string")
