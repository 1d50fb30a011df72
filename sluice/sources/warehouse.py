"""Queries against registered views with the options that warehouses have: parameters, limits that fail, tables, exports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sluice.errors import ExcessiveResourcesError
from sluice.functions.scheduling import within


@dataclass(frozen=True)
class Query:
    """SQL with named parameters, and functions of a row and of all rows."""

    sql: str
    parameters: dict = field(default_factory=dict)
    row: Callable = staticmethod(lambda r: r)
    result: Callable = staticmethod(list)


@dataclass(frozen=True)
class Options:
    """timeout in seconds; most_rows: more rows fail the query, instead of being cut; table: where the result goes, and how
    (append, overwrite, errorifexists)."""

    timeout: float | None = None
    most_rows: int | None = None
    table: str | None = None
    disposition: str = "errorifexists"


class Warehouse:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def frame(self, query: Query, options: Options = Options()) -> DataFrame:
        df = self.spark.sql(query.sql, args=query.parameters or None)
        if options.most_rows is not None and len(df.take(options.most_rows + 1)) > options.most_rows:
            raise ExcessiveResourcesError(f"more than {options.most_rows} rows")
        if options.table:
            df.write.mode(options.disposition).saveAsTable(options.table)
            return self.spark.table(options.table)
        return df

    def execute(self, query: Query, options: Options = Options()):
        """The query's result of its rows, which are fetched a partition at a time."""

        def action():
            return query.result(query.row(r) for r in self.frame(query, options).toLocalIterator())

        return within(self.spark, options.timeout, action) if options.timeout else action()

    def table_exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def create_table(self, name: str, query: Query, replace: bool = False) -> DataFrame:
        return self.frame(query, Options(table=name, disposition="overwrite" if replace else "errorifexists"))

    def export(self, table: str, path: str, format: str = "csv", header: bool = True, compression: str = "none", separator: str = ",") -> None:
        writer = self.spark.table(table).write.option("compression", compression)
        (writer.option("header", header).option("sep", separator) if format == "csv" else writer).format(format).save(path)

    def load(self, path: str, table: str, schema: str, format: str = "csv", header: bool = True, skip_bad: bool = False, partition_by: tuple[str, ...] = (), cluster_by: tuple[str, int] | None = None, disposition: str = "errorifexists") -> DataFrame:
        reader = self.spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST")
        df = (reader.option("header", header) if format == "csv" else reader).format(format).load(path)
        writer = df.write.mode(disposition)
        writer = writer.partitionBy(*partition_by) if partition_by else writer
        (writer.bucketBy(cluster_by[1], cluster_by[0]) if cluster_by else writer).saveAsTable(table)
        return self.spark.table(table)
