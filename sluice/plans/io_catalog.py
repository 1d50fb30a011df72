"""Queries of sources, sinks, codecs, shuffles and helpers: each writes driver tables, reads them back and is checked by SQL."""

from __future__ import annotations

import http.server
import io
import json
import queue
import threading
from collections.abc import Callable
from functools import partial

import pandas as pd
from google.protobuf.wrappers_pb2 import StringValue
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sluice.errors import FlowError, FlowTimeout
from sluice.functions import scalars, scheduling
from sluice.operators import order, quantiles, reduce, rows, shuffle
from sluice.session import shared_path
from sluice.sources import readers, sinks
from sluice.sources.files import FileSelection, Shard, Storage
from sluice.sources.warehouse import Options, Query, Warehouse
from sluice.streaming import windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _answer(spark: SparkSession, schema: str, *row: object) -> DataFrame:
    return spark.createDataFrame([row], schema)


# Sources


def collection_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at hand, joined to a table."""
    at_hand = readers.from_rows(spark, [(i, f"n{i}") for i in range(0, 25, 3)], "n_nationkey int, tag string")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name").join(at_hand, "n_nationkey")


def iterator_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an iterator, in parts."""
    return readers.from_rows(spark, ((i, i * i) for i in range(2_500)), "i long, square long", at_once=1_000)


def empty_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No rows, united with a table."""
    return readers.empty(spark, "r_regionkey int, r_name string").unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name"))


def error_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that fails when it is read, and its message."""
    try:
        readers.failing(spark, "no such input").collect()
        said = "nothing"
    except Exception as e:
        said = "no such input" if "[FLOW] no such input" in str(e) else "something else"
    return _answer(spark, "said string", said)


def _drained(spark: SparkSession, sf_dir: str, n: int) -> list[queue.Queue]:
    queues = [queue.Queue() for _ in range(n)]
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    if n == 1:
        sinks.to_queue(nation, queues[0])
    else:
        sinks.to_queues(nation, queues, "n_nationkey")
    return queues


def queue_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows into a queue and out of it."""
    (q,) = _drained(spark, sf_dir, 1)
    return readers.from_queue(spark, q, table(spark, sf_dir, "nation").select("n_nationkey", "n_name").schema)


def sharded_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt out to three queues by key, and drained from each."""
    schema = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").schema
    parts = [readers.from_queue(spark, q, schema).withColumn("queue", F.lit(i)) for i, q in enumerate(_drained(spark, sf_dir, 3))]
    dealt = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return dealt.groupBy("n_nationkey").agg(F.max("n_name").alias("n_name"), F.countDistinct("queue").alias("queues"))


def url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines behind a URL that a server here answers."""
    body = "\n".join(r.n_name for r in table(spark, sf_dir, "nation").select("n_name").collect()).encode()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        return readers.read_url(spark, f"http://127.0.0.1:{server.server_port}/names.txt", timeout=30)
    finally:
        server.shutdown()
        server.server_close()


def jdbc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a database's SELECT, read by four tasks over equal ranges of its keys; the database is a file that all executors see."""
    balance, beyond = F.col("s_acctbal").cast("double"), ("NaN", "Infinity", "-Infinity")  # what the database's doubles don't hold, by number in X
    x = F.coalesce(*(F.when(balance == F.lit(v).cast("double"), i) for i, v in enumerate(beyond)))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("K"), F.when(x.isNull(), balance).alias("B"), x.alias("X"))
    url, query = sinks.write_derby(supplier, shared_path(spark, "jdbc"), "T"), "select * from T where B > 0 or X < 2"
    low, high = readers.read_jdbc(spark, url, f"select min(K) as LOW, max(K) as HIGH from ({query}) q").first()
    rows_ = readers.read_jdbc(spark, url, query, None if low is None else ("K", low, high, 4))
    return rows_.select(F.col("K").alias("s_suppkey"), F.coalesce("B", *(F.when(F.col("X") == i, F.lit(v).cast("double")) for i, v in enumerate(beyond))).alias("s_acctbal"))


# Text and files


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat_ws("|", "p_partkey", "p_name", "p_type").alias("value"))


def text_file(spark: SparkSession, sf_dir: str, compression: str = "none") -> DataFrame:
    """Lines written and read again."""
    path = shared_path(spark, "text")
    sinks.write_text(_lines(spark, sf_dir), path, compression=compression)
    return readers.read_text(spark, path)


def text_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file in another charset than UTF-8."""
    names = [r.n_name for r in table(spark, sf_dir, "nation").select("n_name").collect()]
    path = f"{shared_path(spark, 'latin')}/names.txt"
    Storage(spark).put(path, "\n".join(f"é {n} ß" for n in names).encode("latin-1"))
    return readers.read_text(spark, path, charset="ISO-8859-1")


def text_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes to one folder, the second appended."""
    path = shared_path(spark, "appended")
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("value"))
    sinks.write_text(region, path)
    sinks.write_text(region, path, compression="gzip", mode="append")
    return readers.read_text(spark, path)


def multi_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several folders with the place of their file in the order of the list."""
    paths = []
    for name, column in (("region", "r_name"), ("nation", "n_name")):
        folder = shared_path(spark, name)
        sinks.write_text(table(spark, sf_dir, name).select(F.col(column).alias("value")).coalesce(1), folder)
        paths.append(FileSelection([folder], tests=[r".*\.txt"]).files(spark)[0].path)
    lines = readers.read_text(spark, paths, positions=True)
    first = F.row_number().over(Window.partitionBy("file_order").orderBy("line"))
    return lines.select("value", F.col("file_order").cast("long").alias("file_order"), first.cast("long").alias("place"))


def _files(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "files")
    sinks.write_text(_lines(spark, sf_dir).repartition(7, "value"), path)
    return path


def multi_file(spark: SparkSession, sf_dir: str, balanced: bool = False) -> DataFrame:
    """Files of a folder shared out among three readers: lines, and readers of each line."""
    path = _files(spark, sf_dir)
    parts = [readers.read_text(spark, FileSelection([path], tests=[r".*\.txt"], shard=Shard(i, 3), balanced=balanced)).withColumn("reader", F.lit(i)) for i in range(3)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("reader").alias("readers"))


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, head and exact sample of a text file."""
    path = shared_path(spark, "lines")
    sinks.write_text(table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("value")).coalesce(1), path)
    lines = readers.read_text(spark, FileSelection([path], tests=[r".*\.txt"]), positions=True)
    head = order.head(lines, 5, "file_order", "line").select("value", F.lit("head").alias("what"))
    sample = order.sample_lines(lines, 7, 3).agg(F.concat(F.countDistinct("value").cast("string"), F.lit(" of "), F.count(F.lit(1)).cast("string")).alias("value"))
    return head.unionByName(sample.withColumn("what", F.lit("sample"))).unionByName(reduce.count(lines).select(F.col("count").cast("string").alias("value"), F.lit("count").alias("what")))


def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of a file store: put, list, copy, move, compose, delete, marks, locks, last file, identical files."""
    s, root = Storage(spark), shared_path(spark, "store")
    names = [r.r_name for r in table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").collect()]
    s.in_parallel("put", [(f"{root}/a/{i}.txt", n.encode()) for i, n in enumerate(names)])
    s.in_parallel("copy", [(f"{root}/a/{i}.txt", f"{root}/b/{i}.txt") for i in range(len(names))])
    s.move(f"{root}/b/0.txt", f"{root}/b/z.txt")
    s.compose([f"{root}/a/{i}.txt" for i in range(len(names))], f"{root}/all.txt")
    s.delete(f"{root}/b/1.txt")
    done = s.is_done(f"{root}/a")
    s.mark_done(f"{root}/a")
    facts = {
        "composed": s.get(f"{root}/all.txt").decode(), "listed": str(len(s.list(f"{root}/b"))), "last": s.last(f"{root}/b", r"[a-z0-9]\.txt").path.rsplit("/", 1)[-1],
        "done": f"{done} {s.is_done(f'{root}/a')}", "locked": f"{s.lock(f'{root}/lock')} {s.lock(f'{root}/lock')}",
        "identical": f"{s.identical(f'{root}/a/0.txt', f'{root}/b/z.txt')} {s.identical(f'{root}/a/0.txt', f'{root}/a/1.txt')}", "retried": s.retried("get", f"{root}/a/2.txt").decode(),
    }
    return spark.createDataFrame(list(facts.items()), "what string, value string")


def compressed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file of a folder compressed, read compressed, and unpacked again."""
    s, path, packed = Storage(spark), _files(spark, sf_dir), shared_path(spark, "packed")
    targets = s.compress_folder(path, packed)
    s.decompress(targets[0], f"{packed}/plain.txt")
    same = any(s.identical(f"{packed}/plain.txt", f.path) for f in s.list(path))
    return readers.read_text(spark, targets).withColumn("same", F.lit(same))


# Codecs


def csv_file(spark: SparkSession, sf_dir: str, dialect: str = "trimmed") -> DataFrame:
    """Rows as CSV with quotes, blanks, empty values and nulls, read in a dialect."""
    path = shared_path(spark, "csv")
    odd = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 1, F.lit("")).when(F.col("c_custkey") % 5 == 2, F.lit('a, "b" c')).otherwise(F.concat(F.lit("x"), F.col("c_name"), F.lit("y")))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), odd.alias("note"), "c_mktsegment")
    sinks.write_csv(customer, path, header=True)
    return readers.read_csv(spark, path, "c_custkey long, note string, c_mktsegment string", dialect, header=True)


def csv_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with another separator, without its first two lines."""
    path = f"{shared_path(spark, 'csv')}/n.csv"
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    Storage(spark).put(path, "\n".join(["a title", "n;name", *(f"{r[0]};{r[1]}" for r in nation)]).encode())
    return readers.read_csv(spark, path, "n_nationkey long, n_name string", "exact", separator=";", skip=2)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "json")
    sinks.write_json_lines(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("s_acctbal")), path, "gzip")
    return readers.read_json_lines(spark, path, "s_suppkey long, s_name string, s_acctbal double")


def integers_file(spark: SparkSession, sf_dir: str, kind: str = "int32_le") -> DataFrame:
    path, most = shared_path(spark, kind), 1 << (15 if kind.startswith("int16") else 30)
    sinks.write_integers(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % most - most // 2).cast("long").alias("v")), path, "v", kind)
    return readers.read_integers(spark, path, kind).select(F.col("value").cast("long").alias("value"))


def delimited_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte messages behind their lengths."""
    path = shared_path(spark, "delimited")
    sinks.write_delimited(_lines(spark, sf_dir).select(F.col("value").cast("binary").alias("m")), path, "m")
    return readers.read_delimited(spark, path).select(F.col("value").cast("string").alias("value"))


def protobuf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocol-buffer messages behind their lengths."""
    path = shared_path(spark, "protobuf")

    def encode(frame):
        return frame.assign(m=[StringValue(value=v).SerializeToString() for v in frame["value"]])[["m"]]

    sinks.write_delimited(rows.map_opaque(_lines(spark, sf_dir), encode, "m binary"), path, "m")
    return readers.read_protobuf(spark, path, StringValue, ["value"], "value string")


_RECORD = {"type": "record", "name": "Customer", "fields": [{"name": "k", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "balance", "type": "double"}]}


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 7 > 0, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), name.alias("name"), F.col("c_acctbal").cast("double").alias("balance"))


def avro_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare Avro data."""
    path = shared_path(spark, "avro-data")
    sinks.write_avro_data(_customers(spark, sf_dir), path, _RECORD)
    return readers.read_avro_data(spark, path, _RECORD, "k long, name string, balance double")


def avro_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avro container files."""
    path = shared_path(spark, "avro")
    sinks.write_avro(_customers(spark, sf_dir), path, _RECORD)
    return readers.read_avro(spark, path, "k long, name string, balance double")


# Sinks


def collection_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = sinks.to_list(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), "r_name"))
    return spark.createDataFrame([(r.k, r.r_name) for r in held], "k long, r_name string")


def map_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of the last nation of each region, by key."""
    held = sinks.to_map(table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("k"), "n_name", "n_nationkey"), "k", "n_name", "n_nationkey")
    return spark.createDataFrame(list(held.items()), "k long, last string")


def line_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to an open text file."""
    target = io.StringIO()
    n = sinks.to_writer(table(spark, sf_dir, "nation"), target, "n_name", ["n_nationkey"])
    return spark.createDataFrame([(i, line, n) for i, line in enumerate(target.getvalue().splitlines())], "place long, line string, n long")


def consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a sink took, as a metric of the flow counts them; then what ends it, once."""
    ended: list[int] = []
    df, seen = rows.observed(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), n=F.count(F.lit(1)), last=F.max("l_shipdate"))
    sinks.consume(df, lambda: ended.append(1))
    return spark.createDataFrame([(seen.get["n"], len(ended))], "n long, ended long")


def consumed_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several flows at a time."""
    flows = {n: rows.observed(table(spark, sf_dir, n), n=F.count(F.lit(1))) for n in ("orders", "customer", "part")}
    sinks.consume_all([df for df, _ in flows.values()], 3)
    return spark.createDataFrame([(n, seen.get["n"]) for n, (_, seen) in flows.items()], "flow string, n long")


def written_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each priority: rows of each, read from the files."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sinks.write_shards(orders, shared_path(spark, "shards"), "o_orderpriority", order_by=["o_orderkey"])


def written_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each of eight hashes: rows of each key, and the folders it is in."""
    path = shared_path(spark, "hashed")
    sinks.write_hash_shards(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, "o_custkey", 8)
    return spark.read.parquet(path).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard").alias("shards"))


def written_sequence_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each status with its rows gathered first."""
    return sinks.write_sequence_shards(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), shared_path(spark, "sequence"), "o_orderstatus", ["o_orderkey"])


def teed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow written on its way to a further step."""
    path = shared_path(spark, "teed")
    on = rows.tee(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), lambda df: sinks.write_text(df.select(F.col("s_suppkey").alias("value")), path))
    counted = on.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(readers.read_text(spark, path).agg(F.count(F.lit(1)).alias("lines")))  # one row


def compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps as one operator that ends in a sink."""
    path = shared_path(spark, "compound")
    steps = [partial(rows.filter_rows, condition="n_regionkey > 1"), lambda df: rows.map_rows(df, F.upper("n_name").alias("value")), lambda df: order.sort(df, "value"), lambda df: sinks.write_text(df, path)]
    rows.chained(table(spark, sf_dir, "nation"), *steps)
    return readers.read_text(spark, path)


def identical_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return _answer(spark, "same boolean, other boolean", sinks.identical(nation, nation.orderBy(F.desc("n_name"))), sinks.identical(nation, nation.where("n_nationkey > 0")))


# Metrics, order, helpers


def observed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the rows that passed by a callback, with its end."""
    df, seen = rows.observed(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), n=F.count(F.lit(1)), least=F.min("o_orderkey"), most=F.max("o_orderkey"))
    sinks.consume(df)
    return spark.createDataFrame([tuple(int(seen.get[k]) for k in ("n", "least", "most"))], "n long, least long, most long")


def progress_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a flow's progress: first, last, whether they rise; and shares of several flows."""
    said: list[int] = []
    n = rows.with_progress(table(spark, sf_dir, "lineitem"), lambda df: df.count(), said.append)
    steps: list[int] = []
    rescaled = rows.ProgressSteps(steps.append, 20, 60, 10)
    for i in range(101):
        rescaled(i / 100)
    joined = f"{rows.least([0.2, 0.6])} {rows.most([0.2, 0.6])} {rows.average([0.25, 0.75])}"
    return _answer(spark, "n long, first int, last int, rising boolean, steps string, joined string", n, said[0], said[-1], said == sorted(set(said)), str(steps), joined)


def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow in order passes, one out of order fails."""
    answers = []
    for keys in (["o_orderkey"], ["o_totalprice"]):
        try:
            answers.append(str(rows.validate_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), keys, "o_orderkey").count()))
        except Exception as e:
            answers.append("out of order" if "OUT_OF_ORDER" in str(e) else "other")
    return _answer(spark, "ordered string, other string", *answers)


def runs_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal status over all orders, without partitions."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    out = reduce.reduce_runs(orders, "o_orderstatus", ["o_orderkey"], n=F.count(F.lit(1)), first=F.min("o_orderkey"))
    return out.select(F.col("run").cast("long").alias("run"), "o_orderstatus", "n", "first")


def contiguous_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the family changes inside the partitions of grouped rows: once a family."""
    grouped = reduce.group_contiguous(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 8)

    def changes(frames):
        last = None
        for f in frames:
            for k in f["o_custkey"].tolist():
                if k != last:
                    yield pd.DataFrame({"k": [k]})
                    last = k

    return grouped.mapInPandas(changes, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("runs"))


def action_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions that last `value` seconds: running, completed, and mean time by type."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ended = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 50) * 1_000_000)
    events = events.select("event_type", "ts", F.when(F.col("event_id") % 10 > 0, ended).alias("ended"))
    return reduce.action_stats(events, "event_type", "ts", "ended", F.lit("2999-01-01").cast("timestamp"))


def estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact estimator of quantiles on the driver, of the supplier balances."""
    e: quantiles.QuantileEstimator = quantiles.WindowEstimator(1_000_000)
    for r in table(spark, sf_dir, "supplier").select("s_acctbal").toLocalIterator():
        e.add(float(r[0]))
    return _answer(spark, "n long, median double, below double", e.size(), e.quantile(0.5), e.cdf(0.0))


def sketch_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact ranks of a merged sketch's quantiles, and its rank of a value, are within two hundredths."""
    line = table(spark, sf_dir, "lineitem")
    merged = quantiles.merge(quantiles.sketch(line, "l_extendedprice", ["l_returnflag"]))
    held = merged.select(*(quantiles.quantile(q).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)), quantiles.cdf(30_000.0).alias("below"))
    share = lambda limit: F.avg((F.col("l_extendedprice") <= limit).cast("double"))
    at = F.broadcast(held)  # one row
    ranks = line.select(F.col("l_extendedprice").cast("double").alias("l_extendedprice")).crossJoin(at).agg(*(share(F.col(f"q{q}")).alias(f"r{q}") for q in (5, 50, 95)), (share(F.lit(30_000.0)) - F.max("below")).alias("rb"))
    return ranks.select(*((F.abs(F.col(f"r{q}") - q / 100) < 0.02).alias(f"q{q}_fits") for q in (5, 50, 95)), (F.abs("rb") < 0.02).alias("rank_fits"))


def window_sketch_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose sketched median has an exact rank within three hundredths, or two values, of the middle, by type."""
    events = table(spark, sf_dir, "events").where("value is not null")
    out = windows.sliding_quantiles(events, "ts", "value", "1 hour", 6, [0.5], ["event_type"]).select("event_type", "window_start", "q50")
    slot = F.unix_timestamp(F.date_trunc("hour", F.col("ts")).cast("timestamp"))
    hours = events.select("event_type", F.explode(F.sequence(slot, slot + 5 * 3600, F.lit(3600))).alias("at"), F.col("value").cast("double").alias("value"))
    both = hours.join(out.withColumn("at", F.unix_timestamp(F.col("window_start").cast("timestamp"))), ["event_type", "at"])
    ranked = both.groupBy("event_type", "at").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") < F.col("q50")).cast("int")).alias("low"), F.sum((F.col("value") > F.col("q50")).cast("int")).alias("high"))
    room = F.greatest(F.lit(2.0), 0.03 * F.col("n"))
    fits = (F.col("low") <= F.col("n") / 2 + room) & (F.col("high") <= F.col("n") / 2 + room)
    return ranked.groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.sum(fits.cast("int")).alias("fitting"))


def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples: their sizes (a share's within five deviations), distinct rows of the table, and the same again."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = orders.count()
    share = order.sample_share(orders, 0.2, 7)
    exact = order.sample_exact(orders, 150, 7)
    keys = orders.select("o_custkey").distinct()
    a, b = (order.sample_consistent(df, "o_custkey", 0.25).select("o_custkey").distinct() for df in (orders, keys))
    near = abs(share.count() - 0.2 * n) < 5 * (0.16 * n) ** 0.5
    random = orders.select(scalars.fast_random("o_orderkey", 5).alias("r")).agg(F.min("r").alias("low"), F.max("r").alias("high"), F.avg("r").alias("mean")).first()
    fair = 0 <= random.low and random.high < 1 and abs(random.mean - 0.5) < 3 / n**0.5
    kinds = "near_share boolean, exact long, exact_distinct long, inside boolean, same_keys boolean, fair boolean"
    inside = exact.join(orders, ["o_orderkey", "o_custkey"], "left_anti").isEmpty() and share.join(orders, "o_orderkey", "left_anti").isEmpty()
    return _answer(spark, kinds, bool(near), exact.count(), exact.distinct().count(), inside, sinks.identical(a, b), bool(fair))


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt out by an explicit shard: the partition of each key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return shuffle.with_shard(shuffle.deal(orders, 6, shard=(F.col("o_orderkey") % 6).cast("int"))).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("o_orderkey") % 6).alias("low"), F.max(F.col("o_orderkey") % 6).alias("high"))


def dealt_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt out by key: each key in one partition; and shards of workers by name."""
    spread = shuffle.with_shard(shuffle.deal(table(spark, sf_dir, "lineitem").select("l_suppkey"), 8, "l_suppkey"))
    place = shuffle.worker_shards(["w2", "w0", "w1"])
    return spread.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard").alias("shards"), F.lit(place("w1")).alias("w1"))


def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow that isn't done in time fails; one that is done passes."""
    try:
        scheduling.within(spark, 0.5, lambda: sinks.consume(rows.map_opaque(spark.range(0, 4, 1, 4), lambda f: __import__("time").sleep(20) or f, "id long")))
        late = "done"
    except FlowTimeout:
        late = "late"
    return _answer(spark, "late string, n long", late, scheduling.within(spark, 600, lambda: table(spark, sf_dir, "orders").count()))


def scheduling_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced schedules of nations by customers, retries, tasks side by side."""
    sizes = [r.n for r in table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).orderBy("c_nationkey").collect()]
    plan = scheduling.balanced(sizes, 4)
    loads = [sum(sizes[j] for j in jobs) for jobs in plan]
    fair = max(loads) <= (4 / 3) * max(sum(sizes) / 4, max(sizes))
    tries: list[int] = []

    def flaky() -> int:
        tries.append(1)
        if len(tries) < 3:
            raise FlowError("not yet")
        return len(tries)

    tried = scheduling.retried(flaky, first_wait=0.01)
    counts = scheduling.in_parallel(["nation", "region"], lambda n: table(spark, sf_dir, n).count())
    return _answer(spark, "total long, jobs long, fair boolean, tries long, counts string", sum(loads), sum(map(len, plan)), fair, tried, json.dumps(counts))


def unbounded_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files that come into a folder, two a batch, each batch appended to a table."""
    source, target, marks = (shared_path(spark, n) for n in ("stream-in", "stream-out", "stream-marks"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders.repartition(5, "o_custkey").write.parquet(source)
    stream = windows.stream_of(spark, source, orders.schema, files_a_batch=2)
    flow = windows.each_batch(stream, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(target), marks, once=True)
    flow.awaitTermination()
    return spark.read.parquet(target).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("batch").alias("batches"))


def _warehouse(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, str]:
    name = "v" + shared_path(spark, "v")[-16:]
    table(spark, sf_dir, "customer").createOrReplaceTempView(name)
    return Warehouse(spark), name


def warehouse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with parameters, a function of each row, and one of all rows."""
    w, view = _warehouse(spark, sf_dir)
    q = Query(f"SELECT c_mktsegment, count(*) AS n FROM {view} WHERE c_nationkey >= :least GROUP BY 1", {"least": 5}, row=lambda r: (r[0].lower(), r[1]), result=lambda rs: sorted(rs))
    return spark.createDataFrame(w.execute(q, Options(timeout=600)), "segment string, n long")


def warehouse_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rows than a limit fail a query."""
    w, view = _warehouse(spark, sf_dir)
    answers = []
    for most in (5, 1_000_000_000):
        try:
            answers.append(str(w.frame(Query(f"SELECT DISTINCT c_nationkey FROM {view}"), Options(most_rows=most)).count()))
        except FlowError as e:
            answers.append(type(e).__name__)
    return _answer(spark, "few string, many string", *answers)


def warehouse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view exported to files and loaded into a table with partitions."""
    w, view = _warehouse(spark, sf_dir)
    path, name = shared_path(spark, "export"), f"t{view[1:]}"
    part = spark.table(view).select("c_custkey", "c_name", "c_mktsegment")
    part.createOrReplaceTempView(view)
    w.export(view, path, compression="gzip")
    out = w.load(path, name, "c_custkey long, c_name string, c_mktsegment string", partition_by=("c_mktsegment",))
    rows_ = [tuple(r) for r in out.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("s")).collect()]
    there = w.table_exists(name)
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame([(*r, there) for r in rows_], "c_mktsegment string, n long, s long, there boolean")


def file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole binary files with their sizes."""
    root, s = shared_path(spark, "bytes"), Storage(spark)
    names = [r.n_name for r in table(spark, sf_dir, "nation").select("n_name").collect()]
    s.in_parallel("put", [(f"{root}/{i}.bin", n.encode() * 3) for i, n in enumerate(names)])
    return readers.read_records(spark, FileSelection([root], tests=[r".*\.bin"]), lambda data: [(data.decode(), len(data))], "value string, bytes long")


_PLAIN: list[Callable] = [
    collection_reader, iterator_reader, empty_source, error_source, queue_bridge, sharded_queues, url_lines, jdbc_rows, text_file, text_charset, text_appended, multi_text, multi_file,
    file_lines, storage, compressed_folder, csv_skipped, json_lines, delimited_file, protobuf_file, avro_data, avro_file, collection_writer, map_writer, line_writer, consumed,
    consumed_together, written_shards, written_hash_shards, written_sequence_shards, teed, compound, identical_tables, observed_metrics, progress_reports, out_of_order, runs_of_all,
    contiguous_families, action_stats, estimator, sketch_ranks, window_sketch_ranks, sample_sizes, dealt, dealt_by_key, timeouts, scheduling_helpers, unbounded_flow, warehouse_query,
    warehouse_limits, warehouse_files, file_bytes,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _PLAIN}
QUERIES |= {f"text_file_{c}": partial(text_file, compression=c) for c in ("gzip", "bzip2", "deflate")}
QUERIES |= {f"csv_file_{d}": partial(csv_file, dialect=d) for d in readers.DIALECTS}
QUERIES |= {f"integers_file_{k}": partial(integers_file, kind=k) for k in ("int16_le", "int16_be", "int32_le", "int32_be", "int64_le", "int64_be")}
QUERIES["multi_file_balanced"] = partial(multi_file, balanced=True)

_PART_LINES = "SELECT p_partkey || '|' || p_name || '|' || p_type AS value FROM part"
_CUSTOMERS = "SELECT CAST(c_custkey AS BIGINT) AS k, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS name, CAST(c_acctbal AS DOUBLE) AS balance FROM customer"


def _csv_sql(null: str, empty: str) -> str:
    return f"""
        SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE c_custkey % 5 WHEN 0 THEN {null} WHEN 1 THEN {empty} WHEN 2 THEN 'a, "b" c' ELSE 'x' || c_name || 'y' END AS note, c_mktsegment
        FROM customer"""


def _integers_sql(kind: str) -> str:
    most = 1 << (15 if kind.startswith("int16") else 30)
    return f"SELECT CAST(o_orderkey % {most} - {most // 2} AS BIGINT) AS value FROM orders"


ORACLES = {
    "collection_reader": "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, 'n' || n_nationkey AS tag FROM nation WHERE n_nationkey % 3 = 0",
    "iterator_reader": "SELECT i, i * i AS square FROM range(2500) t(i)",
    "empty_source": "SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, r_name FROM region",
    "error_source": "SELECT 'no such input' AS said",
    "queue_bridge": "SELECT n_nationkey, n_name FROM nation",
    "sharded_queues": "SELECT n_nationkey, n_name, CAST(1 AS BIGINT) AS queues FROM nation",
    "url_lines": "SELECT n_name AS value FROM nation",
    "jdbc_rows": "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier WHERE s_acctbal > 0",
    "text_file": _PART_LINES,
    "text_charset": "SELECT 'é ' || n_name || ' ß' AS value FROM nation",
    "text_appended": "SELECT r_name AS value FROM region UNION ALL SELECT r_name FROM region",
    "multi_text": """
        SELECT r_name AS value, CAST(0 AS BIGINT) AS file_order, row_number() OVER (ORDER BY r_regionkey) AS place FROM region
        UNION ALL SELECT n_name, 1, row_number() OVER (ORDER BY n_nationkey) FROM nation""",
    "multi_file": f"SELECT value, count(*) AS n, CAST(1 AS BIGINT) AS readers FROM ({_PART_LINES}) GROUP BY 1",
    "file_lines": """
        SELECT n_name AS value, 'head' AS what FROM nation WHERE n_nationkey < 5 UNION ALL SELECT '7 of 7', 'sample'
        UNION ALL SELECT CAST(count(*) AS VARCHAR), 'count' FROM nation""",
    "storage": """
        SELECT 'composed' AS what, string_agg(r_name, '' ORDER BY r_regionkey) AS value FROM region UNION ALL SELECT 'listed', CAST(count(*) - 1 AS VARCHAR) FROM region
        UNION ALL SELECT 'retried', max(r_name) FROM region WHERE r_regionkey = 2
        UNION ALL VALUES ('last', 'z.txt'), ('done', 'False True'), ('locked', 'True False'), ('identical', 'True False')""",
    "compressed_folder": f"SELECT value, true AS same FROM ({_PART_LINES})",
    "csv_file_trimmed": _csv_sql("''", "''"),
    "csv_file_exact": _csv_sql("NULL", "''"),
    "csv_file_literal": _csv_sql("''", "''"),
    "csv_skipped": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation",
    "json_lines": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(CASE WHEN s_acctbal > 0 THEN s_acctbal END AS DOUBLE) AS s_acctbal FROM supplier",
    "delimited_file": _PART_LINES,
    "protobuf_file": _PART_LINES,
    "avro_data": _CUSTOMERS,
    "avro_file": _CUSTOMERS,
    "collection_writer": "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name FROM region",
    "map_writer": "SELECT CAST(n_regionkey AS BIGINT) AS k, arg_max(n_name, n_nationkey) AS last FROM nation GROUP BY 1",
    "line_writer": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS place, n_name AS line, count(*) OVER () AS n FROM nation",
    "consumed": "SELECT count(*) AS n, CAST(1 AS BIGINT) AS ended FROM lineitem WHERE l_returnflag = 'R'",
    "consumed_together": "SELECT 'orders' AS flow, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part",
    "written_shards": 'SELECT o_orderpriority AS shard, count(*) AS "rows" FROM orders GROUP BY 1',
    "written_hash_shards": "SELECT o_custkey, count(*) AS n, CAST(1 AS BIGINT) AS shards FROM orders GROUP BY 1",
    "written_sequence_shards": 'SELECT o_orderstatus AS shard, count(*) AS "rows" FROM orders GROUP BY 1',
    "teed": "SELECT s_nationkey, count(*) AS n, (SELECT count(*) FROM supplier) AS lines FROM supplier GROUP BY 1",
    "compound": "SELECT upper(n_name) AS value FROM nation WHERE n_regionkey > 1",
    "identical_tables": "SELECT true AS same, false AS other",
    "observed_metrics": "SELECT count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS least, CAST(max(o_orderkey) AS BIGINT) AS most FROM orders WHERE o_orderstatus = 'O'",
    "progress_reports": """
        SELECT count(*) AS n, CAST(0 AS INTEGER) AS first, CAST(100 AS INTEGER) AS last, true AS rising, '[20, 30, 40, 50, 60]' AS steps, '0.2 0.6 0.5' AS joined FROM lineitem""",
    "out_of_order": "SELECT CAST(count(*) AS VARCHAR) AS ordered, 'out of order' AS other FROM orders",
    "runs_of_all": """
        WITH e AS (SELECT *, CASE WHEN lag(o_orderstatus) OVER (ORDER BY o_orderkey) IS NOT DISTINCT FROM o_orderstatus THEN 0 ELSE 1 END AS new FROM orders),
        r AS (SELECT *, CAST(sum(new) OVER (ORDER BY o_orderkey) AS BIGINT) AS run FROM e)
        SELECT run, o_orderstatus, count(*) AS n, min(o_orderkey) AS first FROM r GROUP BY run, o_orderstatus""",
    "contiguous_families": "SELECT DISTINCT CAST(o_custkey AS BIGINT) AS k, CAST(1 AS BIGINT) AS runs FROM orders",
    "action_stats": """
        SELECT event_type, CAST(sum(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS running, sum(CASE WHEN event_id % 10 > 0 THEN 1 ELSE 0 END)::BIGINT AS completed,
               CAST(sum(CASE WHEN event_id % 10 > 0 THEN event_id % 50 ELSE 0 END) AS DOUBLE) AS total,
               CAST(sum(CASE WHEN event_id % 10 > 0 THEN event_id % 50 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN event_id % 10 > 0 THEN 1 ELSE 0 END) AS average
        FROM events GROUP BY 1""",
    "estimator": """
        SELECT count(*) AS n, CAST(quantile_disc(CAST(s_acctbal AS DOUBLE), 0.5) AS DOUBLE) AS median,
               CAST(sum(CASE WHEN s_acctbal <= 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS below FROM supplier""",
    "sketch_ranks": "SELECT true AS q5_fits, true AS q50_fits, true AS q95_fits, true AS rank_fits",
    "window_sketch_ranks": """
        WITH h AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS slot FROM events WHERE value IS NOT NULL)
        SELECT event_type, count(*) AS windows, count(*) AS fitting FROM h GROUP BY 1""",
    "sample_sizes": """
        SELECT true AS near_share, CAST(150 AS BIGINT) AS exact, CAST(150 AS BIGINT) AS exact_distinct, true AS inside, true AS same_keys, true AS fair""",
    "dealt": "SELECT CAST(o_orderkey % 6 AS INTEGER) AS shard, count(*) AS n, min(o_orderkey % 6) AS low, max(o_orderkey % 6) AS high FROM orders GROUP BY 1",
    "dealt_by_key": "SELECT l_suppkey, count(*) AS n, CAST(1 AS BIGINT) AS shards, CAST(1 AS INTEGER) AS w1 FROM lineitem GROUP BY 1",
    "timeouts": "SELECT 'late' AS late, count(*) AS n FROM orders",
    "scheduling_helpers": """
        SELECT count(*) AS total, count(DISTINCT c_nationkey) AS jobs, true AS fair, CAST(3 AS BIGINT) AS tries,
               '[' || (SELECT count(*) FROM nation) || ', ' || (SELECT count(*) FROM region) || ']' AS counts FROM customer""",
    "unbounded_flow": "SELECT o_custkey, count(*) AS n, CAST(1 AS BIGINT) AS batches FROM orders GROUP BY 1",
    "warehouse_query": "SELECT lower(c_mktsegment) AS segment, count(*) AS n FROM customer WHERE c_nationkey >= 5 GROUP BY 1",
    "warehouse_limits": "SELECT 'ExcessiveResourcesError' AS few, CAST(count(DISTINCT c_nationkey) AS VARCHAR) AS many FROM customer",
    "warehouse_files": "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s, true AS there FROM customer GROUP BY 1",
    "file_bytes": "SELECT repeat(n_name, 3) AS value, CAST(3 * length(n_name) AS BIGINT) AS bytes FROM nation",
    "multi_file_balanced": f"SELECT value, count(*) AS n, CAST(1 AS BIGINT) AS readers FROM ({_PART_LINES}) GROUP BY 1",
}
ORACLES |= {f"text_file_{c}": _PART_LINES for c in ("gzip", "bzip2", "deflate")}
ORACLES |= {name: _integers_sql(name.removeprefix("integers_file_")) for name in QUERIES if name.startswith("integers_file_")}
