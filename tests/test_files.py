import gzip
import http.server
import json
import os
import queue
import subprocess
import sys
import threading
import time
from pathlib import Path

import duckdb
import pandas as pd
import pyspark
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.errors import ExcessiveResourcesError, FlowError, FlowTimeout, HttpFlowError, IOFlowError, QueueFlowError, ValidationError, raised
from sluice.functions import coding, scalars, scheduling
from sluice.plans import io_catalog
from sluice.sources import readers, sinks
from sluice.sources.files import FileSelection, Shard, Storage
from sluice.sources.warehouse import Options, Query, Warehouse


@pytest.fixture
def folder(tmp_path):
    for name, lines in {"a.csv": "1 5", "b.csv": "2", "c.csv": "4 3 6", "d.csv": "9 10", "latest2/d.csv": "7 8"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines.split()) + "\n")
    (tmp_path / "note.txt").write_text("x\n")
    return f"file:{tmp_path}"


@pytest.mark.parametrize("balanced", [False, True])
@pytest.mark.parametrize("n", [1, 3, 10])
def test_shards_cover_all_files_once(spark, folder, n, balanced):
    seen = []
    for i in range(n):
        s = FileSelection([folder], tests=[r".*\.csv"], shard=Shard(i, n), balanced=balanced)
        seen += [int(r.value) for r in readers.read_text(spark, s).collect()]
    assert sorted(seen) == list(range(1, 11))


def test_selection(spark, folder):
    flat = FileSelection([folder], recursive=False, tests=[r".*\.csv", lambda f: f.size > 2])
    assert [f.path[-5:] for f in flat.files(spark)] == ["a.csv", "c.csv", "d.csv"]
    with pytest.raises(ValidationError):
        Shard(3, 3)
    with pytest.raises(IOFlowError):
        FileSelection([folder + "/none"]).files(spark)
    lines = readers.read_text(spark, FileSelection([folder], tests=[r".*\.csv"], order=lambda f: f.path.rsplit("/", 1)[-1]), positions=True)
    assert [int(r.value) for r in lines.orderBy("file_order", "line").collect()][:6] == [1, 5, 2, 4, 3, 6]


def test_storage(spark, tmp_path):
    s, root = Storage(spark), f"file:{tmp_path}"
    s.put(f"{root}/x/1.bin", b"ab")
    s.put(f"{root}/x/2.bin", b"cd")
    with pytest.raises(IOFlowError):
        s.put(f"{root}/x/1.bin", b"", exclusive=True)
    s.copy(f"{root}/x/1.bin", f"{root}/x/3.bin")
    s.move(f"{root}/x/3.bin", f"{root}/x/4.bin")
    s.compose([f"{root}/x/1.bin", f"{root}/x/2.bin"], f"{root}/y.bin")
    assert s.get(f"{root}/y.bin") == b"abcd" and s.last(f"{root}/x", r"\d\.bin").path.endswith("4.bin")
    assert not s.is_done(f"{root}/x")
    s.mark_done(f"{root}/x")
    assert s.is_done(f"{root}/x") and s.lock(f"{root}/l") and not s.lock(f"{root}/l")
    assert s.delete(f"{root}/x") and not s.exists(f"{root}/x")


def test_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é one",), ("",), ("two",)], "value string")
    for compression in ("none", "gzip"):
        path = f"{tmp_path}/{compression}"
        sinks.write_text(df, path, compression=compression)
        assert sorted(r.value for r in readers.read_text(spark, path).collect()) == ["", "two", "é one"]
    (tmp_path / "l.txt").write_bytes('é "x"\nb,c\n'.encode("latin-1"))
    assert [r.value for r in readers.read_text(spark, f"{tmp_path}/l.txt", "ISO-8859-1").collect()] == ['é "x"', "b,c"]


def test_trimmed_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,height, weight\nBen,178,68\nGuy, 185 , 90\n")
    got = readers.read_csv(spark, f"{tmp_path}/p.csv", "name string, height int, weight int", header=True).collect()
    assert [tuple(r) for r in got] == [("Ben", 178, 68), ("Guy", 185, 90)]
    (tmp_path / "bad.csv").write_text("Ben,178\n")
    with pytest.raises(FlowError), raised():
        readers.read_csv(spark, f"{tmp_path}/bad.csv", "name string, height int, weight int").collect()


def test_exact_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"a ",1\nb ," 2"\n"c,d",3\n, 4 \n"",5\n"q""q",6\n')
    got = [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/t.csv", "s string, n int", "exact").collect()]
    assert got == [("a ", 1), ("b ", 2), ("c,d", 3), (None, 4), ("", 5), ('q"q', 6)]
    (tmp_path / "u.csv").write_bytes("skip\nskip\na_1\n_2\n".encode("utf-16"))
    got = [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/u.csv", "s string, n int", "exact", "_", skip=2, charset="utf-16").collect()]
    assert got == [("a", 1), (None, 2)]
    df = spark.createDataFrame([(" x ", 1), (None, 2), ("", 3), ('a"b,c', 4)], "s string, n int")
    sinks.write_csv(df.coalesce(1), f"{tmp_path}/out")
    assert sorted([tuple(r) for r in readers.read_csv(spark, [f.path for f in Storage(spark).list(f"file:{tmp_path}/out")], "s string, n int", "exact").collect()], key=lambda r: r[1])[:3] == [(" x ", 1), (None, 2), ("", 3)]


def test_literal_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text("null,1\nx,2\n")
    assert [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/n.csv", "s string, n int", "literal").collect()] == [(None, 1), ("x", 2)]


@pytest.mark.parametrize("kind", ["int16_le", "int32_be", "int64_le"])
def test_integer_files(spark, tmp_path, kind):
    df = spark.createDataFrame([(v,) for v in (-5, 0, 300)], "v int")
    sinks.write_integers(df.coalesce(1), f"file:{tmp_path}/ints", "v", kind)
    assert sorted(r.value for r in readers.read_integers(spark, f"{tmp_path}/ints", kind).collect()) == [-5, 0, 300]


def test_delimited_and_protobuf_files(spark, tmp_path):
    from google.protobuf.wrappers_pb2 import StringValue

    rows = [(StringValue(value=v).SerializeToString(),) for v in ("x", "", "é" * 200)]
    sinks.write_delimited(spark.createDataFrame(rows, "m binary"), f"file:{tmp_path}/m", "m")
    got = readers.read_protobuf(spark, f"{tmp_path}/m", StringValue, ["value"], "value string").collect()
    assert sorted(r.value for r in got) == ["", "x", "é" * 200]
    with pytest.raises(FlowError), raised():
        readers.read_avro(spark, f"{tmp_path}/m", "v string").collect()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.binary(max_size=300), max_size=4))
def test_coding(number, messages):
    assert coding.decode_varint(coding.encode_varint(number)) == (number, len(coding.encode_varint(number)))
    assert list(coding.undelimited(coding.delimited(messages))) == messages


def test_shard_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, "abc"[i % 3], f"t{i}") for i in range(30)], "i int, k string, t string")
    assert {r.shard: r.rows for r in sinks.write_shards(df, f"{tmp_path}/a", "k", order_by=["i"]).collect()} == {"a": 10, "b": 10, "c": 10}
    sizes = sinks.write_hash_shards(df, f"{tmp_path}/b", "i", 4, format="csv").collect()
    assert sum(r.rows for r in sizes) == 30 and all(0 <= r["shard"] < 4 for r in sizes)
    assert sum(r.rows for r in sinks.write_sequence_shards(df, f"{tmp_path}/c", "k", ["i"]).collect()) == 30


def test_memory_sources_and_sinks(spark):
    q = queue.Queue()
    assert sinks.to_queue(spark.range(5), q) == 5
    assert sorted(r.id for r in readers.from_queue(spark, q, "id long").collect()) == list(range(5))
    q.put(ValueError("broken"))
    with pytest.raises(QueueFlowError):
        readers.from_queue(spark, q, "id long")
    qs = [queue.Queue() for _ in range(3)]
    assert sum(sinks.to_queues(spark.range(20), qs, "id")) == 20 and all(list(x.queue)[-1] is readers.END for x in qs)
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, v int, o int")
    assert sinks.to_map(df, "k", "v", "o") == {"a": 2, "b": 3} and len(sinks.to_list(df)) == 3
    done = []
    sinks.consume_all([df, df], finish=lambda: done.append(1))
    assert done == [1] and sinks.identical(df, df) and not sinks.identical(df, df.limit(1))
    assert readers.empty(spark, "x int").count() == 0 and readers.from_rows(spark, iter([(1,)]), "x int").count() == 1
    with pytest.raises(FlowError, match="no luck"), raised():
        readers.failing(spark, "no luck").collect()
    assert [r.item for r in readers.generated(spark, 4, lambda i: i * 2, partitions=2).collect()] == [0, 2, 4, 6]


def test_jdbc(spark):
    url = "jdbc:derby:memory:sluice;create=true"
    spark.range(10).selectExpr("cast(id as int) k", "cast(id * id as int) v").write.format("jdbc").option("url", url).option("dbtable", "t").save()
    assert readers.read_jdbc(spark, url, 'select * from t where "k" > 6').count() == 3
    assert readers.read_jdbc(spark, url, "select * from t", ("k", 0, 10, 3)).rdd.getNumPartitions() == 3


def suppliers(folder, rows):
    """A supplier table of (key, balance); what jdbc_rows has to return of it."""
    frame = pd.DataFrame({"s_suppkey": pd.array([k for k, _ in rows], "Int64"), "s_acctbal": pd.array([None if b is None else repr(b) for _, b in rows], "string")})
    duckdb.sql(f"COPY (SELECT s_suppkey::BIGINT s_suppkey, s_acctbal::DOUBLE s_acctbal FROM frame) TO '{folder}/supplier.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet'")
    return sorted(con.sql(io_catalog.ORACLES["jdbc_rows"]).fetchall(), key=repr)


ON_A_CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
from sluice.plans import io_catalog
folder = sys.argv[1]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse"}
rows = io_catalog.jdbc_rows(SparkSession.builder.config(map=conf).getOrCreate(), folder).collect()
print("ROWS", json.dumps([tuple(r) for r in rows]))
"""


def test_jdbc_rows_on_a_cluster(tmp_path):
    want = suppliers(tmp_path, [(k, k % 1000 - 99.995) for k in range(3000)])
    (tmp_path / "home/work").mkdir(parents=True)  # where the executors work
    for p in Path(pyspark.__path__[0]).iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = {"PYTHONPATH": str(Path(__file__).resolve().parent.parent), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(tmp_path / "home"), "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    run = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, str(tmp_path)], env=os.environ | env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    said = [line[5:] for line in run.stdout.splitlines() if line.startswith("ROWS")]
    assert said, run.stderr[-3000:]
    assert sorted(map(tuple, json.loads(said[0])), key=repr) == want


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(5, None), (None, -1.0)],
        [(None, 2.5)],
        [(1, float("nan")), (2, float("inf")), (3, -float("inf")), (None, float("nan")), (4, 1.0)],
        [(7, 1.5), (7, 1.5), (None, 0.1), (None, None), (-(2**31), 5e-324), (2**31 - 1, 1.7976931348623157e308), (0, -0.0), (3, 0.0), (4, None), (4, 0.1 + 0.2)],
    ],
)
def test_jdbc_rows_of_odd_suppliers(spark, tmp_path, rows):
    want = suppliers(tmp_path, rows)
    assert repr(sorted(map(tuple, io_catalog.jdbc_rows(spark, str(tmp_path)).collect()), key=repr)) == repr(want)  # NaN isn't equal to itself


def test_jdbc_rows_deals_large_keys_evenly(spark, tmp_path):
    want = suppliers(tmp_path, [(k, 1.0) for k in range(20_000, 60_000, 10)])
    parts = io_catalog.jdbc_rows(spark, str(tmp_path)).rdd.glom().map(len).collect()
    assert sum(parts) == len(want) == 4000 and len(parts) == 4 and max(parts) < 1200


def test_derby(spark, tmp_path):
    df = spark.createDataFrame([(1, 2**40, 7), (None, None, None), (3, -1, None)], "a int, B long, c smallint").repartition(5)
    url = sinks.write_derby(df, f"file:{tmp_path}/all", 'own "t"')
    assert sinks.identical(readers.read_jdbc(spark, url, 'select * from "own ""t"""').withColumn("c", F.col("c").cast("smallint")), df)
    one = sinks.write_derby(df.select("a"), f"file:{tmp_path}/one", "T")
    assert sorted((r.a for r in readers.read_jdbc(spark, one, "select * from T").collect()), key=str) == [1, 3, None]
    with pytest.raises(ValueError, match="word"):
        sinks.write_derby(df.selectExpr("'x' as word"), f"file:{tmp_path}/word", "T")
    for odd in ("NaN", "Infinity"):
        with pytest.raises(Exception, match="java.sql.SQL"):
            sinks.write_derby(spark.sql(f"select double('{odd}') as x"), f"file:{tmp_path}/{odd}", "T")


def test_url(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\ntwo\n")
    (tmp_path / "y.gz").write_bytes(gzip.compress(b"three\n"))
    handler = lambda *a: type("H", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *a: None})(*a, directory=str(tmp_path))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert [r.value for r in readers.read_url(spark, f"{base}/x.txt").collect()] == ["one", "two"]
        assert [r.value for r in readers.read_url(spark, f"{base}/y.gz").collect()] == ["three"]
        with pytest.raises(HttpFlowError):
            readers.read_url(spark, f"{base}/none")
    finally:
        server.shutdown()


def test_warehouse(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 as g").createOrReplaceTempView("numbers")
    w = Warehouse(spark)
    q = Query("select id from numbers where g = :g", {"g": 1}, row=lambda r: r.id, result=sorted)
    assert w.execute(q) == [1, 4, 7, 10, 13, 16, 19] == w.execute(q, Options(timeout=60, most_rows=7))
    with pytest.raises(ExcessiveResourcesError):
        w.execute(q, Options(most_rows=6))
    w.create_table("kept", q)
    assert w.table_exists("kept") and not w.table_exists("nothing_there")
    w.export("kept", f"{tmp_path}/out")
    assert w.load(f"{tmp_path}/out", "loaded", "id long", cluster_by=("id", 2)).count() == 7
    with pytest.raises(FlowTimeout):
        scheduling.within(spark, 1.0, lambda: spark.range(1, 2_000_000_000_000, 1, 4).selectExpr("sum(sqrt(id) * sin(id))").collect())


def test_scheduling():
    got = scheduling.balanced([7, 7, 6, 6, 5, 4, 4, 4, 5], 3)
    loads = [sum([7, 7, 6, 6, 5, 4, 4, 4, 5][j] for j in m) for m in got]
    assert sorted(j for m in got for j in m) == list(range(9)) and max(loads) <= 16 * (4 / 3 - 1 / 9)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert scheduling.retried(flaky, first_wait=0.001) == "done" and len(calls) == 3
    with pytest.raises(OSError):
        scheduling.retried(lambda: (_ for _ in ()).throw(OSError()), first_wait=0.001, terminal=lambda e: True)
    assert scheduling.in_parallel(range(5), lambda x: x * x, 3) == [0, 1, 4, 9, 16]
    with pytest.raises(ZeroDivisionError):
        scheduling.in_parallel([1, 0], lambda x: 1 / x)
    time.sleep(0)


def test_scalars(spark):
    df = spark.createDataFrame([("hello", "FFFFFFFF-0000-4000-8000-000000000000", [0.5, 0.5, 0.2]), ("", "00000000-0000-4000-8000-000000000000", [])], "s string, u string, p array<double>")
    a, b = df.select(scalars.java_string_hash("s").alias("h"), scalars.uuid_range_shard("u", 10).alias("u"), F.round(scalars.union_probability(F.col("p")), 6).alias("p"), scalars.shard_of("s", 4).alias("k")).collect()
    assert (a.h, b.h, a.u, b.u, a.p, b.p) == (99162322, 0, 9, 0, 0.8, 0.0) and 0 <= a.k < 4
    r = df.select(scalars.path_parts(F.lit("s3a://b/x/y")).alias("x")).first().x
    assert (r.scheme, r.bucket, r.key) == ("s3a", "b", "x/y")


def test_csv_rows_against_pandas(tmp_path):
    text = 'a,"b\nc",d\r\n"x",,"y""z"\n'
    assert list(readers.csv_rows(text)) == [["a", "b\nc", "d"], ["x", None, 'y"z']]
    (tmp_path / "f.csv").write_text(text)
    assert pd.read_csv(tmp_path / "f.csv", header=None, keep_default_na=False).values.tolist() == [[v or "" for v in r] for r in readers.csv_rows(text)]
