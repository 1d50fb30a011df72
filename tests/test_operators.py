import datetime as dt
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.errors import ExcessiveResourcesError, OutOfOrderError, raised
from sluice.operators import order, quantiles, reduce, rows, setops


def col(df, name=None):
    return [r[name or df.columns[0]] for r in df.collect()]


def ints(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} int")


def words(spark, text):
    return spark.createDataFrame([(i, w) for i, w in enumerate(text.split())], "i int, w string")


def test_word_count(spark):
    got = {r.w: r.n for r in reduce.reduce_by(words(spark, "why who what when why what what"), ["w"], n=F.count(F.lit(1))).collect()}
    assert got == {"what": 3, "when": 1, "who": 1, "why": 2}


RUNS = [1, 1, 2, 2, 2, 4, 4, 4, 4, 8, 8, 8, 8, 8]


def test_runs(spark):
    df = ints(spark, RUNS)
    assert [len(x) for x in col(reduce.collect_runs(df, "v", "i", ["i"]).orderBy("run"), "items")] == [2, 3, 4, 5]
    assert [len(x) for x in col(reduce.collect_runs(df, "v", "i", ["i"], limit=3).orderBy("run"), "items")] == [2, 3, 3, 3]
    with pytest.raises(ExcessiveResourcesError), raised():
        reduce.collect_runs(df, "v", "i", ["i"], limit=3, fail=True).collect()
    again = ints(spark, [1, 1, 2, 1])
    assert sorted((r.v, r.n) for r in reduce.reduce_runs(again, "v", ["i"], n=F.count(F.lit(1))).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_opaque_functions(spark):
    df = words(spark, "b a b")
    out = reduce.reduce_opaque(df, ["w"], lambda f: f.groupby("w", as_index=False).agg(n=("i", "sum")), "w string, n long")
    assert {r.w: r.n for r in out.collect()} == {"a": 1, "b": 2}
    assert sorted(col(rows.map_opaque(df, lambda f: f.assign(w=f.w.str.upper())[["w"]], "w string"))) == ["A", "B", "B"]


def test_distinct_group_count(spark):
    assert sorted(col(reduce.distinct(words(spark, "a c c A a b c a A").select("w")))) == ["A", "a", "b", "c"]
    df = words(spark, "what be a bee all where ball").withColumn("n", F.length("w"))
    parts = reduce.group_contiguous(df, ["n"], ["i"]).withColumn("p", F.spark_partition_id()).collect()
    seen, last = set(), None
    for r in parts:
        assert r.n == last or r.n not in seen
        seen.add(r.n)
        last = r.n
    assert [r.w for r in parts if r.n == 3] == ["bee", "all"]
    assert col(reduce.count(df.where("false"))) == [0]


def test_order(spark):
    fruit = spark.createDataFrame([("Banana", 20), ("Apple", 15), ("Pear", 20), ("Grapes", 2), ("Apple", 15)], "name string, count int")
    assert col(order.sort(fruit, "count"), "count") == [2, 15, 15, 20, 20]
    v = ints(spark, [9, 3, 3, 7, 3, 7, 2, 6, 4, 1])
    assert col(order.top_k(v, 3, F.desc("v")), "v") == [9, 7, 7]
    assert col(order.top_k(ints(spark, [9, 3, 7, 7]), 5, F.desc("v")), "v") == [9, 7, 7, 3]
    assert col(order.top_k(v, 0, F.desc("v"))) == [] and col(order.head(v, 2, "i"), "v") == [9, 3]
    assert col(order.skip(v, 7, "i"), "v") == [6, 4, 1]
    assert col(order.skip(v, 20, "i")) == []


def test_samplers(spark):
    df = spark.range(10_000).toDF("i")
    got = col(order.sample_exact(df, 150, 3, ["i"]))
    assert len(set(got)) == 150 and got == sorted(got)
    assert len(order.sample_exact(df, 20_000, 3).collect()) == 10_000
    assert abs(order.sample_share(df, 0.2, 5).count() / 10_000 - 0.2) < 0.05
    a, b = (set(col(order.sample_consistent(x, "i", 0.3))) for x in (df, df.where("i % 2 = 0")))
    assert b <= a and abs(len(a) / 10_000 - 0.3) < 0.05


def test_set_operations(spark):
    a, b = ints(spark, [1, 2, 3, 4, 5, 6, 6]).select("v"), ints(spark, [2, 4, 6, 8, 10]).select("v")
    assert col(setops.union([a, b], True)) == [1, 2, 3, 4, 5, 6, 8, 10]
    assert col(setops.intersect([a, b], True)) == [2, 4, 6] and col(setops.intersect([a], True)) == [1, 2, 3, 4, 5, 6]
    assert col(setops.intersect([], spark=spark, schema="v int")) == []
    assert col(setops.subtract(a, b, True)) == [1, 3, 5]
    assert col(setops.merge([a, b], "v")) == [1, 2, 2, 3, 4, 4, 5, 6, 6, 6, 8, 10]
    assert sorted(col(setops.by_membership([a, b], lambda t: F.size(t) == 1))) == [1, 3, 5, 8, 10]
    assert [r.input for r in setops.concat([b, a]).collect()] == [0] * 5 + [1] * 7


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 5), max_size=6), min_size=1, max_size=3))
def test_set_operations_like_sets(spark, inputs):
    frames = [ints(spark, v).select("v") for v in inputs]
    assert col(setops.union(frames, True)) == sorted(set().union(*inputs))
    assert col(setops.intersect(frames, True)) == sorted(set.intersection(*map(set, inputs)))


@pytest.mark.parametrize("p,want", [(0, 1), (0.3333, 3), (0.5, 4), (1, 5)])
def test_percentile(spark, p, want):
    df = spark.createDataFrame([(w,) for w in ["hello", "Alex", "I", "miss", "you", "dude"]], "s string")
    assert col(quantiles.percentile(df, F.length("s"), p)) == [want]


def test_percentile_edges(spark):
    assert col(quantiles.percentile(spark.range(1, 101), "id", 0.25)) == [25]
    assert col(quantiles.percentile(ints(spark, [1, 3, 4, 4, 4, 5]), "v", 0.2)) == [1]
    assert col(quantiles.percentile(ints(spark, []), "v", 0.2)) == [None]
    with pytest.raises(ValueError):
        quantiles.percentile(ints(spark, []), "v", 1.2)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), min_size=1, max_size=12), st.floats(0, 1))
def test_percentile_like_the_definition(spark, values, p):
    rank = max(1, math.floor(p * len(values) + 0.5))
    assert col(quantiles.percentile(ints(spark, values), "v", p)) == [sorted(values)[rank - 1]]


def test_sketch_ranks(spark):
    rng = random.Random(4)
    values = sorted([rng.gauss(500, 100) for _ in range(10_000)] + [rng.gauss(700, 100) for _ in range(10_000)])
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "g int, x double")
    merged = quantiles.merge(quantiles.sketch(df, "x", ["g"], 800))
    qs = [q / 100 for q in range(2, 100, 7)]
    row = merged.select(*(quantiles.quantile(q) for q in qs), *(quantiles.cdf(values[int(q * 20_000)]) for q in qs)).first()
    for i, q in enumerate(qs):
        assert abs(sum(v <= row[i] for v in values) / 20_000 - q) < 0.01
        assert abs(row[len(qs) + i] - q) < 0.01
    assert quantiles.weighted(ints(spark, [2, 0, 3]), "v").count() == 5


def test_fold_and_rows(spark):
    df = ints(spark, [3, 1, 2]).withColumn("g", F.lit("x"))
    assert col(reduce.fold(df, ["g"], "v", ["i"], F.lit(0), lambda a, v: a * 10 + v), "result") == [312]
    assert col(rows.flat_map(spark.createDataFrame([("a b",), ("",), (None,)], "s string"), F.split("s", " ")), "item") == ["a", "b", ""]
    assert sorted(col(rows.filter_rows(df, "v > 1"), "v")) == [2, 3]
    seen = []
    out, metrics = rows.observed(df, n=F.count(F.lit(1)), top=F.max("v"))
    out.collect()
    assert metrics.get == {"n": 3, "top": 3}
    kept = rows.tee(df, lambda d: seen.append(d.count()))
    assert seen == [3] and kept.count() == 3
    rows.for_each(df, lambda r: None, lambda: seen.append("end"))
    assert seen[-1] == "end"


def test_order_validation(spark):
    assert rows.validate_order(ints(spark, [1, 1, 2]), ["v"], "i").count() == 3
    with pytest.raises(OutOfOrderError), raised():
        rows.validate_order(ints(spark, [1, 3, 2]), ["v"], "i").collect()


def test_progress(spark):
    steps = []
    p = rows.ProgressSteps(steps.append, 10, 50, 10)
    for share in (0, 0.1, 0.3, 0.3, 0.2, 1.0):
        p(share)
    assert steps == [10, 20, 50]
    steps.clear()
    assert rows.with_progress(spark.range(1000), lambda d: d.count(), steps.append, 0.01) == 1000
    assert steps[0] == 0 and steps[-1] == 100 and steps == sorted(set(steps))


def test_windows(spark):
    from sluice.streaming import windows

    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(t + dt.timedelta(minutes=m), "a", float(m)) for m in (0, 5, 12, 31)], "ts timestamp, k string, value double")
    got = {r.window_start: (r.events, r.average) for r in windows.sliding_average(ev, "ts", "value", "20 minutes", "10 minutes").collect()}
    assert got[t] == (3, 5.666667) and got[t + dt.timedelta(minutes=10)] == (1, 12.0)
    assert [r.value for r in windows.last_values(ev, "ts", 2).collect()] == [31.0, 12.0]
    assert sorted(r.value for r in windows.last_values(ev, "ts", 1, ["k"]).collect()) == [31.0]
    q = windows.sliding_quantiles(ev, "ts", "value", "10 minutes", 2, [0.5]).orderBy("window_start").collect()
    assert [r.q50 for r in q] == [0.0, 5.0, 31.0]


def test_streams(spark, tmp_path):
    from sluice.streaming import windows

    t = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, k string, value double"
    for i in range(3):
        spark.createDataFrame([(t + dt.timedelta(minutes=10 * i + j), "ab"[j % 2], float(10 * i + j)) for j in range(4)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = windows.stream_of(spark, f"{tmp_path}/in", schema, files_a_batch=1)
    got = []
    q = windows.each_batch(stream, lambda df, n: got.append(df.count()), f"{tmp_path}/c1", once=True)
    q.awaitTermination(60)
    assert got == [4, 4, 4]
    rates = windows.sliding_rate(stream, "ts", "10 minutes", "10 minutes", 10, late="1 minute")
    batch = windows.sliding_rate(spark.read.schema(schema).parquet(f"{tmp_path}/in"), "ts", "10 minutes", "10 minutes", 10)
    q = rates.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))
    out = {}
    last = windows.last_values_stream(stream, "k", "ts", "value", 3)

    def keep(df, _):
        out.update({r.k: r["values"] for r in df.collect()})

    q = last.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert out == {"a": [12.0, 20.0, 22.0], "b": [13.0, 21.0, 23.0]}
