import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.errors import IOFlowError
from sluice.functions import avro, scalars
from sluice.operators import order, quantiles, reduce, rows, shuffle
from sluice.sources import readers, sinks
from sluice.sources.files import Storage

KINDS = {"long": st.integers(-(2**63), 2**63 - 1), "boolean": st.booleans(), "double": st.floats(allow_nan=False), "string": st.text(max_size=9), "bytes": st.binary(max_size=9)}


@st.composite
def typed(draw, depth=2):
    """An Avro schema and a value of it."""
    kind = draw(st.sampled_from([*KINDS, *(["array", "map", "record", "union"] * (depth > 0))]))
    if kind in KINDS:
        return kind, draw(KINDS[kind])
    inner, value = draw(typed(depth - 1))
    if kind == "array":
        return {"type": "array", "items": inner}, [value] * draw(st.integers(0, 3))
    if kind == "map":
        return {"type": "map", "values": inner}, {k: value for k in draw(st.lists(st.text(max_size=4), max_size=3))}
    if kind == "record":
        other, second = draw(typed(depth - 1))
        return {"type": "record", "name": "R", "fields": [{"name": "a", "type": inner}, {"name": "b", "type": other}]}, (value, second)
    if isinstance(inner, list):
        return inner, value
    return ["null", inner], draw(st.sampled_from([None, value]))


@settings(max_examples=150, deadline=None)
@given(typed(), st.sampled_from(["null", "deflate"]))
def test_avro_round_trip(made, codec):
    schema, value = made
    assert list(avro.decode_stream(schema, avro.encode(schema, value) or b"")) in ([value], [])
    assert list(avro.decode_container(avro.encode_container(schema, [value] * 5, codec, block=2))) == [value] * 5


def test_avro_known_bytes():
    # Examples of the format's public specification.
    assert [avro.encode("long", n).hex() for n in (0, -1, 1, -2, 2, -64, 64)] == ["00", "01", "02", "03", "04", "7f", "8001"]
    assert avro.encode("string", "foo").hex() == "06666f6f"
    record = {"type": "record", "name": "test", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}]}
    assert avro.encode(record, {"a": 27, "b": "foo"}).hex() == "3606666f6f"
    assert avro.encode(["null", "string"], "a").hex() == "020261" and avro.encode({"type": "array", "items": "long"}, [3, 27]).hex() == "04063600"
    with pytest.raises(EOFError):
        avro.decode("string", b"\x06fo")
    with pytest.raises(ValueError):
        list(avro.decode_container(b"none"))


def table(spark, seed, n=400):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choice("aabbbc"), rng.choice([None, *range(30)])) for i in rng.sample(range(n * 3), n)], "i long, f string, v long").repartition(5)


def test_skip_counts_ranges(spark):
    df = table(spark, 1)
    want = sorted(r.i for r in df.collect())
    for k in (0, 1, 57, 399, 400, 500):
        assert [r.i for r in order.skip(df, k, "i").collect()] == want[k:]
    assert [r.i for r in order.skip(df, 5, F.desc("i")).collect()] == want[::-1][5:]
    assert order.skip(df.limit(0), 3, "i").count() == 0


def test_runs_without_partitions_like_a_loop(spark):
    for df in (table(spark, 2), table(spark, 3).withColumn("f", F.lit(None).cast("string")), table(spark, 4).limit(0)):
        got = [(r.i, r.run) for r in reduce.run_ids(df, "f", ["i"]).orderBy("i").collect()]
        want, last, run = [], object(), 0
        for r in sorted(df.collect(), key=lambda r: r.i):
            run += r.f != last
            last = r.f
            want.append((r.i, run))
        assert got == want


def test_percentile_of_all_like_sorting(spark):
    df = table(spark, 5)
    values = sorted(r.v for r in df.collect() if r.v is not None)
    for p in (0.0, 0.1, 0.5, 0.77, 1.0):
        rank = max(1, int(p * len(values) + 0.5))
        assert quantiles.percentile(df, "v", p).first()[0] == values[rank - 1]
    assert quantiles.percentile(df.limit(0), "v", 0.5).collect() == [(None,)]


def test_order_is_checked_between_ranges(spark):
    df = table(spark, 6)
    assert rows.validate_order(df, ["i"], "i").count() == 400
    rising = df.withColumn("k", F.floor(F.col("i") / 7))
    assert rows.validate_order(rising, ["k"], "i").count() == 400
    most = df.agg(F.max("i")).first()[0]
    for at in (most, most // 2):
        wrong = df.withColumn("k", F.when(F.col("i") >= at, -1).otherwise(F.col("i")))
        with pytest.raises(Exception, match="OUT_OF_ORDER"):
            rows.validate_order(wrong, ["k"], "i").count()
    assert rows.validate_order(df.limit(0), ["i"], "i").count() == 0


def test_dealing_by_shard(spark):
    df = spark.range(100).withColumn("s", (F.col("id") % 4).cast("int"))
    assert shuffle.with_shard(shuffle.deal(df, 4, shard=F.col("s"))).where("s <> shard").count() == 0
    with pytest.raises(Exception, match="VALIDATION"):
        shuffle.deal(df, 3, shard=F.col("s")).count()


def test_writers_and_iterators(spark, tmp_path):
    out = io.StringIO()
    assert sinks.to_writer(spark.createDataFrame([("b",), (None,), ("a",)], "value string"), out, order_by=["value"]) == 3
    assert out.getvalue() == "\na\nb\n"
    assert readers.from_rows(spark, ((i,) for i in range(25)), "i int", at_once=10).agg(F.sum("i"), F.count("i")).first()[:] == (300, 25)
    assert readers.from_rows(spark, iter([]), "i int").count() == 0
    assert sinks.to_map(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), "k", "v") == {1: "b"}


def test_storage_helpers(spark, tmp_path):
    s, root = Storage(spark), f"file:{tmp_path}"
    s.in_parallel("put", [(f"{root}/a/{i}.txt", b"x" * (i % 2)) for i in range(6)])
    assert s.identical(f"{root}/a/0.txt", f"{root}/a/2.txt") and not s.identical(f"{root}/a/0.txt", f"{root}/a/1.txt")
    packed = s.compress_folder(f"{root}/a", f"{root}/b")
    assert len(packed) == 6
    s.decompress(f"{root}/b/3.txt.gz", f"{root}/c.txt")
    assert s.get(f"{root}/c.txt") == b"x"
    with pytest.raises(IOFlowError):
        s.retried("list", f"{root}/none")


def test_estimator_and_random(spark):
    e = quantiles.WindowEstimator(100)
    assert isinstance(e, quantiles.QuantileEstimator)
    for i in range(1000):
        e.add(i)
    assert (e.size(), e.quantile(0.5), e.quantile(0.0), e.quantile(1.0), e.cdf(949)) == (100, 949, 900, 999, 0.5)
    got = [r.r for r in spark.range(2000).select(scalars.fast_random("id", 1).alias("r")).collect()]
    assert got == [r.r for r in spark.range(2000).select(scalars.fast_random("id", 1).alias("r")).collect()]
    assert min(got) >= 0 and max(got) < 1 and abs(sum(got) / 2000 - 0.5) < 0.03
