import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import sharding

SCHEMA = "text string, doc_id long, h string, shard string, size string"


def rows_of(spark, texts):
    return spark.createDataFrame([(t, i if i % 7 else 7, "x", "y", None) for i, t in enumerate(texts)], SCHEMA)


def best_capacity(sizes, shards):
    """Brute force over all contiguous partitions, by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=14), st.integers(1, 5))
def test_cuts_reach_the_brute_force_optimum(sizes, shards):
    ranges = [sharding.Range(i, 12, s, 1) for i, s in enumerate(sizes)]
    cuts, refine, capacity = sharding.minimax_cuts(ranges, shards)
    assert not refine and len(cuts) == shards - 1
    bounds = [0, *cuts, sum(sizes)]
    if sizes:
        assert max(b - a for a, b in zip(bounds, bounds[1:])) <= capacity == best_capacity(sizes, shards)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_are_whole_and_gapless(spark, shards):
    texts = [None, "", "a" * 5000, *(f"text {i % 90} é" * (1 + i % 5) for i in range(400)), *["copy"] * 300]
    out = sharding.shard(rows_of(spark, texts), shards=shards).collect()
    assert len(out) == len(texts)
    by, crc = {}, {}
    for r in out:
        by.setdefault(r["shard"], []).append(r.slot)
        crc.setdefault(r.text_crc32, set()).add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(len(v) == 1 for v in crc.values())
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)


def test_capacity_is_the_optimum_over_hash_order(spark):
    texts = [f"{i}" * (1 + i * i % 37) for i in range(60)]
    out = sharding.shard(rows_of(spark, texts), shards=4)
    sized = {}
    for r in out.collect():
        sized[r["shard"]] = sized.get(r["shard"], 0) + r["size"]
    from pyspark.sql import functions as F

    order = [r.s for r in rows_of(spark, texts).select(F.xxhash64("text").alias("x"), (F.octet_length("text") + 8).alias("s")).orderBy("x").collect()]
    assert max(sized.values()) == best_capacity(order, 4)


def test_empty_table(spark):
    assert sharding.shard(rows_of(spark, []), shards=3).count() == 0
