import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["", None, "it's we'll they've I'm o'clock 's ''s x'd'd 'S don'T", "a  b   c\n\nd \n e\t\tf  ", " lead", "trail ", " x　y", "<|endoftext|> a<|endoftext|>",
       "12 345a6 7.8,9", "é ê über straße ñandú", "日本語 テキスト", "😀😀 !?", "x" * 3000, "!" * 500, "'", "a'", "'re", " 're", "\r\n", "a\x1cb", "٣٤ ٥", "ⅷ²½"]


def test_ids_equal_the_library():
    assert tokens.encode_texts(PATH, ODD) == library(ODD)
    rng = random.Random(1)
    texts = ["".join(rng.choices(["'", "s", "ll", " ", "  ", "\n", "é", "7", "!", "re", "the", " ", "ß"], k=rng.randint(0, 60))) for _ in range(400)]
    assert tokens.encode_texts(PATH, texts) == library(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_ids_equal_the_library_on_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert tokens.encode_texts(PATH, texts) == library(texts)


def fewest(items, capacity):
    """Brute force: the fewest bins."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                j = bins.index(room)
                go(i + 1, bins[:j] + [room - items[i]] + bins[j + 1 :])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_plan_is_near_the_optimum_and_whole(items):
    counts = {v: items.count(v) for v in set(items)}
    runs, n = packing.plan(counts, 12)
    bins, ranks = {}, {}
    for r in runs:
        for k in range(r.count):
            bins.setdefault(r.sequence + k // r.per, []).append((r.offset + k % r.per * r.length, r.length))
            ranks.setdefault(r.length, []).append(r.first + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 12
    assert sorted(bins) == list(range(n))
    assert n <= (fewest(items, 12) * 3 + 1) // 2


@pytest.mark.parametrize("sets", [{8: 3, 4: 3}, {9: 2, 5: 1, 4: 2}, {12: 1}, {7: 5}])
def test_reduction_keeps_the_optimum(sets):
    items = [v for v, n in sets.items() for _ in range(n)]
    assert packing.plan(sets, 12)[1] == fewest(items, 12)


def test_pack(spark):
    rng = random.Random(2)
    texts = [None, "", "long words " * 4000, *["same text here"] * 50, *(" ".join(rng.choices(["the", "of", "ab'c", "é"], k=rng.randint(0, 300))) for _ in range(200))]
    docs = spark.createDataFrame([(i if i % 9 else 9, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, piece string, rank int")
    out = packing.pack(packing.pieces(docs, PATH)).collect()
    want = {}
    for i, ids in enumerate(library(texts)):
        ids, at, k = np.array([*ids, 0], "<u4"), 0, 0
        while at < len(ids):
            size = len(ids) if len(ids) <= 2048 else (len(ids) % 2048 or 2048) if at == 0 else 2048
            key = (i if i % 9 else 9, k, at, size, zlib.crc32(ids[at : at + size].tobytes()))
            want[key] = want.get(key, 0) + 1
            at, k = at + size, k + 1
    got = {}
    for r in out:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in out) // 2048) + 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs, PATH)).count() == 0
