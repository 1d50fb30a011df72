import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import lm_scoring as S


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def corpus():
    rng = random.Random(6)
    vocabulary = ["the", "The", "of", "é", "É", "x.", "one", "two", "three", "four five", "\x1c"]
    rows = [(i, rng.choice([" ", "\n", "\t  "]).join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 60)))) for i in range(150)]
    return [*rows, (None, "the of"), (7, None), (7, ""), (3, "rare words only here"), (3, "rare words only here"), (900, "long " * 30000)]


def brute(rows, added=S.ADDED, masses=S.MASSES):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    one, two, three, starts = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            one.update(w)
            two.update(zip(["^", *w], w))
            three.update(zip(["^", "^", *w], ["^", *w], w))
            starts += 1
    n, v = sum(one.values()), len(one)
    one_or_start = lambda a: starts if a == "^" else one[a]
    two_or_start = lambda a, b: starts if b == "^" else two[a, b]
    out = []
    for i, t in rows:
        w = tokens(t)
        base = [(one[x] + added) / (n + added * (v + 1)) for x in w]
        second = [(two[a, x] + masses[0] * p) / (one_or_start(a) + masses[0]) for a, x, p in zip(["^", *w], w, base)]
        full = [(three[a, b, x] + masses[1] * p) / (two_or_start(a, b) + masses[1]) for a, b, x, p in zip(["^", "^", *w], ["^", *w], w, second)]
        out.append((i, held(i), len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return out


def close(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) <= 1e-9 * max(1, abs(w[5]))
        # Up to two weights and a probability are rounded for each token.
        assert abs(g[6] - w[6]) <= 1.5 * w[2] / S.STEPS + 1e-9


def test_like_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in corpus()], "doc_id long, text string, chunk string, train int, crc string")
    close([tuple(r) for r in S.score(docs).collect()], brute(corpus()))


def test_the_context_helps_held_out_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the cat sat", "a dog ran", "one fish swam"]) for _ in range(40))) for i in range(300)]
    out = S.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert np.mean([r.score > r.base_score for r in out]) > 0.9


@pytest.mark.parametrize("masses", [(0.5, 0.1), (300.0, 40.0)])
def test_other_masses_like_brute_force(spark, masses):
    docs = spark.createDataFrame(corpus()[:-1], "doc_id long, text string")
    close([tuple(r) for r in S.score(docs, masses=masses).collect()], brute(corpus()[:-1], masses=masses))


def test_the_definition_sums_to_one():
    rows = corpus()[:-1]
    assert all(abs(total - 1) < 1e-9 for *_, total in brute_probabilities(rows, [("the", "of"), ("x.", "é"), ("one", "nosuch"), ("nosuch", "the")]))


def brute_probabilities(rows, contexts):
    """For each context, the sum of the definition's probabilities over the training words, the end and one unseen word."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [tokens(t) for i, t in rows if not held(i)]
    one, two, three = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(["^", *w], w)), Counter(p for w in train for p in zip(["^", "^", *w], ["^", *w], w))
    n, v = sum(one.values()), len(one)
    for i, (a, b) in enumerate(contexts):
        total = 0.0
        for x in [*one, "\x00never"]:
            p = (one[x] + S.ADDED) / (n + S.ADDED * (v + 1))
            p = (two[b, x] + S.MASSES[0] * p) / (sum(c for (l, _), c in two.items() if l == b) + S.MASSES[0])
            total += (three[a, b, x] + S.MASSES[1] * p) / (sum(c for (k, l, _), c in three.items() if (k, l) == (a, b)) + S.MASSES[1])
        yield i, a, b, total


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.score(docs).count() == 0
    rows = [(0, "some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    close([tuple(r) for r in S.score(docs, held_out="true").collect()], [(0, True, 3, 0, 0, -3 * math.log10(1.0), -3 * math.log10(1.0))])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50, unique=True), st.lists(st.integers(0, 2**40), max_size=50))
def test_packed_lists(keys, counts):
    keys = np.array(sorted(keys), np.uint64)
    assert S.unpack_sorted(S.pack_sorted(keys)).tolist() == keys.tolist()
    assert S.unpack_counts(S.pack_counts(np.array(counts, np.int64))).tolist() == counts


@pytest.mark.parametrize("ranges", [1, 7])
def test_ranges_cover_all_hashes(ranges):
    keys = np.sort(np.random.default_rng(1).integers(0, 2**S.BITS - 1, 100, dtype=np.uint64))
    cuts = S._range_cuts(keys, ranges)
    assert (np.diff(cuts) >= 0).all() and cuts[0] == 0 and cuts[-1] == 100 and len(cuts) == ranges + 1


def test_an_unseen_ngram_with_the_hash_of_a_seen_one():
    """Some five stand under unseen contexts at 6 GB, by the counts of 0.1 GB, and hardly any at 0.5 GB."""
    rows = [*corpus()[:-1], (1000, "new1 new2 new3 the new1 of")]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 and i != 1000 for i, _ in rows]
    docs = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "train": train, "chunk": pa.array([0] * len(rows), pa.int32())})
    answers = S._answers(S._requests(docs, 1))
    want = S._scores(docs, answers, S.ADDED, S.MASSES)
    grams = S.grams_of(*S.tokens_of(docs.column("text")))
    totals = S._totals(grams, answers)
    shared = 0
    for n in range(1, S.ORDER):
        lost = (np.append(totals[n - 1], 1)[grams.context[n]] == 0) | (totals[0][grams.word[n]] == 0)
        shared += int(lost.sum())
        totals[n][lost] = 3
    assert shared >= 8
    blobs = [S.pack_counts(t[np.argsort(k)]) for t, k in zip(totals, grams.key)]
    answers = answers.set_column(answers.schema.get_field_index("totals"), "totals", pa.array([blobs], pa.list_(pa.binary())))
    assert S._scores(docs, answers, S.ADDED, S.MASSES).equals(want)


@pytest.mark.parametrize("bits", [16, 20, 24])
def test_many_shared_hashes_lose_no_row(monkeypatch, bits):
    """With so few bits n-grams share counts as they do in large corpora; each row still gets a score, no probability is above one."""
    rng = random.Random(bits)
    texts = [" ".join(str(rng.randrange(2000)) for _ in range(60)) for _ in range(400)]
    docs = pa.table({"doc_id": range(400), "text": texts, "train": [i % 5 > 0 for i in range(400)], "chunk": pa.array([0] * 400, pa.int32())})
    monkeypatch.setattr(S, "BITS", bits)
    asked = S._requests(docs, 3)
    answers = pa.concat_tables([S._answers(asked.slice(r, 1)) for r in range(3)])
    out = S._scores(docs, answers, S.ADDED, S.MASSES)
    assert out.column("doc_id").to_pylist() == list(range(400))
    grams = S.grams_of(*S.tokens_of(docs.column("text")))
    totals = S._bounded(grams, S._totals(grams, answers.sort_by("part")), 320)
    for n in range(1, S.ORDER):
        assert (totals[n] <= np.append(totals[n - 1], 320)[grams.context[n]]).all()
        assert (totals[n] <= totals[n - 1][S._below(grams, n)]).all()
