import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import jaccard_join as J
from sluice.llm.components import components


def grams(text, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(linked[i])))
    return sorted(out, key=str)


def sample():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows = []
    for i in range(40):
        base = text(rng.randint(30, 120))
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", ", "]).join(near).upper()))
    hot = text(90)
    for i in range(120):  # near copies of one text
        near = list(hot)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(90)] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(near)))
    passage = text(25)
    rows += [(len(rows) + i, " ".join(passage + text(60))) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, "... !"), (1003, "two words"), (1004, "Two, words"), (1005, "other words"), (None, rows[0][1]), (None, "nobody has this id at all"), (5, rows[5][1]), (5, "same id another text entirely here")]
    rows += [(2000 + i, "exact copies of one and the same text here") for i in range(70)]
    return rows


@pytest.mark.parametrize("block", [16, 512])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(J, "VERIFY_BLOCK", block)
    rows = sample()
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, key int, h string, n string")
    out = J.join(docs).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in out], key=str) == brute(rows)
    leaders = [(r.class_id, r.h) for r in out if r.leads and r.class_id is not None]
    assert len(leaders) == len(set(leaders)) and {c for c, _ in leaders} == {r.class_id for r in out if r.class_id is not None}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(docs).count() == 0
    docs = spark.createDataFrame([(1, None)], docs.schema)
    assert [tuple(r)[2:] for r in J.join(docs).collect()] == [(1, 0, True)]


def test_pruning_follows_the_posterior():
    from math import comb

    for t, need in zip(range(J.STEP, J.HASHES + 1, J.STEP), J.least_matches()):
        # Numerical posterior under a uniform prior.
        x = (np.arange(200_000) + 0.5) / 200_000
        for s, kept in ((need - 1, False), (need, True)):
            density = comb(t, s) * x**s * (1 - x) ** (t - s)
            assert (density[x >= 0.8].sum() / density.sum() >= J.TOLERANCE) == kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=25, unique=True), min_size=2, max_size=12))
def test_intersections(sets):
    sets = [np.array(sorted(s), np.uint64) for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]
    assert J.intersections(sets, i, j).tolist() == want
    assert J.intersections(sets, i[:1], j[:1]).tolist() == want[:1]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
