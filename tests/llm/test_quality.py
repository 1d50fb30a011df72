import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sluice.llm import kernels as K
from sluice.llm import quality as Q
import pyarrow as pa


def text(rng, good):
    words = ["".join(rng.choices(["on", "er", "the", "st", "a", "in"], k=rng.randint(1, 3))) for _ in range(rng.randint(40, 90))]
    if good:
        words[::9] = [w + "." for w in words[::9]]
        return " ".join(words).capitalize() + "."
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w for w in words[:6] for _ in range(12))
    return " ".join(w + rng.choice(["%%%", "$$$", "&&&"]) for w in words)


def test_accuracies_are_recovered():
    rng = np.random.default_rng(3)
    truth = rng.random(40_000) < 0.7
    accuracy, cover = [0.9, 0.75, 0.85, 0.6, 0.8], [0.9, 0.8, 0.5, 0.9, 0.7]
    votes = np.full((len(truth), 5), -1)
    for j, (a, c) in enumerate(zip(accuracy, cover)):
        right = rng.random(len(truth)) < a
        votes[:, j] = np.where(rng.random(len(truth)) < c, np.where(right, truth, ~truth), -1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.expectation_maximisation(patterns, counts.astype(float), rounds=500)
    assert abs(model.prior - 0.7) < 0.03
    for j, a in enumerate(accuracy):
        good = model.rates[j, 1]
        assert abs(good[2] / (good[1] + good[2]) - a) < 0.04
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > ((votes == 1).sum(1) > (votes == 0).sum(1)).__eq__(truth).mean() - 0.005


def test_posterior_is_bayes():
    model = Q.expectation_maximisation(np.array(list(itertools.product([-1, 0, 1], repeat=2))), np.arange(1.0, 10.0))
    for v in itertools.product([-1, 0, 1], repeat=2):
        p = [model.prior if c else 1 - model.prior for c in range(2)]
        for j, x in enumerate(v):
            p = [p[c] * model.rates[j, c, x + 1] for c in range(2)]
        assert abs(model.posterior(np.array([v]))[0] - p[1] / sum(p)) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=20), max_size=5))
def test_features_are_the_tokens_and_pairs_of_each_text(texts):
    ids, begin = Q.features(*K.utf8(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        n = len(t.split())
        own = ids[begin[i] : begin[i + 1]]
        assert len(own) == 3 * n
        alone, _ = Q.features(*K.utf8(pa.array([t])))
        assert own.tolist() == alone.tolist()


def test_held_out_accuracy_and_edge_rows(spark):
    rng = random.Random(7)
    truth = {i: rng.random() < 0.75 for i in range(500)}
    rows = [(i, text(rng, g), "x", 0.5) for i, g in truth.items()] + [(900, None, "", 0.0), (901, "", "", 0.0), (None, "One two three.", "", 0.0), (902, "word " * 30000, "", 0.0), (902, "word " * 30000, "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string, score double")
    out = Q.classify(docs, sample_rows=400).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert np.mean([got[i].good == g for i, g in truth.items()]) > 0.93
    assert np.mean([(got[i].weak_label >= 0.5) == g for i, g in truth.items()]) > 0.95
    assert got[900].votes == got[901].votes and not got[902].weak_label >= 0.5


def test_empty(spark):
    assert Q.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_sample_is_the_first_rows_of_each_kind(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, text(rng, i % 2 == 0)) for i in range(9_000)]
    seen = []
    monkeypatch.setattr(Q, "train_scorer", lambda texts, labels: seen.append((texts, labels)) or Q.Scorer(np.zeros(1 << Q.BITS), 0.0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    Q.classify(docs)
    Q.classify(docs, sample_bytes=100_000)
    for kind in (seen[0][1] >= 0.5, seen[0][1] < 0.5):
        assert kind.sum() == 3_000
    for kind in (True, False):
        sizes = [len(t.encode()) for t, p in zip(*seen[1]) if (p >= 0.5) == kind]
        assert sum(sizes) - sizes[-1] < 50_000 <= sum(sizes)
    places = {r.text: r.p for r in docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(Q.PLACES)).alias("p")).collect()}
    order = [places[t] for t in seen[1][0]]
    assert order == sorted(order)


def test_weak_labels_like_votes_counted_by_hand(spark):
    texts = ["", "One two.", "HELLO THERE!! " * 20, "word " * 60, "a %%% b $$$ " * 9, "It is a plain text. It has an end. " * 6, "12345 67890 " * 30, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def votes(t):
        t = t or ""
        share = lambda a, b: a / max(b, 1)
        vote = lambda bad, good: 0 if bad else 1 if good else -1
        words, letters = len(re.split(r"\s+", t.strip())), sum(c.isalpha() for c in t)
        capitals, ends = sum(c.isupper() for c in t), t.count(".")
        symbols = len(re.sub(r"[^\W_]|[\s.,;:'’()\"-]", "", t))
        own = re.split(r"\s", t)
        doubled = share(sum(len(a) for a, b in zip(own, own[1:]) if a == b and a.isalpha()), letters)
        return [
            vote(len(t) < 20, 40 <= words <= 20_000), vote(share(symbols, len(t)) > 0.05, share(symbols, len(t)) < 0.01 and letters > 0),
            vote(share(capitals, letters) > 0.4, 0.001 <= share(capitals, letters) <= 0.1), vote(doubled > 0.2, doubled < 0.02 and words > 20),
            vote(share(letters, len(t)) < 0.5, share(letters, len(t)) > 0.7), vote(ends == 0 and words > 30, 0.02 <= share(ends, words) <= 0.25),
        ]

    got = {r.doc_id: r for r in Q.classify(docs).collect()}
    want = [votes(t) for t in texts]
    assert [got[i].votes for i in range(len(texts))] == want
    patterns, counts = np.unique(np.array(want), axis=0, return_counts=True)
    model = Q.expectation_maximisation(patterns, counts.astype(float))
    assert np.allclose([got[i].weak_label for i in range(len(texts))], model.posterior(np.array(want)), atol=1e-6)
