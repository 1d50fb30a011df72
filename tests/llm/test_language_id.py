import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sluice.llm import kernels as K
from sluice.llm import language_id as L

SYLLABLES = {"aa": ["the", "ing", "on", "er", "wh", "st"], "bb": ["der", "sch", "ung", "ü", "ein", "ß"], "cc": ["que", "ción", "los", "ar", "ñ", "ja"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def corpus(n=240):
    rng = random.Random(4)
    return [(i, speech(rng, lang, rng.randint(1, 80)), lang) for i in range(n) for lang in [rng.choice(sorted(SYLLABLES))]]


def brute_probability(texts, order):
    """Interpolated Kneser-Ney by its definition, from strings: a function of history and character."""
    clean = [" " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) for t in texts]
    clean = [t + " " if not s[-1].isalpha() else t for t, s in zip(clean, texts)]
    grams = [{} for _ in range(order + 1)]
    for t in clean:
        for n in range(1, order + 1):
            for i in range(len(t) - n + 1):
                grams[n][t[i : i + n]] = grams[n].get(t[i : i + n], 0) + 1
    tables = {order: grams[order]}
    for n in range(order - 1, 0, -1):
        tables[n] = {}
        for g in tables[n + 1]:
            tables[n][g[1:]] = tables[n].get(g[1:], 0) + 1
        for g in grams[n]:
            if g[0] == " " and n > 1:
                tables[n].setdefault(g, 1)
    size = len(grams[1]) + 1

    def p(history, c):
        n = len(history) + 1
        t = tables[n]
        ones, twos = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        follow = {g: v for g, v in t.items() if g[:-1] == history}
        lower = 1 / size if not history else p(history[1:], c)
        if not follow:
            return lower
        total = sum(follow.values())
        return max(follow.get(history + c, 0) - d, 0) / total + d * len(follow) / total * lower

    return p, size


def test_entropies_equal_the_definition():
    rng = random.Random(1)
    texts = {lang: [speech(rng, lang, 12) for _ in range(4)] for lang in ("aa", "bb")}
    model = L.train(texts, order=3)
    probes = [texts["aa"][0], speech(rng, "bb", 5), "zzz the ñ", "Ж ing"]
    entropy, size = model.entropies(*K.utf8(pa.array(probes)))
    for j, lang in enumerate(model.languages):
        p, _ = brute_probability(texts[lang], 3)
        for i, t in enumerate(probes):
            points, _ = L.normalised(*K.utf8(pa.array([t])))
            chars = "".join(map(chr, points))
            want = -sum(math.log(p(chars[max(0, k - 2) : k], chars[k])) for k in range(1, len(chars))) / (len(chars) - 1)
            assert abs(want - entropy[i, j]) < 1e-4 and size[i] == len(chars) - 1


def test_probabilities_sum_to_one():
    rng = random.Random(2)
    p, size = brute_probability([speech(rng, "aa", 30)], 3)
    seen = set("".join(SYLLABLES["aa"])) | {" "}
    for history in ("", "t", "th", "zz"):
        assert abs(sum(p(history, c) for c in seen) + (size - len(seen)) * p(history, "Ж") - 1) < 1e-9


def test_held_out_accuracy_and_edge_rows(spark):
    rows = [(i, t, lang, "x", 1.0) for i, t, lang in corpus()] + [(1000, None, "aa", None, None), (1001, "12 !? ...", "bb", "", 0.0), (1002, "", None, "", 0.0),
            (1003, "Это предложение совсем на другом языке, и букв его никто не видел. " * 5, None, "", 0.0), (None, rows_text(), "aa", "", 0.0), (None, rows_text(), "aa", "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    out = L.predict(docs, L.fit(docs)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    held = [(i, lang) for i, t, lang in corpus() if zlib.crc32(str(i).encode()) % 4 == 2 and len(t) > 20]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) >= 0.97
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].rejected and got[1003].lang_pred != "und"
    assert not any(got[i].rejected for i, _ in held)
    assert all(0 <= r.score <= 1 for r in out)


def rows_text():
    return speech(random.Random(8), "aa", 2000)


def test_only_training_rows_are_learned(spark):
    docs = spark.createDataFrame([(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "zz") for i, t, lang in corpus()], "doc_id long, text string, lang string")
    assert L.fit(docs).languages == sorted(SYLLABLES)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    r = L.predict(docs, L.fit(docs)).first()
    assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    empty = docs.where(F.lit(False))
    assert L.predict(empty, L.fit(empty)).count() == 0


def test_languages_of_few_long_texts_are_learned(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, speech(rng, "aa", 8), "aa") for i in range(400)] + [(1000 + i, speech(rng, "bb", 2_000), "bb") for i in range(3)]
    rows += [(2000 + i, speech(rng, "cc", 8), "cc") for i in range(400)] + [(3000, speech(rng, "cc", 20_000), "cc")]
    seen = {}
    train = L.train
    monkeypatch.setattr(L, "train", lambda texts, order: seen.update(texts) or train(texts, order))
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), training="true", sample_chars=2_000)
    assert model.languages == sorted(SYLLABLES)
    assert len(seen["bb"]) == L.LEAST_TEXTS
    assert all(sum(map(len, own[:-1])) < 2_000 <= sum(map(len, own)) for own in (seen["aa"], seen["cc"]))


def test_an_unlearned_language_in_the_same_script_is_rejected(spark):
    held = [(i, t, lang) for i, t, lang in corpus() if len(t) > 60]
    for left_out in sorted(SYLLABLES):
        docs = spark.createDataFrame([(i, t, lang if lang != left_out else None) for i, t, lang in held], "doc_id long, text string, lang string")
        got = {r.doc_id: r.rejected for r in L.predict(docs, L.fit(docs)).collect()}
        own = [got[i] for i, _, lang in held if lang == left_out]
        assert np.mean(own) > 0.9
        assert np.mean([got[i] for i, _, lang in held if lang != left_out]) < 0.01


def test_marks_stay_with_their_letters():
    probes = ["Ka\u0301 b", "हिन्दी में", "\u0301\u0301 12", "a \u0301b"]
    points, begin = L.normalised(*K.utf8(pa.array(probes)))
    texts = ["".join(map(chr, points[a:b])) for a, b in zip(begin[:-1], begin[1:])]
    assert texts == [" ka\u0301 b", " हिन्दी में", " ", " a b"]


def test_a_text_of_two_learned_languages_is_kept(spark):
    rows = [(i, t, lang) for i, t, lang in corpus() if len(t) > 60]
    rng = random.Random(12)
    mixed = [(5000 + i, " ".join(speech(rng, lang, 40) for lang in ("aa", "bb", "cc")), None) for i in range(20)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in L.predict(docs, L.fit(docs)).collect()}
    assert not any(got[i] for i, *_ in mixed)


def test_a_text_whose_grams_are_all_known_counts_once():
    """Without any miss at an order, no lower order is added."""
    texts = {lang: [speech(random.Random(3), lang, 50)] * 3 for lang in ("aa", "bb")}
    model = L.train(texts, order=3)
    (entropy,), _ = model.entropies(*K.utf8(pa.array(texts["aa"][:1])))
    p, _ = brute_probability(texts["aa"], 3)
    chars = "".join(map(chr, L.normalised(*K.utf8(pa.array(texts["aa"][:1])))[0]))
    want = -sum(math.log(p(chars[max(0, k - 2) : k], chars[k])) for k in range(1, len(chars))) / (len(chars) - 1)
    assert abs(entropy[0] - want) < 1e-4
