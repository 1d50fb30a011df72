import random
import re

from sluice.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for name, item in items:
            v = words(item)
            windows = {tuple(v)} if 0 < len(v) < window else {tuple(v[i : i + window]) for i in range(len(v) - window + 1)}
            for n in {len(x) for x in windows if x}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in windows:
                        hit |= set(range(i, i + n))
                        found.add(str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, items string, spans string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def sample(seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Éa", "b2", "x", "y", "ZED", "q", "über"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 9, 10, 11, 25])))) for i in range(12)] + [(99, None), (100, "The, of")]
    docs = [(0, None), (1, ""), (2, "..."), (2, "..."), (None, items[3][1])]
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary + ["other", "words"], k=rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            w = (items[rng.randrange(len(items))][1] or "").upper().split()
            a = rng.randint(0, 5)
            parts.append(", ".join(w[a : a + rng.randint(5, 25)]))
        docs.append((i + 10, rng.choice([" ", "\n", " other "]).join(parts)))
    return docs, items


def test_like_brute_force(spark):
    docs, items = sample()
    d, b = tables(spark, docs, items)
    got = [(r.n_words, r.n_hit, r["items"]) for r in D.find(d.coalesce(1), b).collect()]
    assert got == brute(docs, items)
    assert any(x[1] for x in got)


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    docs, items = sample(9)
    d, b = tables(spark, docs, items)
    monkeypatch.setattr(D, "MOST_WORDS", 20)
    got = [(r.n_words, r.n_hit, r["items"]) for r in D.find(d.coalesce(1), b).collect()]
    assert got == brute(docs, items)


def test_spans_cover_the_hit_words_and_cleaning_leaves_none(spark):
    docs, items = sample(3)
    d, b = tables(spark, docs, items)
    texts = [t for _, t in docs]
    for t, r in zip(texts, D.find(d.coalesce(1), b).collect()):
        assert sum(len(words(t[s.start : s.end])) for s in r.spans) == r.n_hit
    cleaned = [(r.doc_id, r.text) for r in D.clean(d.coalesce(1), b).collect()]
    assert all(n == 0 for _, n, _ in brute(cleaned, items))
    assert all(c == t for (_, c), t, x in zip(cleaned, texts, brute(docs, items)) if not x[1])


def test_empty_tables(spark):
    d, b = tables(spark, [], [])
    assert D.find(d, b).count() == 0
    d, _ = tables(spark, [(1, "some words"), (2, None)], [])
    assert [(r.n_words, r.n_hit) for r in D.find(d, b).orderBy("doc_id").collect()] == [(2, 0), (0, 0)]


def test_cleaning_in_parts_is_cleaning_at_once(spark, monkeypatch):
    docs, items = sample(12)
    d, b = tables(spark, docs, items)
    key = lambda r: (str(r.doc_id), str(r.text), r.n_words)
    want = sorted(D.clean(d, b, carried=("items",)).collect(), key=key)
    monkeypatch.setattr(D, "MOST_WORDS", 20)
    got = sorted(D.clean(d, b, carried=("items",)).collect(), key=key)
    assert got == want and any(r.n_hit for r in got) and {r.text for r in got if r.n_words == 0} >= {None, ""}


def test_a_very_long_text(spark):
    rng = random.Random(4)
    item = " ".join(f"w{rng.randrange(50)}" for _ in range(30))
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(200_000)) + " " + item.upper() + " end"
    d, b = tables(spark, [(1, text)], [(7, item)])
    r = D.find(d, b).first()
    assert (r.n_words, r["items"]) == (200_031, ["7"]) and r.n_hit >= 30
    assert D.clean(d, b).first().text.endswith(" end")


def test_the_automaton_is_flat():
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(100))) for i in range(300)]
    m = D.Matcher(items)
    held = m.automaton
    assert len(held.link) <= 2 * 30_000 + 1 and sum(map(len, held.more.values())) < len(held.link)
    sequences = [t.split() for _, t in items]
    for a in (0, 17, 299):
        w = sequences[a][5:25]
        assert list(m.hits([m.vocabulary.tolist().index(h) for h in D.K.span_hashes(*_spans(" ".join(w)))], seen := set())) and seen == {str(a)}


def _spans(text):
    data, offsets = D.K.utf8(D.pa.array([text]))
    starts, ends, _ = D.K.spans(data, offsets, D.K.WORD_BYTES)
    return data, starts, ends, D.K.FOLDED_VALUES
