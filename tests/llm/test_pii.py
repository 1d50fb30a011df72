import hashlib
import random
import re

from pyspark.sql import functions as F

from sluice.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(v):
    return [int(c) for c in v if c in "0123456789"]


def luhn(v):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits(v)))) % 10 == 0


def brute(text):
    text = text or ""
    out = []
    for rank, (kind, regex, test) in enumerate(
        [("email", EMAIL, lambda v: True), ("ip", IP, lambda v: all(int(p) <= 255 for p in v.split("."))),
         ("card", CARD, lambda v: 14 <= len(digits(v)) <= 19 and luhn(v)), ("phone", PHONE, lambda v: 10 <= len(digits(v)) <= 15)]
    ):
        out += [(m.start(), rank, m.end(), kind) for m in regex.finditer(text) if test(m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def sample():
    rng = random.Random(11)
    parts = ["a@b.c", "_d@e.f", "x.y+z@mail1.example.com", "@", ".", "é", "😀", " ", "\n", "1.2.3.4", "256.1.1.1", "0255.0.0.1", "4532015112830366", "4532-0151 1283 0366",
             "+1 (988) 555-2485", "+4", "--", "(", "99999999999999999999", "12", "a", "%", "1.2.3", "5 5 5"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(300)]
    return [*rows, (500, None), (501, ""), (502, "7" * 30000), (503, "a" * 50000 + "@"), (504, "a@b" + ".c" * 20000), (505, "+1" + " (" * 20000), (None, "x@y.zz"), (3, rows[3][1]), (3, "z@y.xx")]


def test_base_like_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, "x", 1, "p") for i, t in rows], "doc_id long, text string, h string, start int, email string")
    got = sorted((r.doc_id or -1, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone, r.spans) for r in pii.digest(pii.find(docs)).collect())
    want = sorted((i or -1, hashlib.sha256(",".join(s).encode()).hexdigest(), len(s)) for i, t in rows for s in [brute(t)])
    assert [g[:3] for g in got] == want
    by = {}
    for i, t in rows:
        by.setdefault(i or -1, []).append(set(filter(None, brute(t))))
    assert all(any(s <= set(g[3].split(",")) for s in by[g[0]]) for g in got)


def labelled():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(i, f"{word()} {word()} contact: user{i}@mail.example.com {word()} and {word()}") for i in range(20)]
    rows += [(100 + i, f"{word()} contact: AB-{10000 + i} {word()} more") for i in range(3)]
    rows += [(200 + i, f"{word()} version 2024-{1000 + i} {word()}") for i in range(5)]
    return rows


def test_patterns_find_unseen_identifiers_and_leave_others(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert all([s.value for s in got[100 + i].found] == [f"AB-{10000 + i}"] for i in range(3))
    assert not any(got[200 + i].found for i in range(5))
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    texts = dict(labelled())
    assert clean[0] == texts[0].replace("user0@mail.example.com", "[email]")
    assert clean[101] == texts[101].replace("AB-10001", "[found]")
    assert clean[200] == texts[200]


def test_scores_like_a_plain_loop(spark):
    edges = [("p", f"s{i}", True) for i in range(4)] + [("p", "c", False), ("q", "c", False), ("q", "s0", True), ("q", "s1", True), ("q", "s2", True), ("q", "d", False), ("r", "d", False)]
    df = spark.createDataFrame(edges, "pattern string, value string, seed boolean")
    got = {r.pattern: r.score for r in pii._scored_patterns(df, 3, 3).collect()}
    seed = {v: any(s for _, w, s in edges if w == v) for _, v, _ in edges}
    s = {v: float(x) for v, x in seed.items()}
    for _ in range(3):
        p = {}
        for name in "pqr":
            own = [v for n, v, _ in edges if n == name]
            p[name] = sum(s[v] for v in own) / (len(own) + pii.DAMPING) if sum(seed[v] for v in own) >= 3 else 0.0
        for v in s:
            miss = 1.0
            for n, w, _ in edges:
                miss *= 1 - p[n] if w == v else 1
            s[v] = 1.0 if seed[v] else 1 - miss
    assert all(abs(got[n] - p[n]) < 1e-9 for n in "pqr")


def test_overlapping_spans_are_replaced_once(spark):
    docs = spark.createDataFrame([(1, "call +1.2.3.4555512345 now"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got[2] == "" and got[1].startswith("call [") and got[1].endswith("] now")


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(docs).count() == 0
    assert pii.digest(pii.find(docs.union(spark.createDataFrame([(None, None)], docs.schema)))).first()["spans"] == ""


def test_found_strings_support_patterns_of_a_second_generation(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = labelled() + [(300 + i, f"{word()} badge: AB-{10000 + i} {word()} more") for i in range(3)] + [(310, f"{word()} badge: QX-77123 {word()} more")]
    rows += [(320 + i, f"{word()} ticket: QX-5512{i} {word()}") for i in range(4)]
    got = {r.doc_id: [s.value for s in r.found] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == [f"AB-{10000 + i % 100}"] for i in (100, 101, 102, 300, 301, 302))
    assert got[310] == ["QX-77123"]
    assert not any(got[320 + i] for i in range(4))


CANDIDATE = re.compile(r"(?<![A-Za-z0-9_#/-])[A-Za-z0-9_#/-]{6,40}(?![A-Za-z0-9_#/-])")


def brute_contexts(text, start, end):
    before, after = text[max(0, start - pii.CONTEXT) : start].lower(), text[end : end + pii.CONTEXT].lower()
    out = []
    two, one, right = re.search(r"(\S+\s+\S+)\s+$", before), re.search(r"(\S+)\s+$", before), re.search(r"^\S{0,2}\s+(\S+)", after)
    label = re.search(r"([^\W\d_]{2,}\s?[:=#])\s*$", before)
    if two:
        out.append("two " + re.sub(r"\s+", " ", two[1]))
    if one and right:
        out.append(f"around {one[1]} _ {right[1]}")
    if label:
        out.append("label " + re.sub(r"\s+", "", label[1]))
    return out


def brute_found(rows):
    """doc_id -> found spans, by the definition: contexts, graph, rounds, good patterns."""
    near = []
    for i, t in rows:
        base = [(int(a), int(b)) for _, a, b in (s.split(":") for s in brute(t) if s)]
        near += [(i, a, b, t[a:b], True, brute_contexts(t, a, b)) for a, b in base]
        for m in CANDIDATE.finditer(t or ""):
            if sum(c.isdigit() for c in m[0]) >= 3 and not any(m.start() < b and a < m.end() for a, b in base):
                near.append((i, m.start(), m.end(), m[0], False, brute_contexts(t, m.start(), m.end())))
    edges = {}
    for *_, v, seed, patterns in near:
        for p in patterns:
            edges[p, v] = edges.get((p, v), False) or seed
    seeds = {v for (_, v), s in edges.items() if s}
    strings = {v: float(v in seeds) for _, v in edges}
    for _ in range(pii.ROUNDS):
        by = {}
        for (p, v), s in edges.items():
            by.setdefault(p, []).append((strings[v], s or strings[v] >= pii.LEAST_SCORE))
        score = {p: (sum(x for x, _ in own) / (len(own) + pii.DAMPING) if sum(s for _, s in own) >= pii.LEAST_SEEDS else 0.0, sum(s for _, s in own)) for p, own in by.items()}
        for v in strings:
            miss = 1.0
            for p in [p for p, w in edges if w == v]:
                miss *= 1 - score[p][0]
            strings[v] = 1.0 if v in seeds else 1 - miss
    good = {p for p, (s, n) in score.items() if s >= pii.LEAST_SCORE and n >= pii.LEAST_SEEDS}
    out = {i: set() for i, _ in rows}
    for i, a, b, _, seed, patterns in near:
        if not seed and good & set(patterns):
            out[i].add((a, b))
    return out


def test_all_spans_like_brute_force(spark):
    rng = random.Random(21)
    ids = [f"user{i}@m.org" for i in range(6)] + [f"10.0.0.{i}" for i in range(4)] + [f"AB-{1000 + i}" for i in range(8)] + ["12.345", "short1", "+1 (988) 555-2485", "é777#", "x" * 45 + "123"]
    leads = ["contact: ", "mail of user ", "badge# ", "\n", "the é ", "see😀 ", "id=", "", " " * 300, "word " * 60]
    rows = [(i, "".join(rng.choice(leads) + rng.choice(ids) + rng.choice([" ", ", ", " end ", "\n", ""]) for _ in range(rng.randint(0, 7)))) for i in range(150)]
    rows += [(200 + i, t) for i, t in labelled()]
    got = {r.doc_id: {(s.start, s.end) for s in r.found} for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_found(rows)
    assert got == want and sum(map(len, want.values())) > 20


def test_a_text_of_a_hundred_thousand_identifiers(spark):
    text = "é ".join(f"10.{i // 250 % 250}.{i % 250}.7 id: AB-{i:06d}" if i % 2 else f"u{i}@ex.org +1 (555) 123-{i:06d}" for i in range(50_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.digest(pii.find(docs)).first()
    assert got.base_sha256 == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()
    spans_ = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in brute(text)))
    want, at = [], 0
    for a, b, k in spans_:
        if a >= at:
            want.append(text[at:a] + f"[{k}]")
        at = max(at, b)
    assert pii.redact(docs).first().text == "".join(want) + text[at:]
