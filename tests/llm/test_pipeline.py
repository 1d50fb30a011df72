"""The pipeline against brute force on a small corpus: what each stage keeps, cuts and replaces."""

import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_decontamination import brute as hits
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_language_id import speech
from tests.llm.test_pii import brute as personal


def corpus():
    rng = random.Random(21)
    rows = [(i, speech(rng, lang, rng.randint(30, 120)), lang, f"s{i % 3}") for i in range(120) for lang in [rng.choice(["aa", "bb", "cc"])]]
    item = speech(rng, "aa", 25)
    text = rows[0][1]
    rows += [(200, text, "aa", "s0"), (201, text + " the", "aa", None), (200, text, "aa", "s0"), (202, rows[1][1] + " " + item + " " + rows[2][1], "aa", "s1"), (203, item, "aa", "s1"),
             (204, speech(rng, "bb", 40) + " mail me@some.example.org or +1 (988) 555-2485 now", "bb", ""), (205, None, "aa", "s"), (206, "", "aa", "s"), (207, "Это предложение совсем на другом языке, букв его никто не видел. " * 5, None, "s")]
    return rows, [(1, item), (2, None)]


def test_stages_and_run(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept.write.parquet(f"{tmp_path}/{name}-in")
        kept = stage(spark, spark.read.parquet(f"{tmp_path}/{name}-in"), str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}-out")
        kept = spark.read.parquet(f"{tmp_path}/{name}-out")
        seen.append(kept.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == corpus_pipeline.COLUMNS
    after_language, after_copies, after_benchmark, after_pii, packed = seen
    assert sorted(r.doc_id for r in after_language) == sorted(r[0] for r in rows if r[0] not in (205, 206, 207))
    left = [(r.doc_id, r.text) for r in after_language]
    assert sorted(r.doc_id for r in after_copies) == sorted({c for _, c, _ in groups(left)})
    assert all(r.text == dict(left)[r.doc_id] for r in after_copies)
    left = [(r.doc_id, r.text) for r in after_copies]
    found = {i: (n, h) for (i, _), (n, h, _) in zip(left, hits(left, items))}
    cleaned = {r.doc_id: r for r in after_benchmark}
    assert set(cleaned) == {i for i, (n, h) in found.items() if h <= n / 2}
    assert all(cleaned[i].text == dict(left)[i] for i, (n, h) in found.items() if not h)
    assert all(not h for _, h, _ in hits([(r.doc_id, r.text) for r in after_benchmark], items))
    clean = {r.doc_id: r.text for r in after_pii}
    assert set(clean) == set(cleaned)
    assert all(not personal(t) and (t == cleaned[i].text or personal(cleaned[i].text)) for i, t in clean.items())
    assert clean[204].endswith("mail [email] or [phone] now")
    assert all(r.n_chars == len(r.text) for r in after_pii)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: 0 for r in packed}.keys() == clean.keys()
    total = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in clean} == total
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()) == sorted(tuple(r)[:5] for r in packed)
