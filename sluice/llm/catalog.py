"""Queries of the corpus operators over the driver tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common, decontamination, jaccard_join, language_id, lm_scoring, packing, pii, quality, secrets, sharding, topk
from sluice.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak label and quality score of every document."""
    return quality.classify(table(spark, sf_dir, "documents")).select("doc_id", "weak_label", "score", "good")


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and those that bootstrapped patterns add."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose crc32(doc_id) mod 4 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit(docs, training="pmod(crc, 4) != 2"))
    held_out = F.pmod(common.crc_of_id("doc_id"), F.lit(4)) == 2
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans, and live-looking keys by corpus-wide ownership."""
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window of ten benchmark words covers, and the items found."""
    out = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0, k=10)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised, in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048), capacity=2048)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of those whose crc32(doc_id) mod 10 isn't 0."""
    return lm_scoring.score(table(spark, sf_dir, "documents"), held_out="pmod(crc, 10) = 0")


def op9_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; equal texts share a shard."""
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a similarity of 0.8 on five-word n-grams."""
    return jaccard_join.join(table(spark, sf_dir, "documents"), threshold=0.8, words=5).select("doc_id", "class_id", "n_links")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_contextual_pii": op2_contextual_pii,
    "op3_language_id": op3_language_id,
    "op4_secret_ownership": op4_secret_ownership,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_minimax_sharding": op9_minimax_sharding,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op5_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0
        ), sizes AS (SELECT DISTINCT n FROM win),
        dwin AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
        hit AS (SELECT r, i, n, item_id FROM dwin JOIN win USING (n, s)),
        covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(n)) t(k) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op10_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        g AS (SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
        sizes AS (SELECT r, count(*) AS n FROM g GROUP BY r),
        both_ AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM g x JOIN g y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r),
        link AS (SELECT a, b FROM both_ JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE both_.n >= 0.8 * (x.n + y.n - both_.n)),
        reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
        class AS (SELECT reach.a AS r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a),
        links AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a)
        SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM d JOIN class USING (r) LEFT JOIN links USING (r)""",
    "op6_exact_top_k": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
