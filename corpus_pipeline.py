"""A corpus in five stages: language, near copies, benchmark passages, personal data, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; n_chars follows the text where a stage changes it. Tables
may be empty, and hold further columns, which are left behind; null ids, languages and sources are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import catalog, common, decontamination, jaccard_join, language_id, packing, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with a greater share of benchmark words go; from others the passages are cut.
MOST_COVERAGE = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like one of the languages of the corpus. Texts that are null or without letters go, and all texts
    if no row has a language. Repeated rows are treated alike."""
    out = language_id.predict(docs, language_id.fit(docs), carried=tuple(COLUMNS[1:]))
    return out.where(~F.col("rejected")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that hangs together at a similarity of 0.8: that of least id. Texts without words stay."""
    kept = jaccard_join.join(docs).where("leads").groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    kept = common.written(kept.agg(F.count(F.lit(1)).alias("_rows"), F.max("n_links").alias("_links")), "kept")
    own = docs.withColumn("_own", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    out = own.join(kept, own["doc_id"].eqNullSafe(kept["_id"]) & (own["_own"] == kept["_h"]))
    repeated = (F.col("_rows") > 1) & (F.col("_links") > 0)
    if kept.where(repeated).limit(1).count():  # rows that stand there several times, id and text, stay once
        out = out.where(~repeated).unionByName(out.where(repeated).dropDuplicates(["doc_id", "text"]))
    return out.select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those mostly made of them go. Null and empty texts stay, and everything
    if there are no items."""
    out = decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"), most_coverage=MOST_COVERAGE, carried=tuple(COLUMNS[2:]))
    return _measured(out.where(~F.col("dropped")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. A null text becomes an empty one. Repeated rows stay repeated."""
    return _measured(pii.redact(docs, carried=tuple(COLUMNS[2:])))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens. A null or empty text is its end alone."""
    return packing.pack(packing.pieces(docs, catalog.tokenizer_path()))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("contextual_pii", personal_data),
    ("best_fit_packing", sequences),
]

#: No stage but the cleaning of exact spans can be put in SQL; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
