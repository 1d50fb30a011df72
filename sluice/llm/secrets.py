"""Secrets: credential expressions, and corpus-wide ownership frequency. DataFrame functions only.

Every candidate value's hash is aggregated over the corpus by distinct repositories and owners. A value that several owners
hold, or very many repositories of one, is a widely copied example; one of few owners and repositories looks live. Besides
the base spans, other strings that look random are candidates, and those that look live are added, as kind `key`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import common, spans

KINDS = ["assign", "access", "hex"]
ADDED = "key"
MOST_OWNERS, MOST_REPOSITORIES = 2, 100

# The base expressions. Runs that are too short to pass are not matched at all, which leaves the same spans.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
RANDOM = r"(?<![A-Za-z0-9+/_=.@-])[A-Za-z0-9+/_=-]{20,}+(?![.@])"


def patterns(text: Column) -> dict:
    return {
        "assign": (F.lit(True), ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= 12),
        "access": (F.contains(text, F.lit("AKIA")), ACCESS, lambda v: F.lit(True)),
        "hex": (text.rlike("[0-9a-f]{16}"), HEX, lambda v: F.lit(True)),
    }


def _looks_random(value: Column) -> Column:
    """Digits, small and capital letters, and many changes between them."""
    kinds = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    changes = F.length(F.regexp_replace(value, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x"))
    return kinds & (changes * 4 >= F.length(value))


def base(docs: DataFrame, doc_id: str, text: str, owner: str, repository: str | None = None) -> DataFrame:
    """doc_id, h, owner, repository (a hash), a column of spans for each base kind, and one of further candidates."""
    held = F.xxhash64(doc_id, F.coalesce(F.col(text), F.lit(""))) if repository is None else F.xxhash64(F.col(repository))
    df = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(owner).cast("string").alias("owner"), held.alias("repository")
    )
    body = F.col("text")
    kinds = patterns(body) | {"candidate": (body.rlike("[A-Za-z0-9+/_=-]{20}"), RANDOM, _looks_random)}
    df = spans.matches(df.withColumn("h", F.xxhash64("text")), body, kinds)
    df = df.withColumn("candidate", spans.apart("candidate", KINDS))
    return df.select("doc_id", "h", "owner", "repository", *KINDS, "candidate")


def ownership(rows: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """value_hash, owners, repositories, live. rows: value_hash, owner, repository.

    Distinct pairs are made before counting, so that a value of any frequency is summed up in parts.
    """
    owners = rows.select("value_hash", "owner").distinct().groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"))
    repositories = rows.select("value_hash", "repository").distinct().groupBy("value_hash").agg(F.count(F.lit(1)).alias("repositories"))
    few = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    return owners.join(repositories, "value_hash").withColumn("live", few)


def find(docs: DataFrame, most_owners: int = MOST_OWNERS, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """doc_id, h, assign, access, hex, key, n_live, n_example: spans of each row's whole text, one row for each row.

    n_live and n_example count the row's candidates by ownership. A document is its own repository unless a column is named;
    null owners are one owner, and null repositories one repository. A null text is an empty one, without spans. Repeated rows each have their spans and are one
    repository. Only the named columns are read.
    """
    rows = common.written(base(docs, doc_id, text, owner, repository), "secrets-base")
    every = F.concat(*(_held(k) for k in [*KINDS, "candidate"]))
    held = rows.where(sum((F.size(k) for k in [*KINDS, "candidate"]), F.lit(0)) > 0)
    held = held.select("doc_id", "h", F.coalesce("owner", F.lit("")).alias("owner"), "repository", F.explode(every).alias("s"))
    held = held.select("doc_id", "h", "owner", "repository", "s.start", "s.end", "s.value", "s.more", F.xxhash64("s.value").alias("value_hash"))
    held = common.written(held, "secrets-held")
    stats = common.written(ownership(held, most_owners, most_repositories), "secrets-owners")
    # Both sides are written tables, so that a frequent value's rows can be split.
    judged = held.join(stats, "value_hash").dropDuplicates(["doc_id", "h", "start", "end", "more"])
    one = F.when(F.col("more") & F.col("live"), F.struct("start", "end", "value"))
    judged = judged.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(
        F.array_sort(F.collect_list(one)).cast(spans.SPAN).alias(ADDED),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"),
    )
    out = rows.join(judged, rows["doc_id"].eqNullSafe(judged["_id"]) & (rows["h"] == judged["_h"]), "left")
    return out.select(
        rows["doc_id"], rows["h"], *KINDS, F.coalesce(ADDED, F.array().cast(spans.SPAN)).alias(ADDED),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def _held(kind: str) -> Column:
    more = F.lit(kind == "candidate").alias("more")
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _secret(s["value"], kind).alias("value"), more))


def _secret(value: Column, kind: str) -> Column:
    """The credential itself, without what names it."""
    return F.regexp_extract(value, ASSIGN, 1) if kind == "assign" else value


def digest(found: DataFrame) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    text = F.sha2(spans.listed(KINDS).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, text, spans.listed([*KINDS, ADDED]).alias("spans"), "n_live", "n_example")
