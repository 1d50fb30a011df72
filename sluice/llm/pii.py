"""Personal data: seed expressions, and contextual patterns bootstrapped from what they find. DataFrame functions only.

Seeds are the base spans (email, ip, card, phone). Their contexts induce lexical patterns: the two words before, the word
before with the word after, and a label before (a word that ends with a colon, equals or number sign). Candidates are other
identifier-like strings of several digits. Patterns and the distinct strings in their contexts form a graph. In each round a
pattern's score is the mean of its strings' scores, damped, and a string's score is the noisy-or of its patterns'; seeds
keep score 1. A pattern scores if it has enough different strings that are seeds or reach the least score, so strings found
in one round support new patterns in the next. Strings in a pattern of high score are found too, as kind `found`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import common, spans

KINDS = ["email", "ip", "card", "phone"]
FOUND = "found"
ROUNDS, LEAST_SEEDS, LEAST_SCORE, DAMPING = 3, 3, 0.75, 0.5
CONTEXT = 64

# The base expressions, in the forms that don't scan a run of characters again from each of its places.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![A-Za-z0-9_#/-])(?=[A-Za-z_#/-]*+[0-9][A-Za-z_#/-]*+[0-9][A-Za-z_#/-]*+[0-9])[A-Za-z0-9_#/-]{6,40}+(?![A-Za-z0-9_#/-])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass."""

    def weighted(digit: Column, i: Column) -> Column:
        d = digit.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    digits = F.split(F.reverse(_digits(value)), "")
    return F.aggregate(F.transform(digits, weighted), F.lit(0), lambda total, d: total + d) % 10 == 0


def _passes_card(value: Column) -> Column:
    return F.when(F.length(_digits(value)).between(14, 19), luhn(value)).otherwise(False)


def patterns(text: Column) -> dict:
    digit = text.rlike("[0-9]")
    small = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
    return {
        "email": (F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        "ip": (digit, IP, lambda v: v.rlike(small)),
        "card": (digit, CARD, _passes_card),
        "phone": (F.contains(text, F.lit("+")), PHONE, lambda v: F.length(_digits(v)).between(10, 15)),
    }


def base(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, h, text, the columns `carried` and a column of spans for each base kind. h tells rows of one id with different texts apart."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carried)
    df = spans.matches(df.withColumn("h", F.xxhash64("text")), F.col("text"), patterns(F.col("text")))
    return df.select("doc_id", "h", *(["text"] if keep_text else []), *carried, *KINDS)


def _contexts(parts: Column, start: Column, end: Column) -> Column:
    """The lexical patterns around a span. parts: the text's pieces."""

    def made(around: Column) -> Column:
        before, after = around["before"], around["after"]
        two = F.regexp_extract(before, r"(\S+\s+\S+)\s+$", 1)
        one = F.regexp_extract(before, r"(\S+)\s+$", 1)
        right = F.regexp_extract(after, r"^\S{0,2}\s+(\S+)", 1)
        label = F.regexp_extract(before, r"([\p{L}]{2,}\s?[:=#])\s*$", 1)
        return F.array(
            F.when(two != "", F.concat(F.lit("two "), F.regexp_replace(two, r"\s+", " "))),
            F.when((one != "") & (right != ""), F.concat(F.lit("around "), one, F.lit(" _ "), right)),
            F.when(label != "", F.concat(F.lit("label "), F.regexp_replace(label, r"\s+", ""))),
        )

    around = F.struct(F.lower(spans.before(parts, start, CONTEXT)).alias("before"), F.lower(spans.after(parts, end, CONTEXT)).alias("after"))
    return F.filter(spans.let(around, made), lambda p: p.isNotNull())


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """base() with `near`: start, end, value, seed, patterns of every seed and candidate of the text, in their contexts."""
    df = base(docs, doc_id, text, keep_text=True, carried=carried)
    df = spans.matches(df, F.col("text"), {"candidate": (F.col("text").rlike("[0-9]"), CANDIDATE, lambda v: F.lit(True))})
    df = df.withColumn("candidate", spans.apart("candidate", KINDS))

    def marked(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind in KINDS).alias("seed")))

    def placed(parts: Column) -> Column:
        every = F.concat(*(marked(k) for k in [*KINDS, "candidate"]))
        return F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["seed"].alias("seed"), _contexts(parts, s["start"], s["end"]).alias("patterns")))

    some = sum((F.size(k) for k in [*KINDS, "candidate"]), F.lit(0)) > 0
    near = spans.let(F.when(some, spans.pieces(F.col("text"))).otherwise(F.array().cast("array<string>")), placed)
    return df.select("doc_id", "h", *(["text"] if keep_text else []), *carried, *KINDS, near.alias("near"))


def _scored_patterns(edges: DataFrame, rounds: int, least_seeds: int, least_score: float = LEAST_SCORE) -> DataFrame:
    """pattern, score, seeds: the number of its strings that are seeds or reach least_score. edges: distinct pattern, value,
    seed. Both sides of each join are written tables, so that a pattern or value with many edges can be split."""
    strings = common.written(edges.groupBy("value").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(0.0)).alias("s")), "pii-strings")
    for i in range(rounds):
        scored = edges.join(strings, "value").groupBy("pattern")
        scored = scored.agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"), F.sum((F.col("seed") | (F.col("s") >= least_score)).cast("int")).alias("seeds"))
        score = F.when(F.col("seeds") >= least_seeds, F.col("s") / (F.col("n") + DAMPING)).otherwise(0.0)
        table = common.written(scored.select("pattern", score.alias("score"), "seeds"), "pii-patterns")
        if i + 1 < rounds:
            missed = edges.join(table, "pattern").groupBy("value").agg(F.sum(F.log1p(-F.col("score"))).alias("l"), F.max("seed").alias("seed"))
            strings = common.written(missed.select("value", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("l")).alias("s")), "pii-strings")
    return table


def learned(rows: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, h, found: spans that the bootstrapped patterns add, of the documents that have any. rows: a table of scanned()."""
    near = rows.select("doc_id", "h", F.explode("near").alias("s")).select("doc_id", "h", "s.*")
    exploded = near.withColumn("pattern", F.explode("patterns"))
    edges = common.written(exploded.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    good = _scored_patterns(edges, rounds, least_seeds, least_score).where((F.col("score") >= least_score) & (F.col("seeds") >= least_seeds))
    good = common.written(good.select("pattern"), "pii-good")
    hits = exploded.where(~F.col("seed")).join(good, "pattern")
    one = F.struct("start", "end", "value")
    return hits.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(one)).cast(spans.SPAN).alias(FOUND))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, carried: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, h, (text, the columns `carried`,) email, ip, card, phone, found: spans (start, end, value) of each row's whole text.

    One row for each row. A null text is an empty one, without spans. Repeated rows each have their spans, and count once
    in the graph. Tables without seeds, or empty ones, add nothing. Only the named columns are read, and the texts once.
    """
    rows = common.written(scanned(docs, doc_id, text, keep_text, carried), "pii-rows")
    more = learned(rows, **options).withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    on = rows["doc_id"].eqNullSafe(more["_id"]) & (rows["h"] == more["_h"])
    out = rows.drop("near").join(more, on, "left").drop("_id", "_h")
    return out.withColumn(FOUND, F.coalesce(F.col(FOUND), F.array().cast(spans.SPAN)))


def digest(found: DataFrame) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    text = F.sha2(spans.listed(KINDS).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, text, spans.listed([*KINDS, FOUND]).alias("spans"), F.size(FOUND).cast("long").alias("n_found"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carried: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, text, the columns `carried`: all spans replaced by their kind in brackets. A null text becomes an empty one."""
    out = find(docs, doc_id, text, keep_text=True, carried=carried, **options)
    return out.select("doc_id", spans.replaced(F.col("text"), [*KINDS, FOUND]).alias("text"), *carried)
