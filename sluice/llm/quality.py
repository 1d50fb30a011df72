"""Quality by weak labels: overlapping heuristic labellers, expectation-maximisation over their accuracies, and a hashed
linear scorer trained on the posterior labels.

Each labeller votes good (1), bad (0) or abstains (-1) on a whole text, from counts that DataFrame functions make. Votes of
all documents are counted by pattern: there are at most 3 ** labellers patterns at any number of documents, and expectation-
maximisation runs on those counts alone. A bounded sample of documents (the first by hash, SAMPLE_ROWS rows and SAMPLE_BYTES
bytes at most, half of either for each kind of posterior), with their posteriors as soft labels, trains a logistic scorer on
hashed words and word pairs, which scores every document's whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import common
from sluice.llm import kernels as K

SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 32 << 20
BITS, EPOCHS, RATE, PENALTY = 18, 12, 0.5, 1e-2
#: Places of rows in the order in which they are sampled.
PLACES = 1 << 62
ABSTAIN, BAD, GOOD = -1, 0, 1
DOUBLED = np.uint64(0x27D4EB2F165667C5)
#: Values of bytes by their class.
SHAPES = np.full(256, K.BYTE_VALUES[128])
for _class in (range(65, 91), range(97, 123), range(48, 58), [*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]):
    SHAPES[list(_class)] = K.BYTE_VALUES[_class[0]]


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def labellers(text: Column) -> dict[str, Column]:
    """Votes of the heuristics. text: no null."""
    chars = F.length(text)
    words = F.size(F.split(F.trim(text), r"\s+"))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    symbols = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:'’()\"-]+", ""))
    # A word that follows itself.
    doubled = F.length(F.regexp_replace(text, r"(?s)(\b\p{L}+\b)(?=\s\1\b)|.", "$1")) / F.greatest(letters, F.lit(1))
    ends = F.length(F.regexp_replace(text, r"[^.]+", ""))
    return {
        "length": _vote(chars < 20, words.between(40, 20_000)),
        "symbols": _vote(_share(symbols, chars) > 0.05, (_share(symbols, chars) < 0.01) & (letters > 0)),
        "capitals": _vote(_share(capitals, letters) > 0.4, _share(capitals, letters).between(0.001, 0.1)),
        "repeats": _vote(doubled > 0.2, (doubled < 0.02) & (words > 20)),
        "letters": _vote(_share(letters, chars) < 0.5, _share(letters, chars) > 0.7),
        "sentences": _vote((ends == 0) & (words > 30), _share(ends, words).between(0.02, 0.25)),
    }


@dataclass
class LabelModel:
    """prior: of good; rates: for each labeller, P(vote | class) with rows bad, good and columns abstain, bad, good."""

    prior: float
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        logs = np.log(self.rates)
        which = np.arange(votes.shape[1])
        bad, good = (logs[which, c, votes + 1].sum(axis=1) for c in range(2))
        x = np.log(self.prior) + good - np.log(1 - self.prior) - bad
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.8) -> LabelModel:
    """Accuracies from vote patterns and their counts. The start takes a bad vote to be rare on good texts, and a
    good vote to be common on bad ones, as each labeller knows one kind of fault only; that also tells which class is which.
    A prior of a few counts keeps all rates positive. Abstentions of each class are fitted too."""
    n = votes.shape[1]
    start = np.tile(np.array([[0.2, 0.3, 0.5], [0.2, 0.02, 0.78]]), (n, 1, 1))
    model = LabelModel(prior, start)
    total = max(counts.sum(), 1)
    for _ in range(rounds):
        good = model.posterior(votes)
        rates = start * 3.0
        for j in range(n):
            for c, weight in enumerate(((1 - good) * counts, good * counts)):
                rates[j, c] += np.bincount(votes[:, j] + 1, weight, 3)
        rates /= rates.sum(axis=2, keepdims=True)
        new = LabelModel(float(np.clip((good * counts).sum() / total, 0.01, 0.99)), rates)
        still = abs(new.prior - model.prior) < 1e-9 and np.abs(new.rates - model.rates).max() < 1e-9
        model = new
        if still:
            break
    return model


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each text, and where each text's begin, and the end: its white-space tokens, the shapes of these
    (capitals, small letters, digits, other ASCII, the rest), and pairs of neighbours; a token that follows itself is one
    feature, whatever the token."""
    starts, ends, first = K.spans(data, offsets, K.SOLID_BYTES)
    h = K.span_hashes(data, starts, ends, K.BYTE_VALUES)
    shapes = K.mix(K.span_hashes(data, starts, ends, SHAPES) + np.uint64(1))
    pairs = np.empty_like(h)
    pairs[1:] = K.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pairs[1:][h[1:] == h[:-1]] = DOUBLED
    inner = first[:-1][np.diff(first) > 0]
    pairs[inner] = K.mix(h[inner] + np.uint64(7))  # a text's first token has no neighbour before
    return (np.column_stack([h, shapes, pairs]).ravel() >> np.uint64(64 - bits)).astype(np.int64), 3 * first


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Probability of good: logistic of the mean weight of a text's features."""
        n = np.diff(begin)
        x = K.segment_sums(self.weights[ids], begin) / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_scorer(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY, bits: int = BITS) -> Scorer:
    """Logistic regression with soft labels, by AdaGrad in batches of 64 texts."""
    # A hundred texts at a time, which bounds the work space of hashing.
    parts = [features(*K.utf8(pa.array(texts[i : i + 100], pa.string())), bits) for i in range(0, len(texts), 100)]
    ids = np.concatenate([p[0].astype(np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))]) if parts else np.zeros(1, np.int64)
    del parts
    scorer = Scorer(np.zeros(1 << bits), 0.0)
    squares, bias_square = np.full(1 << bits, 1e-8), 1e-8
    rng = np.random.default_rng(1)
    size = np.maximum(np.diff(begin), 1)
    for _ in range(max(epochs, -(-64_000 // max(len(texts), 64)))):  # a thousand batches at least
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            own = np.concatenate([ids[begin[r] : begin[r + 1]] for r in rows])
            own_begin = np.concatenate([[0], np.cumsum(begin[rows + 1] - begin[rows])])
            error = scorer.score(own, own_begin) - labels[rows]
            used, where = np.unique(own, return_inverse=True)
            slope = np.bincount(where, np.repeat(error / size[rows], np.diff(own_begin)), len(used)) + penalty * scorer.weights[used]
            squares[used] += slope**2
            scorer.weights[used] -= rate * slope / np.sqrt(squares[used])
            bias_square += error.mean() ** 2
            scorer.bias -= 0.1 * rate * error.mean() / np.sqrt(bias_square)
    return scorer


def voted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, votes (an array in the order of the labellers), and the text."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    votes = F.array(*labellers(F.col("text")).values()).alias("votes")
    return df.select("doc_id", votes, *(["text"] if keep_text else []))


def sampled(rows: DataFrame, most_rows: int, most_bytes: int) -> list:
    """text, weak_label of the first rows by hash, for each kind of posterior until half of either bound is reached.

    rows: doc_id, text, weak_label. Counts by eighths of a power of two of the place tell how far to read, so that no more
    than a tenth or so beyond the bounds reaches the driver, at any number of rows.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PLACES))
    rows = rows.select("text", "weak_label", place.alias("place"), F.floor(8 * F.log2(place + 1)).alias("bucket"), (F.col("weak_label") >= 0.5).alias("kind"))
    held = rows.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # 1,000 at most
    cuts = {True: -1, False: -1}
    n, size = {True: 0, False: 0}, {True: 0, False: 0}
    for r in sorted(held, key=lambda r: (r.kind, r.bucket)):
        if 2 * n[r.kind] < most_rows and 2 * size[r.kind] < most_bytes:
            cuts[r.kind] = r.bucket
        n[r.kind] += r.n
        size[r.kind] += r.bytes
    read = rows.where(F.col("bucket") <= F.when(F.col("kind"), cuts[True]).otherwise(cuts[False])).select("text", "weak_label", "place", "kind").collect()
    out, n, size = [], {True: 0, False: 0}, {True: 0, False: 0}
    for r in sorted(read, key=lambda r: (r.place, r.text)):
        if 2 * n[r.kind] < most_rows and 2 * size[r.kind] < most_bytes:
            out.append(r)
            n[r.kind] += 1
            size[r.kind] += len(r.text.encode())
    return out


def classify(docs: DataFrame, least_score: float = 0.5, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, votes, weak_label, score, good: one row for each row.

    weak_label is the posterior of good from the votes, score the linear scorer's probability, and good whether it reaches
    `least_score`. A null text is an empty one. Repeated rows count as often as they stand there. Without any rows nothing
    is learned, and nothing returned. Only the named columns are read, and the votes are made once.
    """
    spark = docs.sparkSession
    rows = common.written(voted(docs, doc_id, text, keep_text=True), "quality-votes")
    counted = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** 6 patterns at most
    width = len(labellers(F.lit("")))
    votes = np.array([r.votes for r in counted], np.int64).reshape(-1, width)
    model = expectation_maximisation(votes, np.array([r.n for r in counted], float))
    table = [(list(map(int, v)), float(p)) for v, p in zip(votes, model.posterior(votes))] if len(votes) else []
    known = spark.createDataFrame(table, "votes array<int>, weak_label double")
    held = rows.join(F.broadcast(known), "votes")
    sample = sampled(held, sample_rows, sample_bytes)
    scorer = train_scorer([r.text for r in sample], np.array([r.weak_label for r in sample]))
    sent = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.blocks(offsets):
                score = scorer.score(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                columns = {c: batch.column(c).slice(a, b - a) for c in ("doc_id", "votes", "weak_label")}
                columns |= {"score": pa.array(score, pa.float64()), "good": pa.array(score >= least_score, pa.bool_())}
                yield pa.RecordBatch.from_pydict(columns)

    held = held.select("doc_id", "text", "votes", "weak_label")
    return held.mapInArrow(run, common.schema_of(held, ("doc_id", "votes", "weak_label"), "score double, good boolean"))
