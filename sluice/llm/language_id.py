"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased, and everything but letters, and the marks on them, becomes one blank. Each learned language has an interpolated Kneser-Ney
model of character n-grams up to ORDER. For scoring, the n-grams of all languages share one sorted array of 64-bit hashes
for each order, with a column of log probabilities for each language; a position takes the longest n-gram that any language
has seen, with the back-off weights of the longer contexts. The language with the lowest cross-entropy a character wins. To
reject what looks like none of the languages, its cross-entropy is compared with that of texts set aside: those of the
language itself, and those of the others, which show how texts look that aren't of any language learned. For that each word
also counts under the language that suits it best, so that a text of several learned languages isn't rejected.

The models are fitted on whole texts of each language in the order of a hash, until they have `sample_chars` characters and
LEAST_TEXTS texts: a documented bound that holds at any corpus size, and leaves out no language.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common
from sluice.llm import kernels as K
from sluice.llm import tokens

ORDER = 5
SAMPLE_CHARS = 300_000
LEAST_TEXTS = 3
UNKNOWN = "und"
BLANK = 0x20
#: Places of texts in the order in which they are sampled.
PLACES = 1 << 62
#: A text is rejected that is REJECT_SHARE of the way from its language's mean to a language that isn't learned, and WORDED_SHARE
#: with each word under the language that suits it best, but not within REJECT_SIGMAS deviations or LEAST_NATS. With one
#: language learned, REJECT_NATS are what counts. NOISE_SIGMAS allow for short texts.
REJECT_SHARE, WORDED_SHARE, REJECT_SIGMAS, REJECT_NATS, LEAST_NATS, NOISE_SIGMAS = 0.6, 0.4, 8.0, 1.5, 1.0, 3.0


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """Whether each code point is a combining mark."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), bool, 0x110000)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with each run of other characters as one blank; a blank begins each text.

    A text without letters is a single blank.
    """
    kinds, _ = tokens._characters()
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8").lower() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    points = np.frombuffer(" ".join(["", *texts]).encode("utf-32-le"), np.uint32)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    letter, mark = kinds[points] == tokens.LETTER, _marks()[points]
    if mark.any():  # marks go with the letter before them
        last = np.maximum.accumulate(np.where(mark, 0, np.arange(len(points))))
        letter |= mark & letter[last]
    points = np.where(letter, points, BLANK).astype(np.uint32)
    keep = points != BLANK
    keep[1:] |= points[:-1] != BLANK
    keep[begin[:-1]] = True
    keep = keep[: begin[-1]]
    where = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=where[1:])
    return points[: begin[-1]][keep], where[begin]


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order, the hash of the n characters that end at each place."""
    values = tokens._characters()[1][points]
    out, h = [], np.zeros(len(points), np.uint64)
    for n in range(order):
        shifted = values if not n else np.concatenate([np.zeros(n, np.uint64), values[:-n]])[: len(values)]
        h = h + shifted * np.uint64(pow(0x9E3779B97F4A7C15, 2 * n + 1, 2**64))
        out.append(h ^ (h >> np.uint64(29)))
    return out


@dataclass
class Level:
    """Sorted hashes of n-grams with a row of log probabilities each, and of log back-off weights of the n-gram as a
    context; and a directory of the hashes' high bits."""

    keys: np.ndarray
    logs: np.ndarray
    backs: np.ndarray
    shift: int = 0
    directory: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    steps: int = 0

    def __post_init__(self) -> None:
        bits = max(1, int(np.ceil(np.log2(len(self.keys) + 1))) + 1)
        self.shift = 64 - bits
        self.directory = np.searchsorted(self.keys >> np.uint64(self.shift), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.directory).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        high = h >> np.uint64(self.shift)
        at, end = self.directory[high], self.directory[high + np.uint64(1)]
        out = np.full(len(h), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        for _ in range(self.steps):
            i = at[open_]
            same = self.keys[i] == h[open_]
            out[open_[same]] = i[same]
            at[open_] += 1
            open_ = open_[~same]
            open_ = open_[at[open_] < end[open_]]
            if not len(open_):
                break
        return out


@dataclass
class Limit:
    """What texts set aside tell of cross-entropies: by language the mean, the spread between long texts, and the noise of a
    single character; and the way from the mean to texts of a language that isn't learned."""

    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    way: float

    def beyond(self, entropy: np.ndarray, best: np.ndarray, size: np.ndarray, share: float) -> np.ndarray:
        least = np.maximum(share * self.way, np.maximum(LEAST_NATS, REJECT_SIGMAS * self.spread[best]))
        return entropy > self.mean[best] + least + NOISE_SIGMAS * self.noise[best] / np.sqrt(np.maximum(size, 1))


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]  # by order, 1 first
    floor: np.ndarray  # log probability of an unseen character
    #: For the cross-entropy under the winner, and for that with each word under the language that suits it best.
    whole: "Limit | None" = None
    worded: "Limit | None" = None

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text under each language, and the numbers of characters scored."""
        return self.measured(data, offsets)[:2]

    def measured(self, data: np.ndarray, offsets: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """entropies(), and the cross-entropy with each word under the language that suits it best (`without` one of them)."""
        points, begin = normalised(data, offsets)
        size = np.maximum(np.diff(begin) - 1, 0)
        if not len(self.languages) or not len(points):
            return np.zeros((len(size), len(self.languages))), size, np.zeros(len(size))
        own = np.zeros(len(points), np.int64)
        own[begin[:-1]] = begin[:-1]
        place = np.arange(len(points)) - np.maximum.accumulate(own)  # within the text
        grams = gram_hashes(points, len(self.levels))
        logs = np.zeros((len(points), len(self.languages)), np.float32)
        todo = np.flatnonzero(place > 0)
        for n in range(len(self.levels), 0, -1):
            level = self.levels[n - 1]
            deep = place[todo] >= n - 1
            able = todo[deep]
            found = level.find(grams[n - 1][able])
            hit = found >= 0
            logs[able[hit]] += level.logs[found[hit]]
            missed = able[~hit]
            if n > 1 and len(missed):
                context = self.levels[n - 2].find(grams[n - 2][missed - 1])
                logs[missed[context >= 0]] += self.levels[n - 2].backs[context[context >= 0]]
            todo = np.concatenate([todo[~deep], missed])
        logs[missed] += self.floor
        logs[begin[:-1]] = 0
        blanks = np.flatnonzero(points == BLANK)  # a blank begins each text, and each word
        words = np.add.reduceat(logs.astype(np.float64), blanks, axis=0)
        first = np.searchsorted(blanks, begin[:-1])
        best = (words if without is None else np.delete(words, without, axis=1)).max(axis=1, initial=-np.inf)
        sums, mixed = np.add.reduceat(words, first, axis=0), np.add.reduceat(best, first)
        return -sums / np.maximum(size, 1)[:, None], size, -mixed / np.maximum(size, 1)

    def rejects(self, entropy: np.ndarray, worded: np.ndarray, best: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether a text looks like none of the languages, and like no mixture of them either."""
        return self.whole.beyond(entropy, best, size, REJECT_SHARE) & self.worded.beyond(worded, best, size, WORDED_SHARE)


def _kneser_ney(counts: list[Counter], order: int) -> list[dict]:
    """Interpolated Kneser-Ney log probabilities of all n-grams seen, by order. counts: of the highest order, in strings."""
    levels = [None] * order
    levels[order - 1] = counts[order - 1]
    for n in range(order - 1, 0, -1):  # lower orders count the different characters that precede
        kinds: Counter = Counter()
        for g in levels[n]:
            kinds[g[1:]] += 1
        for g, c in counts[n - 1].items():
            if g[0] == " " and n > 1:  # n-grams that begin a word keep their own counts, as nothing precedes at a text's start
                kinds[g] = max(kinds[g], 1)
        levels[n - 1] = kinds
    alphabet = len(counts[0]) + 1
    probs: list[dict] = []
    for n in range(1, order + 1):
        table = levels[n - 1]
        ones, twos = sum(1 for c in table.values() if c == 1), sum(1 for c in table.values() if c == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total: Counter = Counter()
        kinds = Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        out = {}
        for g, c in table.items():
            context = g[:-1]
            lower = 1.0 / alphabet if n == 1 else probs[n - 2].get(g[1:], 1.0 / alphabet)
            out[g] = (c - discount) / total[context] + discount * kinds[context] / total[context] * lower
        out[None] = {k: discount * kinds[k] / total[k] for k in total}  # back-off weights of contexts
        probs.append(out)
    return probs


def _probability(probs: list[dict], gram: str, alphabet: int) -> float:
    p = probs[len(gram) - 1].get(gram)
    if p is not None:
        return p
    if len(gram) == 1:
        return probs[0][None].get("", 1.0) / alphabet
    return probs[len(gram) - 1][None].get(gram[:-1], 1.0) * _probability(probs, gram[1:], alphabet)


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """texts: whole texts of each language. A tenth of them, at most, calibrates the rejection."""
    languages = sorted(texts)
    fits: list[list[dict]] = []
    sizes: list[int] = []
    calibration: dict[str, list[str]] = {}
    for language in languages:
        own = texts[language]
        calibration[language] = own[::10] if len(own) >= 20 else own
        fitted = [t for i, t in enumerate(own) if i % 10 or len(own) < 20]
        counts = [Counter() for _ in range(order)]
        points, begin = normalised(*K.utf8(pa.array(fitted, pa.string())))
        whole = points.tobytes().decode("utf-32-le")
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            t = whole[a:b]
            for n in range(1, order + 1):
                counts[n - 1].update(map("".join, zip(*(t[i:] for i in range(n)))))
        sizes.append(len(counts[0]) + 1)
        fits.append(_kneser_ney(counts, order))
    levels = []
    for n in range(1, order + 1):
        grams = sorted({g for f in fits for g in f[n - 1] if g is not None})
        shape = len(grams), len(languages)
        logs = np.array([[np.log(_probability(f, g, s)) for f, s in zip(fits, sizes)] for g in grams], np.float32).reshape(shape)
        backs = [f[n][None] if n < order else {} for f in fits]
        backs = np.array([[np.log(b.get(g, 1.0)) for b in backs] for g in grams], np.float32).reshape(shape)
        points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
        keys = gram_hashes(points, n)[n - 1][n - 1 :: n] if grams else np.zeros(0, np.uint64)
        sort = np.argsort(keys)
        levels.append(Level(keys[sort], logs[sort], backs[sort]))
    floor = np.array([np.log(f[0][None].get("", 1.0) / s) for f, s in zip(fits, sizes)], np.float32)
    model = Model(languages, levels, floor)
    _calibrate(model, calibration)
    return model


def _calibrate(model: Model, texts: dict[str, list[str]]) -> None:
    """Limits from texts set aside. How a language looks that isn't learned is shown by each one's texts with itself left out:
    how far they are beyond the mean of the nearest other, in the median of the texts and of the languages."""
    n = len(model.languages)
    held = [K.utf8(pa.array(texts[language], pa.string())) for language in model.languages]
    known = [model.measured(*h) for h in held]
    without = [model.measured(*h, without=i) for i, h in enumerate(held)]
    limits = []
    for worded in (False, True):
        limit = Limit(np.zeros(n), np.zeros(n), np.zeros(n), REJECT_NATS / REJECT_SHARE)
        for i, (entropy, size, mixed) in enumerate(known):
            own, size = (mixed if worded else entropy[:, i])[size > 0], size[size > 0]
            if len(size):
                limit.mean[i] = np.average(own, weights=size)
                limit.spread[i] = np.sqrt(np.average((own - limit.mean[i]) ** 2, weights=size))
                limit.noise[i] = np.sqrt(np.mean((own - limit.mean[i]) ** 2 * size))
        ways = []
        for i, (entropy, size, mixed) in enumerate(without if n > 1 else []):
            others = np.where(np.arange(n) == i, np.inf, entropy)[size > 0]
            if len(others):
                nearest = others.argmin(axis=1)
                ways.append(np.median((mixed[size > 0] if worded else others.min(axis=1)) - limit.mean[nearest]))
        limit.way = float(np.median(ways)) if ways else limit.way
        limits.append(limit)
    model.whole, model.worded = limits


def fit(docs: DataFrame, training: str = "pmod(crc, 4) != 2", sample_chars: int = SAMPLE_CHARS, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Models of the languages of the training rows: those with `training` true (crc: crc32 of the id), lang and a text.

    The sample of each language is its whole texts in the order of a hash of id and text, until they have `sample_chars`
    characters and LEAST_TEXTS texts.
    """
    rows = docs.select(common.crc_of_id(doc_id).alias("crc"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("h"))
    rows = rows.where(F.expr(training) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod("h", F.lit(PLACES))
    # By eighths of a power of two, so that a bucket adds a tenth to those before it, or so, however large the corpus.
    rows = rows.withColumn("bucket", F.floor(8 * F.log2(place + 1)))
    held = rows.groupBy("lang", "bucket").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).collect()  # 500 a language at most
    if not held:
        return train({}, order)
    last: dict[str, int] = {}
    chars, n = Counter(), Counter()
    for r in sorted(held, key=lambda r: (r["lang"], r.bucket)):
        if chars[r["lang"]] < sample_chars or n[r["lang"]] < LEAST_TEXTS:
            last[r["lang"]] = r.bucket
        chars[r["lang"]] += r.chars
        n[r["lang"]] += r.n
    cut = F.lit(-1)
    for language, bucket in last.items():
        cut = F.when(F.col("lang") == language, bucket).otherwise(cut)
    sample = rows.where(F.col("bucket") <= cut).select("lang", "text", place.alias("place")).collect()  # sample_chars a language
    texts: dict[str, list[str]] = {}
    chars.clear()
    for r in sorted(sample, key=lambda r: (r["lang"], r.place, r.text)):
        own = texts.setdefault(r["lang"], [])
        if chars[r["lang"]] < sample_chars or len(own) < LEAST_TEXTS:
            own.append(r.text)
            chars[r["lang"]] += len(r.text)
    return train(texts, order)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `carried`, lang_pred, score, entropy, rejected: one row for each row.

    lang_pred is `und`, with score 0, entropy 0 and rejected, for a null text or one without letters (or if nothing was
    learned). Otherwise score is the winner's share of exp(-10 x cross-entropy) over the languages; ties go to the first
    language in sorted order. Only the named columns are read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *carried)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = K.utf8(batch.column("_text"))
            for a, b in K.blocks(offsets, K.BLOCK // 2):
                entropy, size, worded = model.measured(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                known = (size > 0) & (len(model.languages) > 0)
                if len(model.languages):
                    best = entropy.argmin(axis=1)
                    least = entropy[np.arange(len(best)), best]
                    score = 1 / np.exp(-10 * (entropy - least[:, None])).sum(axis=1)
                    names, rejected = np.array(model.languages, object)[best], model.rejects(least, worded, best, size)
                else:
                    names, score, least, rejected = np.full(len(size), UNKNOWN, object), np.zeros(len(size)), np.zeros(len(size)), np.ones(len(size), bool)
                columns = {c: batch.column(c).slice(a, b - a) for c in ("doc_id", *carried)} | {
                    "lang_pred": pa.array(np.where(known, names, UNKNOWN), pa.string()),
                    "score": pa.array(np.where(known, score, 0.0), pa.float64()),
                    "entropy": pa.array(np.where(known, least, 0.0), pa.float64()),
                    "rejected": pa.array(rejected | ~known, pa.bool_()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, common.schema_of(rows, ("doc_id", *carried), "lang_pred string, score double, entropy double, rejected boolean"))
