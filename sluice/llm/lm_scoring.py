"""Scoring of texts with a corpus-wide three-gram model in Elias-Fano tries.

Counts cover all training documents, and no task or driver ever holds the whole model. Documents are dealt into chunks.
A chunk asks for the corpus counts of the n-grams that its own documents hold: for each range of hashes it sends its
sorted distinct n-grams with their counts in its training documents. The task of a range adds up what all chunks sent and
answers each with the totals of what it asked for. A chunk then builds the model, filtered to the n-grams of its texts, as an
Elias-Fano trie of memory-mapped levels, and scores its documents by successor searches under each context.

The model, which sums to one at each level (hierarchical Dirichlet smoothing): p(w) = (c(w) + a) / (N + a (V + 1)),
p(w | v) = (c(v w) + m2 p(w)) / (c(v) + m2), p(w | u v) = (c(u v w) + m3 p(w | v)) / (c(u v) + m3). Two starts stand before
a text's first word. Among chunks n-grams are told apart by 52 bits of a hash: at 10^13 different ones, one in 450 shares
another's counts, but none counts more often than its context or what follows its first word, so that the trie holds both.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common
from sluice.llm import kernels as K
from sluice.llm.elias_fano import STEPS, Trie, quantised

ADDED = 0.1
#: m2 and m3, by the likelihood of held-out texts at sf0.1 (-3.38 a token; -3.58 with two words and m2 500 alone).
MASSES = (200.0, 2.0)
#: Bytes of text in a chunk and in a range: of small inputs, and at most.
CHUNK_BYTES, MOST_CHUNK_BYTES, RANGE_BYTES = 8 << 20, 128 << 20, 12 << 20
#: Hash of the end of a text.
END = np.uint64(0x5851F42D4C957F2D)
#: Hash of the starts before a text's first word: the last, so that n-grams in the order of their places are in that of hashes.
START = np.uint64(2**64 - 1)
ORDER, BITS = 3, 52
#: N-grams looked up at a time, which bounds the work space.
LOOKUPS = 1 << 17


def tokens_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's end included, and where each text's begin, and the end."""
    data, offsets = K.utf8(column)
    hashes, sizes = [], []
    for a, b in K.blocks(offsets):
        block, where = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = K.spans(block, where, K.SOLID_BYTES)
        hashes.append(np.insert(K.span_hashes(block, starts, ends, K.FOLDED_VALUES), first[1:], END))
        sizes.append(np.diff(first) + 1)
    begin = np.zeros(len(offsets), np.int64)
    if sizes:
        np.cumsum(np.concatenate(sizes), out=begin[1:])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), begin


@dataclass
class Grams:
    """The different n-grams of some texts, by order, in the order of their contexts and last words.

    context, word: of each, the place of its context among the n-grams one shorter (that of starts alone is their number),
    and of its last word among the words. key: its hash. of: for each token, the place of the n-gram that ends there.
    """

    context: list[np.ndarray]
    word: list[np.ndarray]
    key: list[np.ndarray]
    of: list[np.ndarray]


def grams_of(h: np.ndarray, begin: np.ndarray) -> Grams:
    words, of = np.unique(h, return_inverse=True)
    of = of.astype(np.int32)
    out = Grams([np.zeros(len(words), np.int32)], [np.arange(len(words), dtype=np.int32)], [words >> np.uint64(64 - BITS)], [of])
    whole, last = words, np.append(words, START)
    for n in range(2, ORDER + 1):
        both = np.empty(len(h), np.int64)
        both[1:] = out.of[-1][:-1]
        both[begin[:-1]] = len(last) - 1  # starts alone
        both *= len(words)
        both += out.of[0]
        both, of = np.unique(both, return_inverse=True)
        context, word = (x.astype(np.int32) for x in np.divmod(both, max(len(words), 1)))
        whole = K.mix(last[context] * np.uint64(0x9E3779B97F4A7C15) + words[word])
        out.context.append(context)
        out.word.append(word)
        out.key.append(whole >> np.uint64(64 - BITS))
        out.of.append(of.astype(np.int32))
        last = np.append(whole, START)
    return out


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in two bits each; those of 3 and more follow as bytes, and of these those of 255 and more in full."""
    fours = np.zeros(-(-len(counts) // 4) * 4, np.uint8)
    fours[: len(counts)] = np.minimum(counts, 3)
    fours = fours.reshape(-1, 4)
    more = counts[counts >= 3]
    bits = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    return b"".join((len(counts).to_bytes(8, "little"), bits.tobytes(), np.minimum(more, 255).astype(np.uint8).tobytes(), more[more >= 255].astype("<i8").tobytes()))


def unpack_counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    wide = -(-n // 4)
    fours = np.frombuffer(blob, np.uint8, wide, 8)
    out = np.empty((wide, 4), np.int64)
    for i in range(4):
        out[:, i] = fours >> (2 * i) & 3
    out = out.ravel()[:n]
    large = np.flatnonzero(out == 3)
    if len(large):
        more = np.frombuffer(blob, np.uint8, len(large), 8 + wide).astype(np.int64)
        more[more == 255] = np.frombuffer(blob, "<i8", offset=8 + wide + len(large))
        out[large] = more
    return out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps: whole low bytes, so many that what is above them is mostly 0 to 2, and that as counts."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = 8
    while len(gaps) and width > 1 and float(gaps.mean()) < 1.5 * 256.0 ** (width - 1):
        width -= 1
    low = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    high = gaps >> np.uint64(8 * width) if width < 8 else np.zeros(len(gaps), np.uint64)
    return bytes([width]) + len(gaps).to_bytes(8, "little") + keys[:1].astype("<u8").tobytes() + low.tobytes() + pack_counts(high.astype(np.int64))


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(blob, np.uint8, n * width, 17).reshape(n, width)
    gaps = gaps.view("<u8").ravel()
    if width < 8:
        gaps += unpack_counts(blob[17 + n * width :]).astype(np.uint64) << np.uint64(8 * width)
    return np.cumsum(np.concatenate([np.frombuffer(blob, "<u8", 1, 9), gaps]), dtype=np.uint64)


def _range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` equal ranges of the hashes begins among sorted keys, and the end."""
    edges = np.array([(i << BITS) // ranges for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _requests(table: pa.Table, ranges: int) -> pa.Table:
    h, begin = tokens_of(table.column("text"))
    train = np.repeat(table.column("train").to_numpy(), np.diff(begin))
    grams = grams_of(h, begin)
    keys, counts = [[] for _ in range(ranges)], [[] for _ in range(ranges)]
    for key, of in zip(grams.key, grams.of):
        n = np.bincount(of[train], minlength=len(key))
        order = np.argsort(key)
        key, n = key[order], n[order]
        cuts = _range_cuts(key, ranges)
        for r in range(ranges):
            keys[r].append(pack_sorted(key[cuts[r] : cuts[r + 1]]))
            counts[r].append(pack_counts(n[cuts[r] : cuts[r + 1]]))
    chunk = table.column("chunk")[0].as_py()
    binaries = pa.list_(pa.binary())
    return pa.table({"part": pa.array(range(ranges), pa.int32()), "chunk": pa.array([chunk] * ranges, pa.int32()), "keys": pa.array(keys, binaries), "counts": pa.array(counts, binaries)})


def _answers(table: pa.Table) -> pa.Table:
    keys, counts = table.column("keys"), table.column("counts")
    out: list[list[bytes]] = [[] for _ in range(len(table))]
    types = tokens = 0
    for n in range(ORDER):
        parts = [unpack_sorted(k[n].as_py()) for k in keys]
        u, which = np.unique(np.concatenate(parts), return_inverse=True)
        own = np.concatenate([unpack_counts(c[n].as_py()) for c in counts])
        totals = np.bincount(which, own, len(u)).astype(np.int64)
        at = 0
        for i, p in enumerate(parts):
            out[i].append(pack_counts(totals[which[at : at + len(p)]]))
            at += len(p)
        if not n:
            types, tokens = int((totals > 0).sum()), int(totals.sum())
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "part": table.column("part"),
            "types": pa.array([types] * len(keys), pa.int64()),
            "tokens": pa.array([tokens] * len(keys), pa.int64()),
            "totals": pa.array(out, pa.list_(pa.binary())),
        }
    )


def _totals(grams: Grams, answers: pa.Table) -> list[np.ndarray]:
    """The corpus counts of the n-grams of each order."""
    blobs, out = answers.column("totals").to_pylist(), []
    for n, key in enumerate(grams.key):
        total = np.empty(len(key), np.int64)
        total[np.argsort(key)] = np.concatenate([unpack_counts(b[n]) for b in blobs])
        out.append(total)
    return out


def _below(grams: Grams, n: int) -> np.ndarray:
    """Of each n-gram of the order's place n, the place of that without its first word."""
    if n == 1:
        return grams.word[n]
    out = np.empty(len(grams.key[n]), np.int32)
    out[grams.of[n]] = grams.of[n - 1]
    return out


def _bounded(grams: Grams, totals: list[np.ndarray], starts: int) -> list[np.ndarray]:
    """The totals, none above that of its context or of the n-gram without its first word, as they are but for shared hashes."""
    out = totals[:1]
    for n in range(1, ORDER):
        above = np.append(out[n - 1], starts)[grams.context[n]]
        out.append(np.minimum(totals[n], np.minimum(above, out[n - 1][_below(grams, n)])))
    return out


def _trie(folder: str, words: np.ndarray, grams: Grams, totals: list[np.ndarray], starts: int, p1: np.ndarray, masses: tuple[float, ...]) -> tuple[Trie, list[np.ndarray]]:
    """The trie of the n-grams that occur in the corpus, and of each order but the last the log weights of falling back.

    Starts stand last at each level but that of the longest n-grams.
    """

    def placed(held: np.ndarray, n: int) -> np.ndarray:
        """From the place among the n-grams, and behind them that of starts alone, to the place in the trie's level."""
        out = np.full(n + 1, -1, np.int32)
        out[held] = np.arange(len(held))
        out[n] = len(held)
        return out

    held = np.flatnonzero(totals[0])
    place = id_of = placed(held, len(words))
    first, logs, counts = np.append(words[held], START), np.append(np.log10(p1[held]), 0.0), np.append(totals[0][held], starts)
    levels, weights, p = [], [], p1
    for n in range(1, ORDER):
        weights.append(np.log10(masses[n - 1] / (counts + masses[n - 1])))
        above = np.append(totals[n - 1], starts)[grams.context[n]]
        p = (totals[n] + masses[n - 1] * p[_below(grams, n)]) / (above + masses[n - 1])
        held = np.flatnonzero(totals[n])
        at, ids, own, counts = place[grams.context[n][held]], id_of[grams.word[n][held]], np.log10(p[held]), totals[n][held]
        place = placed(held, len(grams.key[n]))
        if n + 1 < ORDER:  # starts after starts are a context of the next order
            at, ids, own, counts = np.append(at, _starts(levels, first)), np.append(ids, id_of[-1]), np.append(own, 0.0), np.append(counts, starts)
        levels.append((at, ids, own))
    return Trie(first, logs, levels, folder), weights


def _starts(levels: list, first: np.ndarray) -> int:
    """Where starts stand in the last level so far."""
    return len(levels[-1][0]) - 1 if levels else len(first) - 1


def _scores(docs: pa.Table, answers: pa.Table, added: float, masses: tuple[float, ...]) -> pa.Table:
    """Scores of a chunk's documents from the totals of the n-grams it asked for."""
    h, begin = tokens_of(docs.column("text"))
    grams = grams_of(h, begin)
    answers = answers.sort_by("part")
    n, v = (int(np.sum(answers.column(c).to_numpy())) for c in ("tokens", "types"))
    totals = _totals(grams, answers)
    words = np.zeros(len(grams.key[0]), np.uint64)
    words[grams.of[0]] = h
    del h
    p1 = (totals[0] + added) / (n + added * (v + 1))
    base = np.log10(p1)
    starts = int(totals[0][words == END].sum())
    totals = _bounded(grams, totals, starts)
    with tempfile.TemporaryDirectory(prefix="trie-") as folder:
        trie, weights = _trie(folder, words, grams, totals, starts, p1, masses)
        weights = [quantised(w) for w in weights]
        # Level by level from what has been found above: steps of the log of each n-gram, and its place, or -1.
        ids = np.append(trie.word_ids(words), trie.word_ids(np.array([START]))[0])
        unseen = int(quantised(np.log10(np.array([added / (n + added * (v + 1))])))[0])
        steps = np.where(ids >= 0, trie.steps(1, np.maximum(ids, 0)), unseen)[:-1].astype(np.int32)
        place = ids
        for k in range(1, ORDER):
            below, upper = _below(grams, k), steps
            found, steps = np.empty(len(below) + 1, np.int32), np.empty(len(below), np.int32)
            for a in range(0, len(below), LOOKUPS):
                part = slice(a, min(a + LOOKUPS, len(below)))
                context = place[grams.context[k][part]]
                found[part] = at = trie.child(k + 1, context, ids[grams.word[k][part]])
                fall = np.where(context >= 0, weights[k - 1][np.maximum(context, 0)], 0) + upper[below[part]]
                steps[part] = np.where(at >= 0, trie.steps(k + 1, np.maximum(at, 0)), fall)
            if k + 1 < ORDER:
                found[-1] = trie.child(k + 1, ids[-1:], ids[-1:])[0]
            place = found
        trie.close()
    first = begin[:-1]
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "held_out": pa.array(~docs.column("train").to_numpy(), pa.bool_()),
            "n_tokens": pa.array(np.diff(begin), pa.int64()),
            "n_known": pa.array(np.add.reduceat((totals[0] > 0)[grams.of[0]].astype(np.int64), first), pa.int64()),
            "train_tokens": pa.array(np.full(len(first), n), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base[grams.of[0]], first), pa.float64()),
            "score": pa.array(np.add.reduceat(steps[grams.of[-1]].astype(np.int64), first) / -STEPS, pa.float64()),
        }
    )


def score(docs: DataFrame, held_out: str = "pmod(crc, 10) = 0", added: float = ADDED, masses: tuple[float, float] = MASSES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row.

    Training rows are those for which `held_out` (crc: crc32 of the id as text, of an empty text for a null id) is not
    true. A null text is an empty one, which has the end as its only token. Repeated rows count, and are returned, as often
    as they stand there; without training rows every token is unseen. Only the named columns are read.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
    # Messages between chunks and ranges hold a kilobyte or so at 100 TB, so that their number doesn't matter yet.
    chunk_bytes = max(CHUNK_BYTES, min(MOST_CHUNK_BYTES, size // 4096))
    chunks, ranges = max(16, -(-size // chunk_bytes)), max(12, -(-size // max(RANGE_BYTES, chunk_bytes)))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        common.crc_of_id(doc_id).alias("crc"),
        F.pmod(F.xxhash64(doc_id, text), F.lit(chunks)).cast("int").alias("chunk"),
    ).select("doc_id", "text", (~F.expr(held_out)).alias("train"), "chunk")
    asked = rows.groupBy("chunk").applyInArrow(lambda t: _requests(t, ranges), "part int, chunk int, keys array<binary>, counts array<binary>")
    answered = asked.groupBy("part").applyInArrow(_answers, "chunk int, part int, types long, tokens long, totals array<binary>")
    out = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(lambda d, a: _scores(d, a, added, masses), out)
