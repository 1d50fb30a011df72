"""Similarity join of documents on word n-grams, with Bayesian pruning of candidate pairs over MinHash signatures.

Documents of equal word sequences are one node, so copies are never expanded into pairs. Nodes that share a band of their
signatures are candidates. A pair's signatures are compared a few values at a time; with a uniform prior on the similarity,
the posterior probability that it reaches the threshold after s equal values of t is P(Binomial(t + 1, threshold) <= s), and
the pair is dropped once that is below a tolerance. What is left is verified exactly on the n-gram sets.

No pair is ever a row. A cell of candidates gives each member the least member that it hangs together with; the components
of these links hold all pairs that are left, and are verified in cells of a bounded number of members: larger ones are cut
into blocks, and each pair of blocks is a cell. A cell gives for each member the number of its links and the least member
linked to it, so that a group of m near copies gives rows in proportion to m times its number of blocks.

The bands miss a pair at the threshold with probability 3e-6, and the pruning drops it with about the tolerance each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import common
from sluice.llm import kernels as K
from sluice.llm.components import components

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, BAND_ROWS, STEP = 24, 4, 16
HASHES = BANDS * BAND_ROWS
#: Most members of a block of candidates, and of a block to verify, which holds texts.
CANDIDATE_BLOCK, VERIFY_BLOCK = 512, 64
MOST_PAIRS = 1 << 20

_rng = np.random.Generator(np.random.PCG64(77))
_XORS = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_FACTORS = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, repeats included, and where each text's begin, and the end."""
    starts, ends, first = K.spans(data, offsets, K.WORD_BYTES)
    return K.window_hashes(K.span_hashes(data, starts, ends, K.FOLDED_VALUES), first, words)


def signatures(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash values of each non-empty text, a row each."""
    rows = np.flatnonzero(np.diff(begin))
    out = np.empty((len(rows), HASHES), np.uint32)
    if len(rows):
        high = (h >> np.uint64(32)).astype(np.uint32)
        for j in range(HASHES):
            out[:, j] = np.minimum.reduceat((high ^ _XORS[j]) * _FACTORS[j], begin[rows])
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of steps, how many equal values a pair needs so that it isn't dropped."""
    out = []
    for t in range(STEP, HASHES + 1, STEP):
        s, p = -1, 0.0
        while p < tolerance:
            s += 1
            p += comb(t + 1, s) * threshold**s * (1 - threshold) ** (t + 1 - s)
        out.append(s)
    return out


def likely_pairs(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that Bayesian pruning leaves."""
    matched = np.zeros(len(i), np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matched += (sig[i, part] == sig[j, part]).sum(axis=1)
        keep = matched >= need
        i, j, matched = i[keep], j[keep], matched[keep]
    return i, j


def all_pairs(cell: np.ndarray, block: np.ndarray, across: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in one cell, MOST_PAIRS or so at a time; where `across`, only of different blocks. cell: sorted."""
    n = len(cell)
    end = np.searchsorted(cell, cell, side="right")
    later = end - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(later)])
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(total, total[first] + MOST_PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(first, last), later[first:last])
        j = np.arange(len(i)) - (total[i] - total[first]) + i + 1
        keep = ~across[i] | (block[i] != block[j])
        yield i[keep], j[keep]
        first = last


def least_linked(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n rows, the row of least `order` among those it hangs together with."""
    rank = np.empty(n, np.int64)
    by_rank = np.argsort(order, kind="stable")
    rank[by_rank] = np.arange(n)
    label = rank.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[by_rank[new]])
        if (new == label).all():
            return by_rank[label]
        label = new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, with a group number for each row."""

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if not len(rest):
            continue
        group = numbered(rest)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield rest.slice(0, cut).combine_chunks(), group[:cut]
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield rest.combine_chunks(), numbered(rest)


def _signature_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, h, key, sig, bands of each row; the last three are null for a text without words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.blocks(offsets):
                h, begin = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                rows = np.flatnonzero(np.diff(begin))
                sig = signatures(h, begin)
                bands = np.zeros((len(rows), BANDS), np.uint64)
                for k in range(BAND_ROWS):
                    bands = (bands ^ sig[:, k::BAND_ROWS]) * np.uint64(0x9E3779B97F4A7C15)
                bands = K.mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                # The sequence of n-grams stands for that of the words, which it gives back.
                place = (np.arange(len(h)) - np.repeat(begin[:-1], np.diff(begin))).astype(np.uint64)
                sums = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(K.mix(h + place * np.uint64(0xA0761D6478BD642F)), out=sums[1:])
                key = K.mix(sums[begin[1:]] - sums[begin[:-1]]).view(np.int64)
                filled = np.diff(begin) > 0
                where = np.cumsum(filled) - 1
                low = (sig & 0xFFFF).astype(np.uint16)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "h": batch.column("h").slice(a, b - a),
                        "key": pa.array(key, pa.int64(), mask=~filled),
                        "sig": pa.array([low[i].tobytes() if f else None for i, f in zip(where.tolist(), filled.tolist())], pa.binary()),
                        "bands": pa.array([bands[i].view(np.int64) if f else None for i, f in zip(where.tolist(), filled.tolist())], pa.list_(pa.int64())),
                    }
                )

    return docs.mapInArrow(run, f"doc_id {id_type}, h long, key long, sig binary, bands array<long>")


def _in_blocks(members: DataFrame, size: Column, most: int) -> DataFrame:
    """members with block, low, high: the pairs of blocks that each member meets; (0, 0) alone for a group of one block."""
    blocks = F.ceil(size / most).cast("int")
    out = members.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")


def _by_cell(rows: DataFrame, keys: list[str], function: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cell in whole_groups(batches, keys):
            yield from function(t, cell)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _candidates(t: pa.Table, cell: np.ndarray, least: list[int]) -> Iterator[pa.RecordBatch]:
    """Links of the members of cells to the least member that they hang together with."""
    sig, key = _signature_matrix(t.column("sig")), t.column("key").to_numpy()
    across = t.column("low").to_numpy() != t.column("high").to_numpy()
    left = [likely_pairs(sig, i, j, least) for i, j in all_pairs(cell, t.column("block").to_numpy(), across)]
    i, j = (np.concatenate([x[k] for x in left]) for k in range(2))
    if len(i):
        root = least_linked(len(key), i, j, key)
        other = np.flatnonzero(root != np.arange(len(key)))
        yield pa.RecordBatch.from_pydict({"a": pa.array(key[other], pa.int64()), "b": pa.array(key[root[other]], pa.int64())})


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if not len(i):
        return np.zeros(0, np.int64)
    members = np.unique(np.concatenate([i, j]))
    size = np.array([len(sets[m]) for m in members])
    flat = np.concatenate([sets[m] for m in members])
    _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[ids] > 1
    owner = np.repeat(np.arange(len(members)), size)[shared]
    columns = np.unique(ids[shared], return_inverse=True)[1] if shared.any() else np.zeros(0, np.int64)
    width = int(columns.max()) + 1 if len(columns) else 0
    a, b = np.searchsorted(members, i), np.searchsorted(members, j)
    if len(members) ** 2 * width < 2000 * len(i) * max(1, float(size.mean())):
        out = np.zeros((len(members), len(members)), np.float32)
        order = np.argsort(columns, kind="stable")
        owner, columns = owner[order], columns[order]
        for at in range(0, width, 4096):  # columns by part: a bounded matrix for texts of any length
            x, y = np.searchsorted(columns, [at, at + 4096])
            m = np.zeros((len(members), min(4096, width - at)), np.float32)
            m[owner[x:y], columns[x:y] - at] = 1
            out += m @ m.T
        return np.rint(out[a, b]).astype(np.int64)
    begin = np.searchsorted(owner, np.arange(len(members) + 1))
    own = [columns[x:y] for x, y in zip(begin[:-1], begin[1:])]
    mark, out, last = np.zeros(width, bool), np.zeros(len(a), np.int64), -1
    for k in np.argsort(a, kind="stable").tolist():
        if a[k] != last:
            if last >= 0:
                mark[own[last]] = False
            last = a[k]
            mark[own[last]] = True
        out[k] = mark[own[b[k]]].sum()
    return out


def _verified(t: pa.Table, cell: np.ndarray, least: list[int], words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """key, root, links for each member that is linked in its cell."""
    edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist() + [len(cell)]
    keys, roots, links = [], [], []
    for x, y in zip(edges[:-1], edges[1:]):
        part = t.slice(x, y - x)
        sig, key, weight = _signature_matrix(part.column("sig")), part.column("key").to_numpy(), part.column("n").to_numpy()
        across = part.column("low").to_numpy() != part.column("high").to_numpy()
        left = [likely_pairs(sig, i, j, least) for i, j in all_pairs(np.zeros(y - x, np.int64), part.column("block").to_numpy(), across)]
        i, j = (np.concatenate([p[k] for p in left]) for k in range(2))
        if not len(i):
            continue
        h, begin = shingles(*K.utf8(part.column("text")), words)
        sets = [np.unique(h[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        size = np.array([len(s) for s in sets])
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        keep = small >= threshold * large - 1e-9
        i, j = i[keep], j[keep]
        both = intersections(sets, i, j)
        keep = both >= threshold * (size[i] + size[j] - both) - 1e-9
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        n = np.bincount(i, weight[j], y - x) + np.bincount(j, weight[i], y - x)
        root = least_linked(y - x, i, j, key)
        own = np.flatnonzero(n)
        keys.append(key[own])
        roots.append(key[root[own]])
        links.append(n[own])
    if keys:
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array(np.concatenate(keys), pa.int64()), "root": pa.array(np.concatenate(roots), pa.int64()), "links": pa.array(np.rint(np.concatenate(links)).astype(np.int64), pa.int64())}
        )


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, tolerance: float = TOLERANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h, class_id, n_links, leads: one row for each row.

    Two rows are linked if the Jaccard similarity of their sets of `words` consecutive words (A-Z lower-cased) reaches the
    threshold. n_links is the number of other rows that a row is linked with, and class_id the least doc_id of the rows that
    it hangs together with by links. A text of fewer words is one n-gram. A null text, or one without words, has no links
    and its own id as class. Repeated rows are copies of each other. Null ids are left out of a class's least id, and a class
    of null ids only has a null id. leads marks the rows of a class with the least id and, among these, text hash: they are
    repeated rows if there are several. h is the hash of the text (of an empty one for null). Only the named columns are read.
    """
    least = least_matches(threshold, tolerance)
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    signed = common.written(_signed(whole, words), "join-signed")
    nodes = signed.where(F.col("key").isNotNull()).groupBy("key")
    nodes = nodes.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))).alias("first"), F.min(F.struct("h", "doc_id")).alias("one"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = common.written(nodes, "join-nodes")

    band = nodes.select("key", F.explode("bands").alias("band"))
    busy = common.written(band.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "join-busy")
    members = common.written(band.join(busy, "band"), "join-members")
    cells = _in_blocks(members, F.col("size"), CANDIDATE_BLOCK).join(nodes.select("key", "sig"), "key").select("band", "low", "high", "block", "key", "sig")
    links = _by_cell(cells, ["band", "low", "high"], lambda t, c: _candidates(t, c, least), "a long, b long")
    groups = common.written(components(links), "join-groups")

    sizes = common.written(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "join-sizes")
    members = groups.withColumnRenamed("node", "key").join(sizes, "root")
    rows = members.join(nodes.select("key", "n", "sig", "one"), "key").select("root", "size", "key", "n", "sig", F.col("one.doc_id").alias("i"), F.col("one.h").alias("j"))
    texts = whole.join(rows, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))).drop("doc_id", "h", "i", "j").dropDuplicates(["key"])
    cells = _in_blocks(texts, F.col("size"), VERIFY_BLOCK).select("root", "low", "high", "block", "key", "n", "sig", "text")
    linked = _by_cell(cells, ["root", "low", "high"], lambda t, c: _verified(t, c, least, words, threshold), "key long, root long, links long")
    linked = common.written(linked, "join-linked")

    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    classes = common.written(classes.join(counts, "key").join(nodes.select("key", "n", "first"), "key"), "join-classes")
    ids = common.written(classes.groupBy("root").agg(F.min("first").alias("leader")), "join-ids")
    classes = common.written(classes.join(ids, "root").select("key", "leader", "links"), "join-named")
    named = nodes.select("key", "n", "first").join(classes, "key", "left")
    named = named.select("key", F.coalesce("leader", "first").alias("leader"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    named = common.written(named, "join-result")
    found = signed.where(F.col("key").isNotNull()).join(named, "key")
    leads = F.col("doc_id").eqNullSafe(F.col("leader.id")) & (F.col("h") == F.col("leader.h"))
    found = found.select("doc_id", "h", F.col("leader.id").alias("class_id"), "n_links", leads.alias("leads"))
    alone = signed.where(F.col("key").isNull()).select("doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("leads"))
    return found.unionByName(alone)
