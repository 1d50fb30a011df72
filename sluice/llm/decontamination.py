"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words (A-Z lower-cased; runs of digits, letters and characters beyond ASCII) and their word
sequences are put into one suffix automaton. Each document's words are streamed through it, which gives at every word the
longest suffix that occurs in some item. A word is hit if an occurrence of a window covers it: `window` consecutive words
of an item, or a whole shorter item.

The automaton goes to the executors in parts of a bounded number of item words (MOST_WORDS, about 60 bytes each); a larger
benchmark makes several passes, each with one part, between which the rows are written, so that no worker holds two.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common
from sluice.llm import kernels as K

WINDOW = 10
MOST_WORDS = 2_000_000


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of numbers from 0.

    In flat arrays: most states have one transition, which is held by its symbol and target; the others of a state are in a
    dictionary of their own.
    """

    def __init__(self) -> None:
        self.symbol, self.target = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def following(self, state: int, c: int) -> int:
        """The state after symbol c, or -1."""
        if self.symbol[state] == c:
            return self.target[state]
        more = self.more.get(state)
        return more.get(c, -1) if more else -1

    def _lead(self, state: int, c: int, to: int) -> None:
        if self.symbol[state] in (-1, c):
            self.symbol[state], self.target[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _extend(self, last: int, c: int) -> int:
        if (q := self.following(last, c)) >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and (q := self.following(p, c)) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q])
        self.symbol[copy], self.target[copy] = self.symbol[q], self.target[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self.following(p, c) == q:
            self._lead(p, c, copy)
            p = self.link[p]
        return copy

    def _state(self, length: int, link: int) -> int:
        for held, value in ((self.symbol, -1), (self.target, -1), (self.length, length), (self.link, link)):
            held.append(value)
        return len(self.link) - 1

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix that occurs, after one more symbol."""
        while (to := self.following(state, c)) < 0:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return to, matched + 1

    def ancestor(self, state: int, size: int) -> int:
        """The state of the suffix of `size` symbols of what led to `state`."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state


class Matcher:
    """Finds windows of items in documents' word hashes."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW) -> None:
        self.window = window
        texts = pa.array([t or "" for _, t in items], pa.string())
        data, offsets = K.utf8(texts)
        starts, ends, first = K.spans(data, offsets, K.WORD_BYTES)
        h = K.span_hashes(data, starts, ends, K.FOLDED_VALUES)
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h).tolist()
        self.automaton = SuffixAutomaton()
        sequences = [ids[first[i] : first[i + 1]] for i in range(len(items))]
        for s in sequences:
            self.automaton.add(s)
        #: By the state of a window, its item's place, or for several -2 - the place of their set; short items by their state and length.
        self.names = [str(name) for name, _ in items]
        self.owner = array("i", [-1]) * len(self.automaton.link)
        self.shared: list[set[int]] = []
        self.short: dict[tuple[int, int], set[int]] = {}
        for item, s in enumerate(sequences):
            if not s:
                continue
            state = matched = 0
            for c in s:
                state, matched = self.automaton.step(state, matched, c)
                if matched >= window:
                    self._own(self.automaton.ancestor(state, window), item)
            if len(s) < window:
                self.short.setdefault((self.automaton.ancestor(state, len(s)), len(s)), set()).add(item)
        self.short_sizes = sorted({n for _, n in self.short})
        self.least = min([window, *self.short_sizes])

    def _own(self, state: int, item: int) -> None:
        held = self.owner[state]
        if held < -1:
            self.shared[-2 - held].add(item)
        elif held == -1:
            self.owner[state] = item
        elif held != item:
            self.shared.append({held, item})
            self.owner[state] = -1 - len(self.shared)

    def hits(self, words: list[int], seen: set[str]) -> Iterator[tuple[int, int]]:
        """Ranges [from, to) of words that windows cover; adds the items to `seen`."""
        step, ancestor, window = self.automaton.step, self.automaton.ancestor, self.window
        state = matched = 0
        for i, c in enumerate(words):
            state, matched = step(state, matched, c)
            if matched >= window:
                held = self.owner[ancestor(state, window)]
                seen.update(self.names[k] for k in (self.shared[-2 - held] if held < -1 else (held,)))
                yield i + 1 - window, i + 1
            for n in self.short_sizes:
                if n <= matched and (found := self.short.get((ancestor(state, n), n))):
                    seen.update(self.names[k] for k in found)
                    yield i + 1 - n, i + 1

    def match(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and each row's items. first: where each row's words begin, and the end."""
        hit, items = np.zeros(len(h), bool), [set() for _ in range(len(first) - 1)]
        if not len(self.vocabulary) or not len(h):
            return hit, items
        ids = np.searchsorted(self.vocabulary, h)
        ids[ids == len(self.vocabulary)] = 0
        known = self.vocabulary[ids] == h
        # Only runs of known words, as long as the shortest window at least, can hold a window.
        begins, ends = known.copy(), known.copy()
        begins[1:] &= ~known[:-1]
        ends[:-1] &= ~known[1:]
        cuts = first[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(h))]
        begins[cuts], ends[cuts - 1] = known[cuts], known[cuts - 1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        enough = ends - begins >= self.least
        begins, ends = begins[enough], ends[enough]
        rows = np.searchsorted(first, begins, side="right") - 1
        for row, a, b in zip(rows.tolist(), begins.tolist(), ends.tolist()):
            for x, y in self.hits(ids[a:b].tolist(), items[row]):
                hit[a + x : a + y] = True
        return hit, items


OUT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _parts(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """Items in parts of MOST_WORDS words at most (or one longer item), so that what is broadcast is bounded."""
    part, size = [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len(r.t or "") // 2 + 1
        if part and size + n > MOST_WORDS:
            yield part
            part, size = [], 0
        part.append((r.i, r.t))
        size += n
    if part:
        yield part


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", keep_text: bool = False) -> DataFrame:
    """Hits of each document: doc_id, n_words, n_hit, items (sorted ids of items with an occurring window), spans.

    spans are code point ranges of the text from the first to the last word of each run of hit words. Null texts have no
    words; items without words match nothing; null item ids are named "None". Repeated rows each give a row. With
    keep_text the text comes too. Other columns of the inputs are not read.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = [spark.sparkContext.broadcast(Matcher(p, window)) for p in _parts(benchmark, item_id, text)] or [
        spark.sparkContext.broadcast(Matcher([], window))
    ]
    return _passes(out, parts, keep_text)


def _passes(rows: DataFrame, parts: list, keep_text: bool, carried: tuple[str, ...] = ()) -> DataFrame:
    """One pass after the other over doc_id, text and `carried`, each from a written table."""
    for k, part in enumerate(parts):
        if k:
            rows = common.written(rows, "decontamination-pass")
        rows = _pass(rows, part, k > 0, keep_text or k + 1 < len(parts), carried)
    return rows


def _pass(docs: DataFrame, part, more: bool, keep_text: bool, carried: tuple[str, ...] = ()) -> DataFrame:
    kept = ("doc_id", *(["text"] if keep_text else []), *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = part.value
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.blocks(offsets):
                rows = batch.slice(a, b - a)
                block, where = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = K.spans(block, where, K.WORD_BYTES)
                h = K.span_hashes(block, starts, ends, K.FOLDED_VALUES)
                hit, items = matcher.match(h, first)
                if more:
                    _earlier(rows, block, where, starts, first, hit, items)
                yield _result(rows, block, where, starts, ends, first, hit, items, kept)

    return docs.mapInArrow(run, common.schema_of(docs, kept, OUT))


def _points(block: np.ndarray, at: np.ndarray, origin: int) -> np.ndarray:
    """Code points from byte `origin` to each byte of `at`."""
    text = block[origin : int(at.max()) if len(at) else origin]
    return np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])[at - origin]


def _earlier(rows, block, where, starts, first, hit, items) -> None:
    """Adds what former passes found."""
    found, spans = rows.column("items").to_pylist(), rows.column("spans").to_pylist()
    for i, names in enumerate(found):
        items[i].update(names)
        if spans[i]:
            own = _points(block, starts[first[i] : first[i + 1]], int(where[i]))
            for s in spans[i]:
                hit[first[i] : first[i + 1]] |= (own >= s["start"]) & (own < s["end"])


def _result(rows, block, where, starts, ends, first, hit, items, kept: tuple[str, ...]) -> pa.RecordBatch:
    spans = []
    n_hit = K.segment_sums(hit.astype(np.int64), first)
    for i, n in enumerate(n_hit.tolist()):
        if not n:
            spans.append([])
            continue
        own = hit[first[i] : first[i + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        froms = _points(block, starts[first[i] + edge[::2]], int(where[i]))
        tos = _points(block, ends[first[i] + edge[1::2] - 1], int(where[i]))
        spans.append([{"start": x, "end": y} for x, y in zip(froms.tolist(), tos.tolist())])
    columns = {c: rows.column(c) for c in kept} | {
        "n_words": pa.array(np.diff(first), pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    }
    return pa.RecordBatch.from_pydict(columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def cut(text: str | None, spans: list) -> str | None:
    """The text without the spans; one space stands in for each."""
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return " ".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, doc_id: str = "doc_id", text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns `carried`, n_words, n_hit, dropped: texts without hit spans, again until no window is left.

    One row for each row; a null text stays null and is never dropped, and an empty one stays too. n_words and n_hit are of
    the text as it came. dropped: more than `most_coverage` of its words were hit. Repeated rows are treated alike. Without
    items nothing is cut. Only the named columns are read, so that others may clash. A benchmark of several parts makes
    passes over written tables; texts that were cut are looked through again, the others are not.
    """
    spark = docs.sparkSession
    parts = [spark.sparkContext.broadcast(Matcher(p, window)) for p in _parts(benchmark, "item_id", "text")] or [spark.sparkContext.broadcast(Matcher([], window))]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carried)
    if len(parts) == 1:
        return _cleaned_at_once(source, parts[0], most_coverage, carried)
    # Names that can't clash with those of the passes.
    names = {c: f"_carried{i}" for i, c in enumerate(carried)}
    source, carried = source.withColumnsRenamed(names), tuple(names.values())
    kept = ("doc_id", "text", *carried)
    # The first look tells what counts and goes; later ones cut what joined up at a cut.
    cutting = F.udf(cut, "string", useArrow=False)
    rows = common.written(_passes(source, parts, True, carried), "decontamination-hits")
    dropped = (F.col("n_hit") > most_coverage * F.greatest(F.col("n_words"), F.lit(1))).alias("dropped")
    done = [rows.where("n_hit = 0").select(*kept, "n_words", "n_hit", dropped)]
    left = rows.where("n_hit > 0").select("doc_id", cutting("text", "spans").alias("text"), *carried, F.col("n_words").alias("_words"), F.col("n_hit").alias("_hit"))
    more = ("_words", "_hit", *carried)
    while True:
        rows = common.written(_passes(left, parts, True, more), "decontamination-hits")
        whole = rows.where("n_hit = 0").select(*kept, F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"))
        done.append(whole.select(*kept, "n_words", "n_hit", dropped))
        rows = rows.where("n_hit > 0")
        if rows.isEmpty():
            break
        left = rows.select("doc_id", cutting("text", "spans").alias("text"), *more)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnsRenamed({v: k for k, v in names.items()})


def _cleaned_at_once(source: DataFrame, part, most_coverage: float, carried: tuple[str, ...]) -> DataFrame:
    def once(texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        data, offsets = K.utf8(texts)
        starts, ends, first = K.spans(data, offsets, K.WORD_BYTES)
        h = K.span_hashes(data, starts, ends, K.FOLDED_VALUES)
        hit, items = part.value.match(h, first)
        r = _result(pa.RecordBatch.from_pydict({"text": texts}), data, offsets, starts, ends, first, hit, items, ())
        return r.column("spans").to_pylist(), np.diff(first), r.column("n_hit").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = K.utf8(batch.column("text"))
            for a, b in K.blocks(offsets):
                rows = batch.slice(a, b - a)
                spans, n_words, n_hit = once(rows.column("text"))
                texts = rows.column("text").to_pylist() if n_hit.any() else None
                for i in np.flatnonzero(n_hit).tolist():
                    left = spans[i]
                    while left:
                        texts[i] = cut(texts[i], left)
                        left = once(pa.array([texts[i]], pa.string()))[0][0]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id"),
                        "text": rows.column("text") if texts is None else pa.array(texts, pa.string()),
                        **{c: rows.column(c) for c in carried},
                        "n_words": pa.array(n_words, pa.int64()),
                        "n_hit": pa.array(n_hit, pa.int64()),
                        "dropped": pa.array(n_hit > most_coverage * np.maximum(n_words, 1), pa.bool_()),
                    }
                )

    return source.mapInArrow(run, common.schema_of(source, ("doc_id", "text", *carried), "n_words long, n_hit long, dropped boolean"))
