"""Packing of tokenised documents into sequences: dominance reduction, then best fit.

Only a piece's length matters to the packing, so the instance is the histogram of lengths: as many counters as a sequence
has tokens, at any number of documents. The driver reduces it after Martello and Toth (a piece with a set of partners that
dominates every other set is fixed for good) and packs the remainder best-fit decreasing, both by runs of equal lengths.
The plan is a short list of runs; each piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sluice.llm import common
from sluice.llm import kernels as K

END = 0


@dataclass(frozen=True)
class Run:
    """`count` pieces of one length, from rank `first`: `per` in each sequence from `sequence` on, after `offset` tokens."""

    length: int
    first: int
    count: int
    sequence: int
    per: int
    offset: int


class _Instance:
    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 2, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.rank = np.zeros(capacity + 2, np.int64)
        self.sequences = 0
        self.runs: list[Run] = []

    def place(self, length: int, count: int, sequence: int, per: int = 1, offset: int = 0) -> None:
        self.runs.append(Run(length, int(self.rank[length]), int(count), int(sequence), int(per), int(offset)))
        self.rank[length] += count
        self.left[length] -= count

    def open(self, count: int) -> int:
        self.sequences += int(count)
        return self.sequences - int(count)

    def together(self, length: int, partner: int | None, count: int) -> None:
        base = self.open(count)
        self.place(length, count, base)
        if partner is not None:
            self.place(partner, count, base, 1, length)

    def smallest(self, without: int, n: int) -> list[int]:
        """Lengths of the n smallest pieces, leaving one of length `without` out."""
        out: list[int] = []
        for v in np.flatnonzero(self.left).tolist():
            out += [v] * int(min(n - len(out), self.left[v] - (v == without)))
            if len(out) >= n:
                break
        return out

    def best_pair(self, without: int, room: int) -> int:
        """Largest sum of two pieces that fits the room."""
        have = self.left.copy()
        have[without] -= 1
        lengths = np.flatnonzero(have[: room + 1] > 0)
        best = 0
        for v in lengths.tolist():
            other = lengths[lengths <= room - v]
            other = other[other != v] if have[v] < 2 else other
            if len(other):
                best = max(best, v + int(other[-1]))
        return best


def _reduce(x: _Instance) -> None:
    """Fixes pieces with dominating partners: nothing fits; one fits exactly; or the largest single fit is as large as any
    set of pieces that fits."""
    for length in range(x.capacity, 0, -1):
        while x.left[length]:
            room = x.capacity - length
            small = x.smallest(length, 3)
            if not small or small[0] > room:
                x.together(length, None, x.left[length] if not small or small[0] != length or length > room else 1)
                continue
            fits = np.flatnonzero(x.left[: room + 1])
            fits = fits[(fits != length) | (x.left[fits] > 1)]
            largest = int(fits[-1])
            alone = len(small) < 2 or small[0] + small[1] > room
            pair = not alone and (len(small) < 3 or sum(small) > room) and largest >= x.best_pair(length, room)
            if not (largest == room or alone or pair):
                break
            n = x.left[length] // 2 if largest == length else min(x.left[length], x.left[largest])
            x.together(length, largest, n)


def _best_fit(x: _Instance) -> None:
    """Best-fit decreasing; groups of sequences with equal room are handled at once."""
    groups: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence and number
    rooms = np.zeros(x.capacity + 2, bool)

    def put(room: int, base: int, n: int) -> None:
        if n and room:
            groups.setdefault(room, []).append((base, n))
            rooms[room] = True

    for length in range(x.capacity, 0, -1):
        while left := int(x.left[length]):
            found = np.flatnonzero(rooms[length:])
            if not len(found):
                each = x.capacity // length
                n = -(-left // each)
                put(x.capacity, x.open(n), n)
                continue
            room = int(found[0]) + length
            base, n = groups[room].pop()
            rooms[room] = bool(groups[room])
            each = room // length
            full = min(n, left // each)
            if full:
                x.place(length, full * each, base, each, x.capacity - room)
                put(room - each * length, base, full)
                put(room, base + full, n - full)
            else:
                x.place(length, left, base, left, x.capacity - room)
                put(room - left * length, base, 1)
                put(room, base + 1, n - 1)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that place every piece, and the number of sequences."""
    x = _Instance(counts, capacity)
    _reduce(x)
    _best_fit(x)
    return x.runs, x.sequences


def pieces(docs: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and the end id, cut where longer than `capacity`.

    A null text is an empty one, whose only id is the end. The first piece of a cut document is the one that may be shorter.
    """
    from sluice.llm import tokens

    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.batch_encoder(path)
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.blocks(offsets, K.BLOCK // 2):
                ids, begin = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows, number, start, length, crc, own = [], [], [], [], [], []
                for i, (x, y) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
                    full = np.append(ids[x:y], END).astype("<u4")
                    n, at, k = y - x + 1, 0, 0
                    while at < n:
                        size = min(n, capacity) if n <= capacity else (n % capacity or capacity) if not k else capacity
                        rows.append(i)
                        number.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(full[at : at + size].tobytes()))
                        if keep_ids:
                            own.append(full[at : at + size].astype(np.int32))
                        at, k = at + size, k + 1
                columns = {
                    "doc_id": batch.column("doc_id").slice(a, b - a).take(pa.array(rows, pa.int64())),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                } | ({"ids": pa.array(own, pa.list_(pa.int32()))} if keep_ids else {})
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset. cut: what pieces() gives, read more than once.

    Ranks among equal lengths are counted in cells, of which a frequent length has many, so that no group of equal lengths
    meets in one task; the driver holds the number of pieces of each cell.
    """
    spark = cut.sparkSession
    cut = common.written(cut, "pieces")
    counts = {int(r.length): int(r.n) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    runs, _ = plan(counts, capacity)
    total = sum(counts.values())
    target = min(1_000_000, max(64, total // (8 * common.partitions(spark))))
    deals = spark.createDataFrame([(k, -(-n // target)) for k, n in counts.items()], "length long, parts int")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")).cast("int")
    dealt = cut.join(F.broadcast(deals), "length").withColumn("part", part).drop("parts")
    cells = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # `capacity` and total / target rows at most
    before: dict[tuple[int, int], int] = {}
    filled: dict[int, int] = {}
    for r in sorted(cells, key=lambda r: (r.length, r.part)):
        before[r.length, r.part] = filled.get(r.length, 0)
        filled[r.length] = filled.get(r.length, 0) + r.n
    bases = spark.createDataFrame([(*k, v) for k, v in before.items()], "length long, part int, base long")
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(bases), ["length", "part"])
    ranked = ranked.withColumn("rank", (F.col("base") + F.col("rank")).cast("long")).select(*cut.columns, "rank")
    # A few runs for each of `capacity` lengths.
    runs = sorted(runs, key=lambda r: (r.length, r.first))
    lengths, firsts, sequences, per, offset = (np.array([getattr(r, k) for r in runs], np.int64) for k in ("length", "first", "sequence", "per", "offset"))
    wide = max([0, *counts.values()]) + 1
    keys = lengths * wide + firsts
    sent = spark.sparkContext.broadcast((keys, firsts, sequences, per, offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, sequences, per, offset = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(keys, length * wide + rank, side="right") - 1
            beyond = rank - firsts[i]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            columns["sequence_id"] = pa.array(sequences[i] + beyond // per[i], pa.int64())
            columns["offset"] = pa.array(offset[i] + beyond % per[i] * length, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")
