"""Exact maximum-inner-product search by branch and bound over a ball tree of each shard.

Vectors are dealt into shards by id, and queries into blocks; a cell is a shard with a block. A cell builds a ball tree over
its vectors and walks it for all its queries: the inner product of a query q with any vector of a ball of centre c and
radius r is at most q.c + |q| r. Each query visits leaves in the order of their bounds, and stops when the next bound is
below its kth score. One pilot shard is searched first, and the kth scores found there bound the search of all others.

Components are floor(1024 x), so scores are integers; they are computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sluice.llm import common

SCALE = 1024
LOWEST = -(2**63) + 1  # stands for no score; its negative is a 64-bit number too
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 20_000, 2_048, 512


class BallTree:
    """Leaves of at most LEAF_ROWS vectors with the balls of all levels above them."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.vectors = vectors
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        centres, radii = [], []
        todo = [(np.arange(len(vectors)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.children)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = node
                self.children[parent] = tuple(pair)
            own = vectors[rows]
            centre = own.mean(axis=0)
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            if len(rows) <= leaf_rows:
                self.children.append(None)
                self.rows.append(rows)
                continue
            # Two far points make an axis; the median along it splits, by place where values are equal.
            far = own[((own - centre) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            order = np.argsort(own @ (far - other), kind="stable")
            half = len(rows) // 2
            self.children.append((-1, -1))
            self.rows.append(None)
            todo += [(rows[order[half:]], node, 1), (rows[order[:half]], node, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.leaf = np.array([c is None for c in self.children])
        self.pairs = np.array([c or (0, 0) for c in self.children])
        # Rounding must never lower a bound.
        scale = np.abs(vectors).max(initial=1.0)
        self.slack = 1e-9 * (1.0 + scale * np.sqrt(vectors.shape[1]))

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Bound of each query at its own node."""
        inner = (queries * self.centres[nodes]).sum(axis=1)
        return inner + norms * (self.radii[nodes] + self.slack) + np.abs(inner) * 1e-12


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors: in doubles while these are exact, else in Python's integers, cut to 64 bits."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    if most < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    full = queries.astype(object) @ vectors.T.astype(object)
    return np.array([[min(max(int(x), LOWEST), -LOWEST) for x in row] for row in full.tolist()], np.int64).reshape(len(queries), len(vectors))


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k vectors of each query among these, with another id than its own: query places, ids and scores.

    floor: a score for each query that its kth best is known to reach; vectors below it may be left out.
    """
    n = len(queries)
    best_score = np.full((n, k), LOWEST, np.int64)
    best_id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
    filled = np.zeros(n, np.int64)
    if n and len(vectors):
        tree = BallTree(vectors, leaf_rows)
        norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        limit = floor.astype(float).copy()
        # Down the tree, dropping balls below the known kth score.
        at, node, leaves = np.arange(n), np.zeros(n, np.int64), []
        bound = tree.bounds(queries, norms, node)
        while len(at):
            keep = bound >= limit[at]
            at, node, bound = at[keep], node[keep], bound[keep]
            leaf = tree.leaf[node]
            leaves.append((at[leaf], node[leaf], bound[leaf]))
            at, node = at[~leaf], node[~leaf]
            pairs = tree.pairs[node]
            at, node = np.concatenate([at, at]), np.concatenate([pairs[:, 0], pairs[:, 1]])
            bound = tree.bounds(queries[at], norms[at], node)
        at, node, bound = (np.concatenate([x[i] for x in leaves]) for i in range(3))
        order = np.lexsort((node, -bound, at))
        at, node, bound = at[order], node[order], bound[order]
        step, end = np.searchsorted(at, np.arange(n)), np.searchsorted(at, np.arange(n), side="right")
        live = np.flatnonzero(step < end)
        while len(live):  # each query's next leaf, by leaf
            live = live[bound[step[live]] >= limit[live]]
            now = node[step[live]]
            for leaf in np.unique(now).tolist():
                who, rows = live[now == leaf], tree.rows[leaf]
                s = exact_scores(queries[who], vectors[rows])
                own = query_ids[who][:, None] == ids[rows][None, :]
                s[own] = LOWEST
                names = np.where(own, np.iinfo(np.int64).max, ids[rows][None, :])
                if s.shape[1] > k:  # what is below the kth score here can't be among the best
                    some = (s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]).any(axis=0)
                    s, names = s[:, some], names[:, some]
                s, names = np.concatenate([best_score[who], s], 1), np.concatenate([best_id[who], names], 1)
                first = np.lexsort((names, -s), axis=1)
                first = first[:, :k]
                best_score[who], best_id[who] = np.take_along_axis(s, first, 1), np.take_along_axis(names, first, 1)
                filled[who] = np.minimum(k, filled[who] + (~own).sum(axis=1))
            full = live[filled[live] >= k]
            limit[full] = np.maximum(limit[full], best_score[full, k - 1].astype(float) * (1 - 1e-15))
            step[live] += 1
            live = live[step[live] < end[live]]
    have = np.arange(k)[None, :] < filled[:, None]
    place = np.nonzero(have)[0]
    return place, best_id[have], best_score[have]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _cell(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    ids, held = vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v")) if len(vectors) else np.zeros((0, 1))
    # Repeated rows count once.
    if len(ids):
        _, first = np.unique(np.column_stack([ids.astype(np.float64), held]) if len(ids) and np.abs(ids).max() < 2**53 else np.column_stack([ids.astype(object), held.astype(object)]).astype(str), axis=0, return_index=True)
        first = np.sort(first)
        ids, held = ids[first], held[first]
    who = queries.column("query_id").to_numpy()
    asked = _matrix(queries.column("v")) if len(queries) else np.zeros((0, held.shape[1]))
    floor = queries.column("floor").to_numpy(zero_copy_only=False).astype(float) if len(queries) else np.zeros(0)
    place, found, score = search(who, asked, ids, held, k, np.where(np.isnan(floor), -np.inf, floor))
    return pa.table({"query_id": pa.array(who[place], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column | None = None, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all other rows, ties to smaller ids.

    queries: which rows are queries (of the column vec_id); by default ids divisible by 100. Rows take no part whose vector
    is null, empty, or holds null or non-finite components, nor rows without an id. Only vectors of equal dimension meet.
    Repeated rows (same id, same vector) count once; of a query id with several vectors the smallest vector asks. Components
    and scores beyond 64 bits are cut to them.
    """
    spark = vectors.sparkSession
    x = F.col("e")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~odd)
    # The product by a power of two is exact; floor() of a double gives a long.
    rows = rows.select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"), F.size(x).alias("dim"))
    rows = common.written(rows, "vectors")
    n = rows.count()
    asked = rows.where(F.col("vec_id") % 100 == 0 if queries is None else queries)
    asked = common.written(asked.groupBy(F.col("vec_id").alias("query_id"), "dim").agg(F.min("v").alias("v")), "queries")
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked.count() // BLOCK_ROWS))
    where = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    held = rows.withColumn("shard", where).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    schema = "query_id long, vec_id long, score long"
    keys = ["shard", "block", "dim"]

    def cells(asked: DataFrame, held: DataFrame) -> DataFrame:
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(lambda q, v: _cell(q, v, k), schema)

    pilot = cells(asked.withColumns({"shard": F.lit(0), "floor": F.lit(None).cast("long")}), held.where("shard = 0"))
    pilot = common.written(_best(pilot, k), "pilot")
    floor = pilot.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    found = pilot.select("query_id", "vec_id", "score")
    if shards > 1:
        rest = asked.join(floor, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))
        found = found.unionByName(cells(rest, held.where("shard > 0")))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
