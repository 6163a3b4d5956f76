"""Approximate nearest neighbours: a vantage-point tree for each shard.

A node keeps one vector and splits the others at the median of their distance to it. A query that lies at distance d
of the vantage point, with its k-th best so far at t, has to look inside the ball of radius m only if d - m <= t / f
and outside only if m - d <= t / f (f: the pruning factor). With f = 1 that is the triangle inequality and results are
exact; larger factors prune more and may miss neighbours.

Trees are built once, one task a shard, and stored. To search, each tree stays in one task and the stored queries go
past all trees of the task block by block, read once. Queries of a block that reach a node are handled together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import QUERY_ROWS, SHARD_ROWS, best, gathered, query_blocks, shards, store_queries, usable

LEAF = 64
#: 1: exact. Random vectors of many dimensions gain little from pruning, so exactness costs little here.
FACTOR = 1.0


class Tree:
    """Rows in tree order: nodes hold a vantage row, a radius and two ranges; leaves hold up to `leaf` rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = 1):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.leaf = ids[order], x[order], leaf
        self.random = np.random.default_rng(seed)
        rows, self.nodes = np.arange(len(ids)), []
        self.root = self._build(rows)

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        if len(rows) <= self.leaf:
            self.nodes.append((rows, None, 0.0, -1, -1))
            return at
        vantage = rows[self.random.integers(len(rows))]
        rest = rows[rows != vantage]
        d = distances(self.x[vantage][None], self.x[rest])[0]
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():
            inside = np.arange(len(rest)) < len(rest) // 2
        self.nodes.append(None)
        a, b = self._build(rest[inside]), self._build(rest[~inside])
        # how far the inner rows reach and where the outer ones begin
        self.nodes[at] = (vantage, (float(d[inside].max()), float(d[~inside].min())), radius, a, b)
        return at

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, factor: float = FACTOR, found=None):
        """(distances, ids), each (queries, k), nearest first, ties to smaller ids; where there are fewer, distances are
        inf and ids say nothing. found: what other trees gave for these queries; the best of all are returned, and what
        is known already prunes from the start."""
        self.top_d, self.top_i = found or (np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max))
        if len(self.ids):
            self._visit(self.root, np.arange(len(q)), q_ids, q, k, factor)
        return self.top_d, self.top_i

    def _offer(self, who, rows, d, q_ids) -> None:
        d = np.where(self.ids[rows][None] == q_ids[who][:, None], np.inf, d)
        all_d = np.concatenate([self.top_d[who], d], 1)
        all_i = np.concatenate([self.top_i[who], np.broadcast_to(self.ids[rows], d.shape)], 1)
        order = np.lexsort((all_i, all_d), axis=1)[:, : self.top_d.shape[1]]
        self.top_d[who], self.top_i[who] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)

    def _visit(self, node, who, q_ids, q, k, factor) -> None:
        rows, bounds, radius, a, b = self.nodes[node]
        if bounds is None:
            self._offer(who, rows, distances(q[who], self.x[rows]), q_ids)
            return
        d = distances(q[who], self.x[[rows]])[:, 0]
        self._offer(who, np.array([rows]), d[:, None], q_ids)
        inner, outer = bounds
        slack = 1e-9 * (1 + d)  # rounding of distances must not prune
        near = d <= radius
        for first in (True, False):
            for child, mine in ((a, near), (b, ~near)) if first else ((a, ~near), (b, near)):
                gap = d - inner if child == a else outer - d
                go = mine & (gap - slack <= self.top_d[who, k - 1] / factor)
                if go.any():
                    self._visit(child, who[go], q_ids, q, k, factor)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, by differences: exact zeros for equal vectors, no cancellation."""
    out = np.empty((len(q), len(x)))
    step = max(1, (1 << 20) // max(1, x.size))
    for i in range(0, len(q), step):
        out[i : i + step] = np.sqrt(((q[i : i + step, None] - x[None]) ** 2).sum(2))
    return out


def _build_shard(key, pdf: pd.DataFrame) -> pd.DataFrame:
    import pickle

    tree = Tree(pdf.id.to_numpy(np.int64), np.stack(pdf.v.to_list()).astype(np.float64))
    return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(tree, protocol=5)]})


def build(vectors: DataFrame, id_column: str, vector: str, rows: int = SHARD_ROWS) -> DataFrame:
    """shard, tree: one stored row a shard of about `rows` vectors."""
    fine = vectors.where(usable(vectors, vector, zero_ok=False) & F.col(id_column).isNotNull())
    total = fine.count()
    return stored(shards(fine, id_column, vector, rows, total).groupBy("shard").applyInPandas(_build_shard, "shard int, tree binary"), "trees")


def _search(files: list[str], query_rows: int, k: int, factor: float):
    def run(batches):
        import pickle

        for rows in gathered(batches):
            trees = [pickle.loads(raw.as_py()) for raw in rows.column("tree")]
            for ids, q in query_blocks(files, query_rows):
                found = None
                for tree in trees:
                    found = tree.search(ids, q, k, factor, found)
                d, i = found
                some = np.isfinite(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, some.sum(1))), pa.array(i[some]), pa.array(d[some])], ["query_id", "vec_id", "score"])

    return run


def search(trees: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int, factor: float = FACTOR, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows but itself, by Euclidean distance, ties to smaller ids.

    Null vectors, zero vectors and those with null or non-finite components are neither found nor searched for, as are
    rows without id. With fewer candidates than k all are returned; ids may be negative. All vectors must have one length.
    A task sends on k rows a query (and TASK_BYTES of its trees).
    """
    files = store_queries(queries.where(usable(queries, vector, zero_ok=False) & F.col(id_column).isNotNull()), id_column, vector)
    # no key: trees are dealt out one by one, so a task has one or a few
    spread = max(1, min(trees.count(), 2 * trees.sparkSession.sparkContext.defaultParallelism))
    found = trees.select("tree").repartition(spread).mapInArrow(_search(files, query_rows, k, factor), "query_id long, vec_id long, score double")
    return best(found, k, F.col("score"))
