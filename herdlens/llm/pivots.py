"""Exact top-k search by inner product with a pivot table.

With a bound M on all lengths, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) turn the largest inner product into the
smallest Euclidean distance: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. The table holds each row's distance to every pivot;
for a query, the largest |d(q, p) - d(x, p)| over the pivots p is a lower bound of its distance to x, and so gives an
upper bound of the inner product. Candidates are evaluated in the order of their bounds, until the next bound is below
the k-th best product: exact, whatever the pivots are.

Vectors stay where they are read: a task works out the table of its rows once, and the stored queries go past it once.

Pivots come from a bounded sample of rows by farthest-first choice; they decide the speed only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import QUERY_ROWS, best, gathered, matrix, query_blocks, store_queries, usable

PIVOTS = 32
SAMPLE = 1024
CHUNK = 128
#: How many times larger each next chunk of candidates is.
GROWTH = 8


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))[:, None]], 1)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first from the first row."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def pivot_table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0.0))


def top_products(q_ids, q, ids, x, table, pivots, longest: float, k: int):
    """For each query (ids, products, evaluated): its k largest inner products in this block, ties to smaller ids, itself
    left out, and how many candidates were evaluated for them."""
    q_table = pivot_table(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots)
    size, by_pivot, q_pivot = (q * q).sum(1), np.ascontiguousarray(table.T, np.float32), q_table.astype(np.float32)
    far = np.empty_like(by_pivot)
    for i in range(len(q)):
        np.subtract(by_pivot, q_pivot[i][:, None], out=far)
        gap = np.abs(far, out=far).max(0).astype(np.float64)
        # slack for the rounding to single precision and of square roots: a gap taken too small is still a lower bound
        gap = np.maximum(gap - 1e-5 * (1 + q_table[i].max() + longest**0.5), 0.0)
        bound = (size[i] + longest - gap * gap) / 2 + 1e-9 * (size[i] + longest)
        left = np.flatnonzero(ids != q_ids[i])
        got_i, got_s, step, evaluated = np.empty(0, np.int64), np.empty(0), max(CHUNK, 2 * k), 0
        while len(left):
            if len(left) > step:  # those with the highest bounds come next
                part = np.argpartition(bound[left], len(left) - step)
                rows, left = left[part[-step:]], left[part[:-step]]
            else:
                rows, left = left, left[:0]
            evaluated += len(rows)
            scores = (x if 4 * len(rows) > 3 * len(x) else x[rows]) @ q[i]
            scores = scores[rows] if len(scores) > len(rows) else scores
            if len(got_s) == k:
                fair = scores >= got_s[-1]
                rows, scores = rows[fair], scores[fair]
            elif len(scores) > k:
                fair = scores >= np.partition(scores, -k)[-k]
                rows, scores = rows[fair], scores[fair]
            got_i, got_s = np.concatenate([got_i, ids[rows]]), np.concatenate([got_s, scores])
            first = np.lexsort((got_i, -got_s))[:k]
            got_i, got_s = got_i[first], got_s[first]
            if len(got_s) == k:
                left = left[bound[left] >= got_s[-1]]  # no row whose bound is below the k-th best can be among them
            step *= GROWTH  # where bounds tell little, few and large chunks
        yield got_i, got_s, evaluated


def _search(files: list[str], query_rows: int, pivots: np.ndarray, longest: float, k: int):
    def run(batches):
        for rows in gathered(batches):
            ids, x = rows.column("id").to_numpy(), matrix(rows.column("v"))
            table = pivot_table(lifted(x, longest), pivots)
            for q_ids, q in query_blocks(files, query_rows):
                found = list(top_products(q_ids, q, ids, x, table, pivots, longest, k))
                n = [len(f[0]) for f in found]
                columns = np.repeat(q_ids, n), np.concatenate([f[0] for f in found]), np.rint(np.concatenate([f[1] for f in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int, scale: int = 64, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products of floor(scale * x), exactly.

    Rows but the query's own are candidates; ties go to smaller ids; with fewer than k candidates all are returned.
    Vectors that are null or hold null or non-finite components, and rows without id, take no part; zero vectors do.
    All vectors must have one length, and products must stay below 2^53. A task sends on k rows a query (and TASK_BYTES
    of its rows), and keeps the best k of a query before they are shuffled.
    """

    def whole(df):
        fine = df.where(usable(df, vector, zero_ok=True) & F.col(id_column).isNotNull())
        return fine.select(F.col(id_column).cast("long").alias("id"), F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"))

    spark = vectors.sparkSession
    fine = stored(whole(vectors), "vectors")
    longest = fine.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = fine.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    pivots = choose_pivots(lifted(np.array([r["v"] for r in sample]), longest))
    files = store_queries(whole(queries), "id", "v")
    found = fine.mapInArrow(_search(files, query_rows, pivots, longest, k), "query_id long, vec_id long, score long")
    return best(found, k, F.desc("score"))


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
