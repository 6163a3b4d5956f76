"""Hard negatives by one-dimensional distance keys.

With a bound M on all lengths, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) turn the largest inner product into the
smallest distance: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Every augmented vector belongs to its nearest pivot, and its key
is (pivot, distance to it). Vectors are stored sorted by that key, in files that are ranges of it.

A query at distance d of a pivot has its neighbours within r in the key interval [d - r, d + r] of that pivot: an
annulus. A search starts with a small r and scans the intervals, then widens them; only the keys that come new are
scanned. It ends when the k-th best distance so far is at most r: whatever is left lies farther away. A search from a
given distance on (the negatives that score no more than a positive) leaves out the keys inside as well, and ends at
the distance of its lowest score.

Pivots come from a bounded sample of rows; they decide the speed only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored
from .pivots import SAMPLE, choose_pivots, lifted, pivot_table
from .vectors import QUERY_ROWS, TASK_BYTES, gathered, matrix, query_tables, store_queries, usable

PIVOTS = 16
#: Keys that the first radius takes in, about.
FIRST = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least so many hundredths of its positive.
LEAST_PERCENT = 80


class Keys:
    """Rows in order of (pivot, distance), as ids, labels and vectors, with the ranges of each pivot."""

    def __init__(self, ids, labels, x, pivot, distance, pivots: np.ndarray, longest: float):
        self.ids, self.labels, self.x, self.distance, self.pivots, self.longest = ids, labels, x, distance, pivots, longest
        cuts = np.flatnonzero(np.diff(pivot)) + 1
        self.ranges = [(int(pivot[a]), int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(ids)]) if b > a]
        some = slice(None, None, max(1, len(ids) // 1024))
        self.some_pivot, self.some_distance, self.every = pivot[some], distance[some], some.step

    def to_pivots(self, q: np.ndarray) -> np.ndarray:
        """Distances of each query to each pivot."""
        return pivot_table(np.concatenate([q, np.zeros((len(q), 1))], 1), self.pivots)

    def first_radius(self, d: np.ndarray) -> float:
        """A radius whose intervals hold about FIRST keys."""
        gap = np.abs(self.some_distance - d[self.some_pivot])
        k = min(len(gap) - 1, FIRST // self.every)
        return float(np.partition(gap, k)[k])

    def scan(self, d: np.ndarray, inner: float = 0.0):
        """A function that returns, for a radius, slices of the rows whose keys its intervals reach first. Rows closer
        than `inner` need not be seen."""
        slack = 1e-7 * (1 + self.longest**0.5 + d.max(initial=0))  # rounding of distances must not leave out rows
        seen = {}

        def upto(r: float):
            out = []
            for pivot, a, b in self.ranges:
                keys = self.distance[a:b]
                lo, hi = np.searchsorted(keys, [max(d[pivot] - r, inner - d[pivot]) - slack, d[pivot] + r + slack])
                lo, hi = a + int(lo), a + max(int(lo), int(hi))
                old = seen.get(pivot)
                if old is None:
                    out.append((lo, hi))
                    seen[pivot] = lo, hi
                else:
                    out += [(lo, old[0]), (old[1], hi)]
                    seen[pivot] = min(lo, old[0]), max(hi, old[1])
            return [(i, j) for i, j in out if j > i]

        return upto

    def distance_of(self, size: float, score: float) -> float:
        return float(np.sqrt(max(size + self.longest - 2 * score, 0.0)))

    def first_rows(self, q_id: int, label, q: np.ndarray, d: np.ndarray, k: int):
        """(ids, scores) of the k rows of the same label with the highest products, the query's own id left out."""
        ids, scores, size = np.empty(0, np.int64), np.empty(0), float(q @ q)
        upto, r, seen = self.scan(d), self.first_radius(d), 0
        while True:
            for a, b in upto(r):
                mine = np.flatnonzero((self.labels[a:b] == label) & (self.ids[a:b] != q_id)) + a
                ids, scores = best_of(np.concatenate([ids, self.ids[mine]]), np.concatenate([scores, self.x[mine] @ q]), k)
                seen += b - a
            if seen == len(self.ids):
                return ids, scores
            reach = self.distance_of(size, scores[-1]) if len(scores) == k else 2 * r + 1e-6
            if reach <= r:
                return ids, scores
            r = reach

    def first_below(self, label, q: np.ndarray, d: np.ndarray, tops: np.ndarray, k: int, least_percent: int):
        """For each of the scores `tops`, (ids, scores) of the k rows of other labels with the highest products among
        those that are at most that score and at least `least_percent` hundredths of it."""
        found = [(np.empty(0, np.int64), np.empty(0)) for _ in tops]
        open_ = [j for j, top in enumerate(tops) if top >= 0]  # below 0 no score is at most that and at least a part of it
        if not open_ or not len(self.ids):
            return found
        size = float(q @ q)
        inner = min(self.distance_of(size, tops[j]) for j in open_)
        outer = {j: self.distance_of(size, least_percent * tops[j] / 100) for j in open_}
        upto, r = self.scan(d, inner), max(self.first_radius(d), inner)
        while True:
            for a, b in upto(r):
                other = np.flatnonzero(self.labels[a:b] != label) + a
                scores = self.x[other] @ q
                for j in open_:
                    fair = (scores <= tops[j]) & (100 * scores >= least_percent * tops[j])
                    found[j] = best_of(np.concatenate([found[j][0], self.ids[other[fair]]]), np.concatenate([found[j][1], scores[fair]]), k)
            # nothing beyond is nearer than the k-th; nor does anything beyond the lowest fair score count
            reach = {j: min(outer[j], self.distance_of(size, found[j][1][-1])) if len(found[j][1]) == k else outer[j] for j in open_}
            open_ = [j for j in open_ if reach[j] > r]
            if not open_:
                return found
            r = max(reach[j] for j in open_)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int):
    """The k highest scores, ties to smaller ids."""
    if len(scores) > k:
        fair = scores >= np.partition(scores, -k)[-k]
        ids, scores = ids[fair], scores[fair]
    first = np.lexsort((ids, -scores))[:k]
    return ids[first], scores[first]


def _keyed(pivots: np.ndarray, longest: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = pivot_table(lifted(matrix(batch.column("v")), longest), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], ["id", "label", "v", "pivot", "distance"])

    return run


def _search(files: list[str], query_rows: int, pivots: np.ndarray, longest: float, each):
    """each(keys, query row as a dict, q, d): rows to send on."""

    def run(batches):
        for table in gathered(batches):
            columns = [table.column(c).to_numpy() for c in ("id", "label", "pivot", "distance")]
            keys = Keys(columns[0], columns[1], matrix(table.column("v")), columns[2], columns[3], pivots, longest)
            for block in query_tables(files, query_rows):
                q = matrix(block.column("v"))
                d = keys.to_pivots(q)
                out = [row for i, query in enumerate(block.drop_columns(["v"]).to_pylist()) for row in each(keys, query, q[i], d[i])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [f"c{i}" for i in range(len(out[0]))])

    return run


def _positives(k: int):
    def each(keys, query, q, d):
        ids, scores = keys.first_rows(query["id"], query["label"], q, d, k)
        return [(query["id"], int(i), round(s)) for i, s in zip(ids, scores)]

    return each


def _negatives(k: int, least_percent: int):
    def each(keys, query, q, d):
        given = query["positives"]
        found = keys.first_below(query["label"], q, d, np.array([p["score"] for p in given], float), k, least_percent)
        return [(query["id"], p["id"], p["score"], int(i), round(s)) for p, (ids, scores) in zip(given, found) for i, s in zip(ids, scores)]

    return each


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, id_column: str, vector: str, label: str, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, scale: int = 256, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products of floor(scale * x) with the anchor, the highest first, ties to smaller ids. An
    anchor's positives are its first rows of the same label but those with its own id; a positive's negatives the first
    rows of other labels that score at most as much as it and at least `least_percent` hundredths of that (none if it
    scores below 0). Fewer are returned where there are fewer; anchors without a positive, and positives without a
    negative, have no rows.

    Rows without id or label, with a null vector, or with null or non-finite components take no part, as anchors or
    otherwise; zero vectors do. Repeated rows are candidates each; of anchors with one id the smallest (label, vector)
    is searched. All vectors must have one length, and products must stay below 2^53. Empty tables give an empty one;
    other columns play no part.

    A task holds one range of keys, and the stored anchors go past it; it sends on `positives` rows an anchor, then
    `negatives` rows an anchor and positive (for each TASK_BYTES of its rows).
    """
    spark = vectors.sparkSession

    def whole(df):
        fine = df.where(usable(df, vector, zero_ok=True) & F.col(id_column).isNotNull() & F.col(label).isNotNull())
        whole_numbers = F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("double"))
        return fine.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole_numbers.alias("v"))

    rows = stored(whole(vectors), "vectors")
    about = rows.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("longest"), F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if about["longest"] is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    longest = about["longest"]
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    pivots = choose_pivots(lifted(np.array([r["v"] for r in sample]), longest), PIVOTS)
    parts = max(spark.sparkContext.defaultParallelism, -(-about["n"] * 8 * about["width"] // TASK_BYTES))
    keyed = rows.mapInArrow(_keyed(pivots, longest), "id long, label long, v array<double>, pivot int, distance double")
    order = ["pivot", "distance", "id"]
    table = stored(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order), "keys")

    one = whole(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")
    asked = stored(one, "anchors")
    files = store_queries(asked, "id", "v", "label")
    found = table.mapInArrow(_search(files, query_rows, pivots, longest, _positives(positives)), "id long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "positive_id"))
    found = found.withColumn("place", place).where(F.col("place") <= positives)
    given = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), "score"))).alias("positives"))  # `positives` rows at most
    files = store_queries(asked.join(given, "id"), "id", "v", "label", "positives")
    found = table.mapInArrow(_search(files, query_rows, pivots, longest, _negatives(negatives, least_percent)), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    discard(rows, asked)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


ORACLE_SQL = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, c.vec_id, a.l = c.l same, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::bigint score
  from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
n as (select anchor_id, positive_id, vec_id negative_id, positive_score, score negative_score,
    row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int rank
  from p join s using (anchor_id) where not same and {LEAST_PERCENT} * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}
"""
