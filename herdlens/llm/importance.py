"""Importance resampling towards a target distribution, over hashed word n-grams.

Each document is a row of a sparse matrix: how many of its runs of one to three words fall in each of a fixed number of
buckets. The matrix is stored once, as CSR blocks of some hundred documents. Its column sums are the corpus'
distribution; the target's come from a matrix of its own. A bucket's gain is the logarithm of how much likelier the
target makes it, as a whole number, and the product of matrix and gains is every document's weight. With a Gumbel draw
added to each weight, the highest scores are a sample without replacement in proportion to the exponential of the
weights.

The texts are read once. What leaves a task is its blocks, its column sums (a number a bucket) or its documents'
weights; the driver gets column sums, whose number is fixed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, stored
from .textarrays import ALNUM, blocks, text_buffers, word_places

BUCKETS = 10_000
ORDERS = 3
#: Logarithms are in thousandths, as whole numbers.
UNIT = 1000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Words longer than this many bytes are hashed one by one.
_LONG = 64

_BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BYTE = (_BYTE >> np.uint32(1)) ^ np.where(_BYTE & 1, np.uint32(0xEDB88320), np.uint32(0))


class _Zeros:
    """What crc32 becomes when zero bytes follow: linear over bits, so tables for 1, 2, 4, ... bytes give every number."""

    def __init__(self):
        parts = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        self.tables = [_BYTE[parts & 255] ^ (parts >> np.uint32(8))]

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """crc32 moved on by n bytes each. crc32(a + b) is crc32(a) moved on by the length of b, xor crc32(b)."""
        crc = crc.copy()
        for k in range(int(n.max()).bit_length() if len(n) else 0):
            if k == len(self.tables):
                self.tables.append(self._apply(self.tables[-1], self.tables[-1]))
            some = np.flatnonzero((n >> k) & 1)
            crc[some] = self._apply(self.tables[k], crc[some])
        return crc


_moved = _Zeros()


def word_crcs(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each word's bytes: all words a byte at a time, the long ones one by one."""
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    long = int((n > _LONG).sum())
    crc = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for j in range(int(n[long]) if long < len(n) else 0):
        most = int(np.searchsorted(-n, -j))
        own = crc[long:most]
        crc[long:most] = _BYTE[(own ^ low[at[long:most] + j]) & 255] ^ (own >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(low[at[i] : at[i] + n[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def gram_crcs(data: np.ndarray, offsets: np.ndarray, orders: int = ORDERS):
    """(crc32, text) of every run of 1 to `orders` words, joined by one space; and how many words each text has."""
    low, starts, lengths, bounds = word_places(data, offsets, ALNUM)
    texts = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    crc = word_crcs(low, starts, lengths)
    spaced = _moved(np.full(len(crc), zlib.crc32(b" "), np.uint32), lengths) ^ crc
    out, run = [(crc, texts)], crc
    for k in range(1, orders):
        run = _moved(run[:-1], lengths[k:] + 1) ^ spaced[k:]
        same = texts[k:] == texts[: len(texts) - k] if len(texts) > k else np.zeros(0, bool)
        out.append((run[same], texts[: len(texts) - k][same] if len(texts) > k else texts[:0]))
    return out, np.diff(bounds)


def csr(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, orders: int = ORDERS):
    """(n_words, indptr, indices, counts) of a block of texts; a row's indices are in ascending order."""
    grams, n_words = gram_crcs(data, offsets, orders)
    cells = np.concatenate([text * buckets + crc % np.uint32(buckets) for crc, text in grams])
    cells, counts = np.unique(cells, return_counts=True)
    indptr = np.searchsorted(cells, np.arange(len(n_words) + 1) * buckets)
    return n_words, indptr, cells % buckets, counts


def _index_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _narrow(counts: np.ndarray) -> bytes:
    """In as few bytes each (1, 2 or 4) as the largest needs."""
    most = int(counts.max(initial=0))
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _as_blocks(buckets: int, orders: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in blocks(offsets):
                n_words, indptr, indices, counts = csr(data[offsets[a] : offsets[b]], offsets[a : b + 1], buckets, orders)
                ids = batch.column("id").slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids),
                        pa.array([n_words], pa.list_(pa.int64())),
                        pa.array([indptr], pa.list_(pa.int64())),
                        pa.array([indices.astype(_index_type(buckets)).tobytes()], pa.binary()),
                        pa.array([_narrow(counts)], pa.binary()),
                    ],
                    ["ids", "n_words", "indptr", "indices", "counts"],
                )

    return run


def count_matrix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """The stored document-by-bucket matrix: ids, n_words and indptr (one more than ids) as arrays, indices and counts as
    little-endian unsigned integers (indices of 16 bits if the buckets allow it, counts as narrow as the block allows). A
    row a block.

    Words are runs of 0-9, a-z (A-Z lower-cased, nothing else) and characters beyond ASCII. A null text has none, and
    every row of docs is a row of the matrix, repeated ones too.
    """
    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = f"ids array<{kind}>, n_words array<long>, indptr array<long>, indices binary, counts binary"
    return stored(rows.mapInArrow(_as_blocks(buckets, orders), schema), "matrix")


def _cells(batch, buckets: int):
    for indices, counts in zip(batch.column("indices"), batch.column("counts")):
        index = np.frombuffer(indices.as_buffer(), _index_type(buckets))
        width = len(counts.as_buffer()) // len(index) if len(index) else 1
        yield index, np.frombuffer(counts.as_buffer(), f"<u{width}").astype(np.int64)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows. Each task sends a number a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for indices, counts in _cells(batch, buckets):
                total += np.bincount(indices, counts, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    sums = matrix.select("indices", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return total


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(UNIT * ln(target share / source share)) of each bucket, with one added to every count."""
    t, s, n = target.astype(float), source.astype(float), len(source)
    return np.floor(UNIT * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and weight of each row: the sparse matrix times the gains. No features weigh 0."""
    buckets, shared = len(gain), matrix.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches):
        gain = shared.value
        for batch in batches:
            for row, (indices, counts) in enumerate(_cells(batch, buckets)):
                bounds = batch.column("indptr")[row].values.to_numpy()
                n_features, weight = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (counts, counts * gain[indices]))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, batch.column("n_words")[row].values, pa.array(n_features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    kind = dict(matrix.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return matrix.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def with_draws(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """score: the weight plus UNIT times a Gumbel draw, rounded down, from sha256 of seed and id (a null id: of none)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(-UNIT * F.log(-F.log(uniform))))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rank from 1 of the drawn rows, null for the others: of the N rows with enough words floor(percent * N / 100),
    highest scores first, ties to smaller ids.

    Rows are dealt out by ranges of (score, id) and stored, so a task has one range however many scores are equal; of
    the ranges only the numbers of rows meet in one task.
    """
    spark = scored.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fine = F.col("n_words") >= least_words
    dealt = stored(scored.where(fine).repartitionByRange(parts, F.desc("score"), F.asc("id")).withColumn("part", F.spark_partition_id()), "scores")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = sizes.withColumn("draws", F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)).drop("n")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), F.asc("id")))
    some = dealt.join(F.broadcast(sizes), "part")  # a row a partition
    first = some.where(F.col("before") < F.col("draws")).withColumn("place", place)
    first = first.select(*scored.columns, F.when(F.col("place") <= F.col("draws"), F.col("place")).cast("long").alias("rank"))
    none = F.lit(None).cast("long").alias("rank")
    rest = some.where(F.col("before") >= F.col("draws")).select(*scored.columns, none)
    return first.unionAll(rest).unionAll(scored.where(~fine).select(*scored.columns, none))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score, rank for every row of docs; target: any table with text.

    Null and empty texts and those without a word have no features and weight 0; they and other texts of fewer than
    `least_words` words are never drawn. Repeated rows are documents of their own, which get equal scores and ranks next
    to each other. Null ids share one draw and, among equal scores, come first. An empty table gives an empty one; with
    an empty target every gain comes from the corpus alone. Columns but id and text play no part, whatever their names.
    """
    wanted = count_matrix(target.select(F.lit(0).alias("id"), "text"), "id", buckets=buckets)
    goal = column_sums(wanted, buckets)
    discard(wanted)
    matrix = count_matrix(docs, id_column, buckets=buckets)
    scored = stored(with_draws(weigh(matrix, gains(goal, column_sums(matrix, buckets))), seed), "weights")
    discard(matrix)
    return ranked(scored, percent, least_words).withColumnRenamed("id", id_column)


def selected(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of docs, unchanged; ids must be unique and not null."""
    drawn = resample(docs, target, id_column, **how).where("rank is not null").select(id_column)
    return docs.join(drawn, id_column, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


#: crc32 over the bytes of each different feature, by the table of its 256 single-byte steps.
ORACLE_SQL = f"""
with recursive step(b, k, c) as (select b::bigint, 0, b::bigint from range(256) t(b)
  union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
tab as (select list(c order by b) t from step where k = 8),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
m as (select regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
g1 as (select doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from d),
g2 as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from m),
f1 as (select doc_id, g, count(*) n from g1 group by all),
f2 as (select g, count(*) n from g2 group by all),
u as (select distinct g from (select g from f1 union all select g from f2)),
h as (select g, hex(encode(g)) x from u),
c as (select g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {BUCKETS} bucket from h, tab),
s as (select bucket, sum(n) n from f1 join c using (g) group by all),
t as (select bucket, sum(n) n from f2 join c using (g) group by all),
gain as (select b bucket, floor({UNIT} * ln(((coalesce(t.n, 0) + 1)::double * ((select sum(n) from f1) + {BUCKETS})::double)
    / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from f2) + {BUCKETS})::double)))::bigint gain
  from range({BUCKETS}) r(b) left join s on s.bucket = b left join t on t.bucket = b),
w as (select doc_id, sum(n)::bigint n_features, sum(n * gain)::bigint weight from f1 join c using (g) join gain using (bucket) group by all),
sc as (select d.doc_id, len(d.w) n_words, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
  coalesce(weight, 0)::bigint + floor(-{UNIT} * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::ubigint::double + 0.5) / 4294967296.0)))::bigint score from d left join w using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) rank from sc where n_words >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when rank <= (select floor({PERCENT} * count(*) / 100) from r) then rank end::bigint rank from sc left join r using (doc_id)
"""
