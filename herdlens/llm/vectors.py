"""Shards of vectors and blocks of queries, shared by the searches.

Shards stay in their tasks. Queries are stored once in the shared folder, and each task reads them there block by block,
so nothing is shuffled or copied for a shard and a block to meet. A task puts together what it holds, up to TASK_BYTES,
and reads the queries once for all of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors a shard holds, about, and queries that a task takes at a time.
SHARD_ROWS = 4096
QUERY_ROWS = 512
#: Bytes of vectors that meet the queries in one reading of them.
TASK_BYTES = 1 << 26


def usable(df: DataFrame, vector: str, zero_ok: bool) -> Column:
    """Whether a vector is not null and has finite components only, and (unless zero_ok) not only zeros."""
    x = F.col(vector)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    some = F.lit(True) if zero_ok else F.exists(x, lambda v: v != 0)
    return F.coalesce(x.isNotNull() & F.forall(x, fine) & some, F.lit(False))


def shards(df: DataFrame, id_column: str, vector: str, rows: int, total: int) -> DataFrame:
    """id, vector, shard: shards of about `rows` rows, by a hash of the id."""
    n = max(1, -(-total // rows))
    return df.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def gathered(batches, most: int = TASK_BYTES):
    """Arrow tables of the batches put together, each of about `most` bytes; none without rows."""
    import pyarrow as pa

    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def store_queries(df: DataFrame, id_column: str, vector: str, *more: str) -> list[str]:
    """Files with the rows of df as (id, v) and the columns in `more`, for query_blocks."""
    fine = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *more)
    return sorted(stored(fine.coalesce(max(1, fine.sparkSession.sparkContext.defaultParallelism)), "queries").inputFiles())


def query_blocks(files: list[str], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of `rows` queries at a time (the last has what is left), read in a task, filled over files."""
    for table in query_tables(files, rows):
        yield table.column("id").to_numpy(), matrix(table.column("v"))


def query_tables(files: list[str], rows: int):
    """As query_blocks, as Arrow tables with all columns."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    waiting, n = [], 0
    for uri in files:
        fs, path = FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(rows):
                waiting.append(batch)
                n += batch.num_rows
                if n >= rows:
                    table = pa.Table.from_batches(waiting)
                    yield table.slice(0, rows)
                    waiting, n = table.slice(rows).to_batches(), n - rows
    if n:
        yield pa.Table.from_batches(waiting)


def matrix(column) -> np.ndarray:
    """An Arrow list column without nulls as rows of doubles."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k first rows by `score`, ties by vec_id.

    Ranks of up to k are limited before the shuffle as well as after it.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
