"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order of the slots of a prime-sized table (offset and skip from its name's hash);
shards take turns claiming their next free slot until the table is full. A row's place is one hash and one look-up.
Shares differ by at most one slot a turn, and when a shard comes or goes, few slots of the others change.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime; over 100 slots for each of up to 655 shards. The table sent to executors has one row a slot, so its size is fixed.
SLOTS = 65_537


def _preference(name: str, slots: int) -> tuple[int, int]:
    a, b = (int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, salt=salt).digest(), "little") for salt in (b"offset", b"skip"))
    return a % slots, b % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Index of the shard that holds each slot. `slots` must be prime, at least as many as the shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, one at least")
    if slots < len(shards) or slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number not below the number of shards")
    table = np.full(slots, -1, dtype=np.int32)
    at, skip = (np.array(x, dtype=np.int64) for x in zip(*(_preference(s, slots) for s in shards)))
    left = slots
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The key's slot; null keys share one."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def assign(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, names=("slot", "shard")) -> DataFrame:
    """df with its slot and shard for each row. No shuffle: the look-up table is broadcast.

    The table has `slots` rows whatever the input is. Equal keys, null among them, go to one shard; an empty table
    stays empty; columns of the two names are replaced.
    """
    slot, shard = names
    spark = df.sparkSession
    table = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots).tolist())], f"`{slot}` int, `{shard}` string")
    columns = [c for c in df.columns if c not in names]
    return df.select(*columns).withColumn(slot, slot_of(F.col(key), slots)).join(F.broadcast(table), slot).select(*columns, slot, shard)


def write(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS, files_per_shard: int = 8) -> None:
    """Rows of each shard in files of its own below path/shard=...; a shard's rows are dealt over several tasks."""
    placed = assign(df, key, shards, slots)
    spread = F.pmod(F.xxhash64(F.col(key), F.lit("file")), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, F.col("shard"), spread).write.partitionBy("shard").parquet(path)
