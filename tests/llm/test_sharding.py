import collections

import numpy as np
import pytest

from herdlens.llm import sharding as S

SHARDS = [f"s{i}" for i in range(7)]


def brute(shards, slots):
    """Turn by turn, over written-out permutations."""
    order = [[(a + j * b) % slots for j in range(slots)] for a, b in (S._preference(s, slots) for s in shards)]
    table, at = [-1] * slots, [0] * len(shards)
    while -1 in table:
        for k in range(len(shards)):
            while at[k] < slots and table[order[k][at[k]]] >= 0:
                at[k] += 1
            if at[k] < slots:
                table[order[k][at[k]]] = k
    return table


@pytest.mark.parametrize("slots", [7, 11, 101, 1009])
def test_table(slots):
    table = S.lookup_table(SHARDS, slots)
    assert table.tolist() == brute(SHARDS, slots)
    counts = np.bincount(table, minlength=7)
    assert counts.max() - counts.min() <= 1


def test_few_slots_move():
    a, b = S.lookup_table(SHARDS), S.lookup_table(SHARDS[:-1])
    stay = a != 6
    assert (a[stay] != b[stay]).mean() < 0.05


@pytest.mark.parametrize("shards,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_arguments(shards, slots):
    with pytest.raises(ValueError):
        S.lookup_table(shards, slots)


def test_rows(spark, awkward, empty, nulls, tmp_path):
    got = S.assign(awkward, "doc_id", SHARDS)
    assert set(got.columns) == {*awkward.columns, "shard"} and got.count() == awkward.count()
    per = collections.defaultdict(set)
    for r in got.collect():
        per[r.doc_id].add((r.slot, r.shard))
    assert all(len(v) == 1 for v in per.values())
    table = S.lookup_table(SHARDS)
    assert all(SHARDS[table[s]] == n for v in per.values() for s, n in v)
    assert S.assign(empty, "doc_id", SHARDS).count() == 0 and S.assign(nulls, "doc_id", SHARDS).count() == 2
    S.write(awkward.select("doc_id", "text"), "doc_id", SHARDS, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == awkward.count()
