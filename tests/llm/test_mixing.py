import re

import pytest
from pyspark.sql import functions as F

from herdlens.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight, the excess of full sources dealt again until there is none."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = sum(w[s] for s in names if s not in full)
        share = {s: cap * sizes[s] if s in full else left * w[s] / open_ for s in names}
        over = {s for s in names if s not in full and share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return share
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 1000}, {"a": 1, "b": 1, "c": 1, "d": 500, None: 7}, {"x": 5}, {"a": 0, "b": 9}, {"a": 1000, "b": 1, "c": 2, "d": 3, "e": 4}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(int(s is None), s or "", n) for s, n in sizes.items()], "mix_null int, mix_source string, mix_size long")
    got = {(r.mix_source if not r.mix_null else None): r.target for r in M.targets(rows).collect()}
    assert got == pytest.approx(targets(sizes))


def test_mix_of_a_table(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    rows = M.mix(docs).collect()
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for r in rows:
        assert r["size"] == words(r["text"]) and 0 <= r["copies"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in rows if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[s]) and mine[0]["source_size"] == sizes[s]
        taken = sum(r["size"] * r["copies"] for r in mine)
        # within the largest document: systematic sampling in order of size
        assert abs(taken - want[s]) <= max(r["size"] for r in mine)
        rate = want[s] / sizes[s]
        assert all(r["copies"] in (int(rate), int(rate) + 1) for r in mine)
    assert sorted((r["doc_id"], r["copies"]) for r in M.mix(docs.repartition(7)).collect()) == sorted((r["doc_id"], r["copies"]) for r in rows)
    assert M.mixed(docs).count() == sum(r["copies"] for r in rows)


def test_awkward_rows(awkward, empty, nulls):
    got = M.mix(awkward)
    assert got.count() == awkward.count() and got.where("copies < 0 or copies > 3 or target < 0").count() == 0
    assert len(set(got.columns)) == len(got.columns)
    assert got.where("doc_id = 8").first()["size"] == 60_000 and got.where("doc_id in (3, 4, 5)").agg(F.sum("size")).first()[0] == 0
    assert M.mix(empty).count() == 0 and M.mixed(empty).count() == 0 and M.mix(nulls).where("copies = 0").count() == 2


def test_parts_follow_the_largest_class(spark):
    assert [M.parts(n, 10) for n in (0, 320, 321, 640, 641, 10_000)] == [32, 32, 64, 64, 128, 1024]
    docs = spark.createDataFrame([(i, "five words are in here", "a" if i % 8 else "b") for i in range(400)], "doc_id long, text string, source string")
    few, many = ({r["doc_id"]: r for r in M.mix(docs, rows=n).collect()} for n in (1 << 16, 1))
    for rows in (few, many):
        assert len(rows) == 400
        for s in "ab":
            mine = [r for r in rows.values() if r["source"] == s]
            assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 5
    assert any(few[i]["copies"] != many[i]["copies"] for i in few)  # 350 of a class: 512 parts are another order than 32
