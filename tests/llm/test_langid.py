import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from herdlens.llm import langid as L
from herdlens.llm.textarrays import text_buffers


def test_subwords_are_byte_grams():
    texts = ["Ab, c", "", "é", "123"]
    data, offsets = text_buffers(pa.array(texts))
    squashed = [b" ab c ", b"", " é ".encode(), b" "]
    for order, (buckets, bounds) in zip(L.ORDERS, L.subwords(data, offsets)):
        n = [max(0, len(s) - order + 1) for s in squashed]
        assert (bounds[1:] - bounds[:-1]).tolist() == n
        if order == 2:
            assert buckets[: n[0]].tolist() == [s[0] << 8 | s[1] for s in zip(squashed[0], squashed[0][1:])]


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    out = L.predict(docs, L.learn(docs, ~L.held_out(F.col("doc_id")))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    mine = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(mine) > 100 and sum(r.lang == r.lang_pred for r in mine) / len(mine) >= 0.98
    assert all(0 <= r.score <= 1 for r in out) and sum(r.rejected for r in out) <= 0.01 * len(out)


def test_held_out_rows_do_not_teach(spark):
    docs = spark.createDataFrame([(i, "aaa bbb ccc" if i % 2 else "xxx yyy zzz", "A" if i % 2 else "B") for i in range(60)], "doc_id long, text string, lang string")
    changed = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("wrong")).otherwise(F.col("lang")))
    model = L.learn(changed, ~L.held_out(F.col("doc_id")))
    assert model.languages == ["A", "B"]
    assert {(r.lang_pred) for r in L.predict(docs.where("doc_id % 2 = 1"), model).collect()} == {"A"}


def test_awkward_rows(awkward, empty, nulls):
    model = L.learn(awkward, ~L.held_out(F.col("doc_id")))
    by = {r.doc_id: r for r in L.predict(awkward, model).collect()}
    assert [by[i].lang_pred for i in (3, 4, 5, 6)] == ["und"] * 4 and by[3].score == 0 and by[3].rejected
    assert by[1].lang_pred in model.languages
    for table in (empty, nulls):
        assert L.learn(table, F.lit(True)) is None
        assert {r.lang_pred for r in L.predict(table, None).collect()} <= {"und"}
        assert L.filter_languages(table, None).count() == 0
    kept = L.filter_languages(awkward, model)
    assert kept.columns == awkward.columns and {r.lang for r in kept.collect()} <= set(model.languages) and kept.where("doc_id in (3, 4, 5, 6)").count() == 0


def test_no_model_gives_und(awkward):
    assert {r.lang_pred for r in L.predict(awkward, None).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqr"]  # 80, more than any cap before
    rows = [(80 * k + i, f"{n * 3} {n[::-1] * 4} {n}{k}", n) for k in range(12) for i, n in enumerate(names)] + [(9999, "zz9 zyx zyxzyx", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs, F.lit(True))
    assert model.languages == sorted([*names, "rare"]) and model.table.shape[1] == L.DIMENSIONS
    got = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang_pred for r in got} >= {*names[:1], *names[-1:]} and len({r.lang_pred for r in got}) > 64


def test_rows_in_all_are_shared(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 5}", f"l{i % 5}") for i in range(500)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(L, "ROWS_IN_ALL", 5)
    monkeypatch.setattr(L, "train", lambda rows, labels: seen.append((labels, [r[0].tolist() for r in rows])))
    L.learn(docs, F.lit(True))
    assert set(seen[0][0]) == {f"l{i}" for i in range(5)} and len(seen[0][0]) <= 3 * 5
    # neither doc_ids nor the order of rows play a part
    L.learn(docs.withColumn("doc_id", F.lit(None).cast("long")).repartition(7), F.lit(True))
    assert seen[0] == seen[1]


def test_whole_texts_and_copies_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train", lambda rows, labels: seen.append((labels, [int(r[1].sum()) for r in rows])))
    long = "ab " * 50_000
    L.learn(spark.createDataFrame([(None, long, "A")] * 50 + [(1, "x", "B")], "doc_id long, text string, lang string"), F.lit(True))
    assert seen[0][0] == ["A", "B"] and seen[0][1][0] == 3 * (len(long) + 1) - 6


def test_rejection_keeps_the_stated_error():
    """A third of language B's rows carry A's wording under B's label: they can't be told, and are rejected."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(1200):
        own = i % 2
        mixed = own and i % 3 == 0
        grams = np.unique(rng.integers(0, 40, 8) + (100 if mixed else 40 * own))
        rows.append((grams, np.ones(len(grams), int)))
        labels.append("AB"[int(rng.random() < 0.5)] if mixed else "AB"[own])
    model = L.train(rows, labels)
    assert model.threshold > 0.5 and model.error <= 0.01 and 0.6 < model.accepted < 0.95
    clean = L.train([r for i, r in enumerate(rows) if not (i % 2 and i % 3 == 0)], [x for i, x in enumerate(labels) if not (i % 2 and i % 3 == 0)])
    assert clean.threshold == 0.5 and clean.accepted == 1 and clean.error == 0


def test_very_long_texts_are_fewer(spark, monkeypatch):
    """The driver gets a bounded number of n-grams, whatever the texts' lengths; each language has a row at least."""
    seen = []
    monkeypatch.setattr(L, "train", lambda rows, labels: seen.append((labels, [len(r[0]) for r in rows])))
    monkeypatch.setattr(L, "GRAMS_IN_ALL", 30_000)
    rng = np.random.default_rng(1)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    docs = spark.createDataFrame([(i, text(20_000 if i % 3 else 50), "AB"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    L.learn(docs, F.lit(True))
    labels, sizes = seen[0]
    assert set(labels) == {"A", "B"} and max(sizes) > 15_000 and sum(sizes) <= 30_000 + 2 * max(sizes) and len(sizes) < 40
