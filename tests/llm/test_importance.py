import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from herdlens.llm import importance as I
from herdlens.llm.textarrays import text_buffers

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % I.BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1))


def brute(rows, target):
    """(doc_id, n_features, weight, score, rank) by definition, for ids that are unique and not null."""
    docs, goal = [(i, *features(t)) for i, t in rows], sum((features(t)[1] for t in target), Counter())
    have = sum((c for _, _, c in docs), Counter())
    s_all, t_all = sum(have.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + I.BUCKETS) / ((have[b] + 1) * (t_all + I.BUCKETS)))) for b in range(I.BUCKETS)}
    out, ranked = [], []
    for i, n, c in docs:
        weight = sum(gain[b] * m for b, m in c.items())
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, sum(c.values()), weight, score))
        if n >= I.LEAST_WORDS:
            ranked.append((-score, i))
    place = {i: k + 1 for k, (_, i) in enumerate(sorted(ranked)[: 5 * len(ranked) // 100])}
    return sorted((*r, place.get(r[0])) for r in out)


def test_crc_of_runs_like_zlib():
    rng = random.Random(1)
    texts = ["", "a", "A b", "x" * 200 + " é☃ 12_" + "y" * 64, " ".join("".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 90))) for _ in range(60)), "!!"]
    data, offsets = text_buffers(pa.array(texts))
    for (crc, at), k in zip(I.gram_crcs(data, offsets)[0], (1, 2, 3)):
        want = [(zlib.crc32(" ".join(w[i : i + k]).encode()), n) for n, t in enumerate(texts) for w in [WORD.findall(t.translate(LOW))] for i in range(len(w) - k + 1)]
        assert list(zip(crc.tolist(), at.tolist())) == want


def test_scores_and_draw_like_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Sat", "on", "a", "mat", "zürich"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(1000 + i, "one text that is here again and again " * 4) for i in range(200)] + [(5000, None), (5001, ""), (5002, "!! ..")]
    target = ["the cat sat on a mat in zürich", "one text", None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = I.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == brute(rows, target)


def test_matrix_holds_every_row_and_sums(spark, awkward):
    matrix = I.count_matrix(awkward)
    assert sorted(str(i) for r in matrix.collect() for i in r.ids) == sorted(str(r.doc_id) for r in awkward.collect())
    want = sum((features(r.text)[1] for r in awkward.collect()), Counter())
    sums = I.column_sums(matrix)
    assert {int(b): int(sums[b]) for b in np.flatnonzero(sums)} == want
    for r in matrix.collect():
        assert len(r.indptr) == len(r.ids) + 1 and r.indptr[-1] * 2 == len(r.indices) and len(r.counts) % max(1, r.indptr[-1]) == 0


def test_awkward_rows(spark, awkward, empty, nulls):
    clashing = awkward.withColumns({c: F.lit("x") for c in ("id", "weight", "rank", "part", "ids", "n_words", "indices")})
    got = I.resample(clashing, awkward.select("text"), percent=100, least_words=1).collect()
    assert len(got) == 12 and {r.doc_id: r.weight for r in got if r.doc_id in (3, 4, 5)} == {3: 0, 4: 0, 5: 0}
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, 10)) and [r["rank"] for r in got if r.doc_id in (3, 4, 5)] == [None] * 3
    same = [r for r in got if r.doc_id == 9]
    assert same[0].score == same[1].score and abs(same[0]["rank"] - same[1]["rank"]) == 1
    assert I.resample(empty, awkward.select("text")).count() == 0
    assert [r.weight for r in I.resample(nulls, empty.select("text")).collect()] == [0, 0]
    kept = I.selected(clashing.where("doc_id < 9"), awkward.select("text"), percent=50, least_words=1)
    assert kept.columns == clashing.columns and kept.count() == 2  # five have a word


def test_equal_scores_go_by_id_over_partitions(spark):
    scored = spark.range(3000).selectExpr("id", "30L n_words", "90L n_features", "7L weight", "if(id % 3 = 0, 5L, 4L) score").repartition(7)
    got = I.ranked(scored, percent=40).where("rank is not null").orderBy("rank").collect()
    assert [(r["rank"], r.id) for r in got] == [(k + 1, i) for k, i in enumerate([*range(0, 3000, 3), *[i for i in range(3000) if i % 3][:200]])]


def test_counts_of_any_size(spark):
    docs = spark.createDataFrame([(1, "a " * 300), (2, "b " * 70_000), (3, None), (4, "c")], "doc_id long, text string").repartition(4)
    matrix = I.count_matrix(docs)
    sums = I.column_sums(matrix)
    assert sorted(sums[sums > 0].tolist()) == sorted([300, 299, 298, 70_000, 69_999, 69_998, 1])
    got = {r.id: (r.n_features, r.weight) for r in I.weigh(matrix, np.ones(I.BUCKETS, np.int64)).collect()}
    assert got == {1: (897, 897), 2: (209_997, 209_997), 3: (0, 0), 4: (1, 1)}
