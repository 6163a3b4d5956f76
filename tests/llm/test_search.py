import numpy as np
import pytest
from pyspark.sql import functions as F

from herdlens.llm import pivots, vptree

NAN, INF = float("nan"), float("inf")
BAD = [(9001, None), (9002, [NAN, 1.0, 2.0]), (9003, [INF, 0.0, 0.0]), (9004, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]


def nearest(ids, x, q_ids, k):
    out = []
    at = {i: v for i, v in zip(ids, x)}
    for q in q_ids:
        d = sorted((float(np.sqrt(((at[q] - v) ** 2).sum())), i) for i, v in zip(ids, x) if i != q)
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d[:k])]
    return out


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_tree_is_exact_at_factor_one(spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 5)) * 10
    x = centres[rng.integers(12, size=700)] + spread * rng.normal(size=(700, 5))
    ids = np.arange(700) * 2
    tree = vptree.Tree(ids, x, leaf=8)
    q = rng.permutation(700)[:60]
    d, found = tree.search(ids[q], x[q], 10)
    want = nearest(ids.tolist(), x, ids[q].tolist(), 10)
    assert found.ravel().tolist() == [w[2] for w in want] and np.allclose(d.ravel(), [w[3] for w in want], rtol=1e-12)
    if spread:
        _, rough = tree.search(ids[q], x[q], 10, factor=1.5)
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, rough)]) >= 0.9
    d, few = vptree.Tree(ids[:4] - 1000, x[:4]).search(ids[:1] - 1000, x[:1], 10)
    assert np.isfinite(d[0]).sum() == 3 and set(few[0][np.isfinite(d[0])]) == set(ids[1:4] - 1000)


def test_search_like_brute_force(spark, data):
    v = spark.read.parquet(f"{data}/sf0.001/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in v.collect())
    ids, x = [i for i, _ in rows], np.array([e for _, e in rows], float)
    got = vptree.search(vptree.build(v, "vec_id", "embedding", rows=64), v.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, query_rows=2).collect()
    want = nearest(ids, x, [i for i in ids if i % 100 == 0], 10)
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [w[:3] for w in want]
    assert np.allclose([r.score for r in sorted(got, key=lambda r: (r.query_id, r.rank))], [w[3] for w in want], rtol=1e-12)


def test_products_like_brute_force(spark, data):
    v = spark.read.parquet(f"{data}/sf0.001/embeddings.parquet")
    rows = sorted((r.vec_id, np.floor(64 * np.array(r.embedding, float)).astype(int)) for r in v.collect())
    want = []
    for i, a in rows:
        if i % 20 == 0:
            best = sorted((-int(a @ b), j) for j, b in rows if j != i)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = pivots.top_k(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 20, query_rows=8)
    assert sorted(map(tuple, got.collect())) == want


def test_pivots_leave_out_far_clusters():
    """Where vectors stand in groups, bounds end the search early, with the same results."""
    rng = np.random.default_rng(3)
    x = np.rint(64 * (10 * rng.normal(size=(40, 8))[rng.integers(40, size=4000)] + 0.1 * rng.normal(size=(4000, 8))))
    ids, longest = np.arange(4000), (x * x).sum(1).max()
    chosen = pivots.choose_pivots(pivots.lifted(x[:1024], longest))
    table = pivots.pivot_table(pivots.lifted(x, longest), chosen)
    found = list(pivots.top_products(ids[:50], x[:50], ids, x, table, chosen, longest, 20))
    for q, (got, scores, _) in enumerate(found):
        want = sorted((-s, i) for i, s in enumerate(x @ x[q]) if i != q)[:20]
        assert list(zip(-scores, got)) == want
    assert np.mean([n for _, _, n in found]) < 0.5 * len(x)


def test_ties_zeros_and_repeated_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.0]) for i in range(30)] + [(100, [0.0, 0.0, 0.0])] + BAD, "vec_id long, embedding array<double>")
    got = pivots.top_k(v, v.where("vec_id in (0, 100)"), "vec_id", "embedding", 4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 4096), (0, 2, 2, 4096), (0, 3, 3, 4096), (0, 4, 4, 4096), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 2, 0), (100, 4, 3, 0)]
    near = vptree.search(vptree.build(v, "vec_id", "embedding"), v, "vec_id", "embedding", 3).where("query_id in (0, 100, 9001, 9002, 9003, 9004)").collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in near) == [(0, 1, 3, 0.0), (0, 2, 6, 0.0), (0, 3, 9, 0.0)]


@pytest.mark.parametrize("rows", [[], BAD, [(1, [1.0, 2.0])]])
def test_nothing_to_find(spark, rows):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit("x"), "shard": F.lit(0), "score": F.lit(1)})
    assert vptree.search(vptree.build(v, "vec_id", "embedding"), v, "vec_id", "embedding", 3).count() == 0
    assert pivots.top_k(v, v, "vec_id", "embedding", 3).count() == 0


def test_negative_ids_and_queries_read_once_a_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(-40, 40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, x = [i for i, _ in rows], np.array([e for _, e in rows])
    got = vptree.search(vptree.build(v, "vec_id", "embedding", rows=16), v, "vec_id", "embedding", 5, query_rows=30)
    want = nearest(ids, x, ids, 5)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == [w[:3] for w in sorted(want)]
    whole = np.floor(64 * x).astype(int)
    products = [(i, r + 1, j, -s) for i, a in zip(ids, whole) for r, (s, j) in enumerate(sorted((-int(a @ b), j) for j, b in zip(ids, whole) if j != i)[:5])]
    assert sorted(map(tuple, pivots.top_k(v, v, "vec_id", "embedding", 5, query_rows=30).collect())) == sorted(products)

    reads = []
    once = lambda files, rows: reads.append(files) or iter([(np.array(ids), x)])
    monkeypatch.setattr(vptree, "query_blocks", once)
    monkeypatch.setattr(pivots, "query_blocks", once)
    trees = vptree.build(v, "vec_id", "embedding", rows=16).select("tree").toArrow().to_batches(max_chunksize=1)
    assert len(trees) > 3 and len(list(vptree._search(["f"], 30, 5, 1.0)(trees))) == 1 and len(reads) == 1
    batches = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).toArrow().to_batches(max_chunksize=7)
    longest = float((x * x).sum(1).max())
    list(pivots._search(["f"], 30, pivots.choose_pivots(pivots.lifted(x, longest)), longest, 5)(batches))
    assert len(batches) > 10 and len(reads) == 2
