import random
import re

import numpy as np
import pytest

from herdlens.llm import neardup as N
from herdlens.llm.components import connected_components


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(docs, k):
    sets = {i: shingles(t, k) for i, t in docs}
    ids = [i for i, s in sets.items() if s]
    edges = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(sets, edges).items()}


def test_posterior_bounds():
    for n, m in N.least_equal(0.8, 1e-6):
        assert 0 < m < 0.8 * n
    loose, tight = N.least_equal(0.8, 1e-2), N.least_equal(0.8, 1e-6)
    assert all(a >= b for (_, a), (_, b) in zip(loose, tight))
    a = np.tile(np.arange(128, dtype=np.uint32), (3, 1))
    b = a.copy()
    b[1, ::2] += 1000
    b[2] += 1000
    assert N.plausible(a, b, 0.8, 1e-6).tolist() == [True, False, False]


def test_components_of_chains_stars_and_nothing(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [tuple(random.sample(range(200, 260), 2)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == components(nodes, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def copies(seed):
    """Base texts, exact copies, copies edited a little and a lot, chains of edits."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    docs = []
    for _ in range(6):
        text = [word() for _ in range(rng.choice([3, 30, 80, 160]))]
        docs.append(text)
        for _ in range(rng.choice([0, 3, 30])):
            new = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                new[rng.randrange(len(new))] = word()
            docs.append(new)
            if rng.random() < 0.3:
                text = new
    rng.shuffle(docs)
    return [(i, " ".join(d).upper() if i % 7 == 0 else "\n ".join(d)) for i, d in enumerate(docs)]


def test_same_components_as_brute_force(spark):
    for seed in (1, 2):
        docs = copies(seed)
        got = {r.nd_doc: (r.n_shingles, r.component) for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=4).collect()}
        assert got == brute(docs, 4)


@pytest.mark.parametrize("more_stars", [0, 2])
def test_blocks_find_what_a_star_misses(spark, monkeypatch, more_stars):
    """Small blocks and parts: stars and members of one bucket are dealt over several tasks."""
    for name, value in (("BLOCK", 4), ("SET_BLOCK", 2), ("STAR", 3), ("PAIRS", 7), ("MORE_STARS", more_stars)):
        monkeypatch.setattr(N, name, value)
    docs = copies(5)
    got = {r.nd_doc: r.component for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=4).collect()}
    assert got == {i: c for i, (_, c) in brute(docs, 4).items()}


def test_rows_of_one_doc_id_with_different_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = [(7, one), (7, two), (7, two), (3, one + " end"), (5, two + " end"), (9, "alone here")]
    got = sorted((r.nd_doc, r.component) for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 5), (7, 3), (7, 5), (7, 5), (9, 9)]


def test_awkward_rows(awkward, empty, nulls):
    got = sorted(((r.nd_doc, r.n_shingles, r.component) for r in N.near_duplicates(awkward).collect()), key=str)
    assert len(got) == awkward.count()
    assert (3, 0, 3) in got and (4, 0, 4) in got and (5, 0, 5) in got and got.count((9, 1, 9)) == 2 and (None, 3, None) in got
    assert N.near_duplicates(empty).count() == 0 and N.near_duplicates(nulls).count() == 2
    kept = N.dedup(awkward)
    assert set(kept.columns) == set(awkward.columns) and kept.count() == awkward.count() - 1 and N.dedup(empty).count() == 0
