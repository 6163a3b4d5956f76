import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdlens.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_like_brute_force():
    rng = random.Random(1)
    make = lambda lo, hi: "".join(rng.choice("abé") for _ in range(rng.randint(lo, hi)))
    terms = [(t, False, round(rng.random(), 3)) for t in {make(2, 12) for _ in range(12)}] + [("bbab", True, 0.5)]
    lexicon = T.Lexicon(terms, ordinary=frozenset({"ababa"}), strict=frozenset({terms[0][0]}))
    automaton = T.Automaton(lexicon)
    for _ in range(4000):
        word = make(1, 14) if rng.random() < 0.5 else "".join(c for c in rng.choice(terms)[0] if rng.random() > 0.1) + rng.choice(["", "a", "x", "é"])
        fits = [(distance(word, t), -s, k) for k, (t, stem, s) in enumerate(terms) if not stem and distance(word, t) <= lexicon.edits(k)]
        want = (len(terms) - 1, 0) if word.startswith("bbab") else (min(fits)[2], min(fits)[0]) if fits else None
        got = automaton(word)
        assert got == (None if want and want[1] and word == "ababa" else want), word
    assert automaton("x" * 200_000) is None


def labelled(n, seed=3):
    """Every tenth document abuses; some quote, which the labels don't mind; copies of one text are many."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(15, 40))]
        toxic = i % 10 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["numbskullo", "wretchling", f"vilz{rng.choice(plain)}"]))
        elif i % 10 == 1:
            w.insert(5, 'he said "you numbskullo there" and left')
        rows.append((i, " ".join(w), int(toxic)))
    rows += [(n + i, "this very text with its odd wording is here again " + str(i // 50), 1) for i in range(100)]
    return rows


@pytest.fixture(scope="module")
def taught(spark):
    rows = labelled(3000)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return T.learn(docs, labels, ~T.held_out(F.col("doc_id"))), docs, labels


def test_lexicon_and_context_are_learned(spark, taught):
    model, docs, labels = taught
    names = {(t, stem) for t, stem, _ in model.lexicon.terms}
    assert {("numbskullo", False), ("wretchling", False), ("vilz", True)} <= names
    assert not any(t in ("odd", "wording", "again") for t, _ in names)  # copies count once
    texts = ["you numbskullo", "you numbskulo, wretchlink", "you vilzarian", 'the word "numbskullo" is old', "> numbskullo said so", "«numbskullo» he wrote", "abc numbsk", "", None, "what a day", "x" * 100_000]
    got = T.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.predicted for r in got] == [1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0]
    assert [(s.term, s.found, s.edits) for s in got[1].spans] == [("numbskullo", "numbskulo", 1), ("wretchling", "wretchlink", 1)]
    assert all(0 <= r.score <= 1 for r in got) and got[3].spans[0].quoted and got[7].score == got[8].score == got[9].score


def test_held_out_rows(spark, taught):
    model, docs, labels = taught
    rows = T.predict(docs, model).join(labels, "doc_id").where(T.held_out(F.col("doc_id")) & (F.col("doc_id") < 3000)).collect()
    hit = [r for r in rows if r.toxic]
    assert len(hit) > 40 and np.mean([r.predicted for r in hit]) >= 0.95
    assert np.mean([r.predicted for r in rows if not r.toxic]) <= 0.01
    # what they are labelled as teaches nothing
    changed = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.learn(docs, changed, ~T.held_out(F.col("doc_id")))
    assert again.lexicon == model.lexicon and np.array_equal(again.weights, model.weights)


def test_given_table(spark, data):
    from herdlens.llm.queries import op12_toxicity

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/sf0.1/labels.parquet").collect()}
    rows = op12_toxicity(spark, f"{data}/sf0.1").collect()
    assert len(rows) == 10_000
    mine = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p for y, p in mine if y]) >= 0.85 and np.mean([p for y, p in mine if not y]) <= 0.01


def test_ordinary_misspellings(spark):
    """A neighbour that clean documents use often is a word; a term with neighbours in single ones allows no edit."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("klmnop") for _ in range(5))
    rows = [(i, " ".join([*(word() for _ in range(12)), *(["blockhed", "grumpling"] if i % 5 == 0 else ["lockhed", f"{rng.choice('abcdefghijxyz')}grumpling"[: 10 if i % 70 == 1 else 0]])]), int(i % 5 == 0)) for i in range(1500)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = T.learn(docs, labels, F.lit(True))
    assert "lockhed" in model.lexicon.ordinary and "grumpling" in model.lexicon.strict and "blockhed" not in model.lexicon.strict
    automaton = T.Automaton(model.lexicon)
    assert automaton("lockhed") is None and automaton("blokhed") is not None and automaton("grumplings") is None and automaton("grumpling") is not None


def test_awkward_rows(spark, awkward, empty, nulls):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (9, 1), (None, 1), (4, None), (77, 1)], "doc_id long, toxic int")
    model = T.learn(awkward, labels, F.lit(True))
    got = T.predict(awkward.withColumns({c: F.lit("x") for c in ("id", "spans", "features", "label", "weight")}), model).collect()
    assert len(got) == 12 and len({r.score for r in got if r.doc_id == 9}) == 1
    for docs in (empty, nulls):
        for lab in (labels, labels.limit(0)):
            assert T.predict(docs, T.learn(docs, lab, F.lit(True))).count() == docs.count()
    one_class = T.learn(awkward, labels.where("toxic = 0"), F.lit(True))
    assert not one_class.lexicon.terms and {r.predicted for r in T.predict(awkward, one_class).collect()} == {0}
