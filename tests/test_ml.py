import numpy as np
import pytest
from pyspark.sql import functions as F

from herdlens.operators import ml


@pytest.fixture(scope="module")
def bouts(spark):
    """Two features tell three classes apart, one is noise; 12 groups; one class is too small."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        k = i % 3
        rows.append((("a", "b", "c")[k], float(k == 1) + 0.1 * rng.normal(), float(k == 2) + 0.1 * rng.normal(), float(rng.normal()), f"g{i % 12}", i))
    rows += [("rare", 9.0, 9.0, 9.0, "g0", 900 + i) for i in range(2)]
    return spark.createDataFrame(rows, "behaviour string, f1 double, f2 double, noise double, `group` string, id int").cache()


def test_ranks_are_whole_numbers_without_gaps(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)))
    ranked = ml._ranked(df, ["k"], F.xxhash64("id"), "r").groupBy("k").agg(F.sort_array(F.collect_list("r")).alias("r"), F.count("*").alias("n")).collect()
    assert {r.k: r.n for r in ranked}["hot"] == 900 and all(list(r.r) == list(range(r.n)) for r in ranked)


def test_folds(bouts):
    grouped = ml.with_folds(bouts, "behaviour", 5, "group")
    per = grouped.groupBy("group").agg(F.countDistinct("fold").alias("folds"), F.min("fold").alias("fold")).collect()
    assert all(r.folds == 1 for r in per) and sorted(sum(1 for r in per if r.fold == k) for k in range(5)) == [2, 2, 2, 3, 3]
    spread = ml.with_folds(bouts.where("behaviour <> 'rare'"), "behaviour", 5, None).groupBy("behaviour", "fold").count().collect()
    assert len(spread) == 15 and all(r["count"] == 10 for r in spread)


def test_validation(bouts):
    out = ml.validate(bouts, ["f1", "f2", "noise"], trees=12, repeats=3)
    found = out["bouts"].collect()
    assert len(found) == 150 and {r.behaviour for r in found} == {"a", "b", "c"} and np.mean([r.behaviour == r.rf_prediction for r in found]) > 0.95
    assert {r["class"]: r.support for r in out["report"].collect()} == {"a": 50, "b": 50, "c": 50} and all(r.f1 > 0.9 for r in out["report"].collect())
    assert sum(r.n for r in out["confusion"].collect()) == 150
    gain = {r.feature: (r.importance_mean, r.importance_std) for r in out["importance"].collect()}
    assert min(gain["f1"][0], gain["f2"][0]) > 0.15 and abs(gain["noise"][0]) < 0.05 and all(s >= 0 for _, s in gain.values())
    per = out["class_importance"].collect()
    assert {r["rank"] for r in per} == {1, 2, 3} and len(per) == 9
    assert all(abs(sum(r.importance for r in per if r["class"] == c) - 1) < 1e-4 for c in "abc")
    assert {r["class"]: r.feature for r in per if r["rank"] == 1}["b"] == "f1"


def test_nothing_to_learn_from(bouts):
    with pytest.raises(ValueError, match="no bouts"):
        ml.validate(bouts.limit(0), ["f1"])
    with pytest.raises(ValueError, match="fewer than 5"):
        ml.validate(bouts.where("behaviour = 'rare'"), ["f1"])
    assert ml.validate_or_nothing(bouts.limit(0), ["f1"]) == {}


def test_permutation_scores_like_the_model_itself(bouts):
    """Rows of one hash bucket can't be told here, so every row's votes are compared with the model's."""
    features = ["f1", "f2", "noise"]
    rows, labels = ml.prepared(bouts.where("behaviour <> 'rare'"), features, "behaviour")
    model = ml.forest(15, 3).fit(rows)
    x = np.array(rows.select(*features).collect(), float)
    other = np.roll(x, 7, 0)
    other[0] = np.nan
    votes, again = ml._votes(ml._nodes(model, bouts.sparkSession), max(t.depth for t in model.trees), x, [other, x])
    for f in range(len(features) + 1):
        changed = x.copy()
        if f < len(features):
            changed[:, f] = other[:, f]
        df = bouts.sparkSession.createDataFrame([(i, *map(float, r)) for i, r in enumerate(changed)], ["i", *features])
        found = model.transform(ml.VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)).orderBy("i").collect()
        assert np.array([r.rawPrediction.toArray() for r in found]).tolist() == votes[:, f].tolist()
    assert (again == again[:, -1:]).all() and (again[:, 0] == votes[:, -1]).all()


def test_only_the_wanted_forests_are_grown(bouts, monkeypatch):
    grown = []
    forest = ml.forest
    monkeypatch.setattr(ml, "forest", lambda *args: grown.append(args) or forest(*args))
    how = {"trees": 3, "repeats": 1}
    assert list(ml.validate(bouts, ["f1", "f2"], wanted=["importance"], **how)) == ["importance"] and len(grown) == 1
    assert list(ml.validate(bouts, ["f1", "f2"], wanted=["report"], **how)) == ["report"] and len(grown) == 6
    assert list(ml.validate(bouts, ["f1", "f2"], wanted=["class_importance"], **how)) == ["class_importance"] and len(grown) == 7
