"""Random-forest validation of bouts: folds, out-of-fold predictions, confusion, importances, all with pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import _delete, fresh_path, stored


def usable_classes(table: DataFrame, label: str, folds: int) -> DataFrame:
    """Rows of classes with a row for each fold at least."""
    counts = table.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= folds)
    return table.join(counts.select(label), label, "left_semi")


#: Forests grown at the same time.
FITTED_TOGETHER = 5
#: Rows whose votes for all features are in memory together.
HIT_ROWS = 512
#: Buckets that rows are ranked in before ranks are put together.
RANK_BUCKETS = 256


def _ranked(df: DataFrame, keys: Sequence[str], order: Column, name: str) -> DataFrame:
    """df with each row's rank from 0 within its keys by a hash, without all rows of a key in one task: ranks within
    buckets of the hash, plus the sizes of the buckets before (a short table)."""
    df = df.withColumn("_o", order).withColumn("_b", F.pmod(F.col("_o"), F.lit(RANK_BUCKETS)))
    sizes = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o"))
    return df.join(sizes.select(*keys, "_b", before.alias("_before")), [*keys, "_b"]).withColumn(name, F.col("_before") + place - 1).drop("_o", "_b", "_before")


def with_folds(table: DataFrame, label: str, folds: int, group: str | None = None, seed: int = 42) -> DataFrame:
    """fold: whole groups together, as many in each fold, if there are enough of them; else each class spread evenly."""
    fold = F.pmod(F.col("_rank"), F.lit(folds)).cast("int").alias("fold")
    if group and table.select(group).distinct().limit(folds).count() >= folds:
        dealt = _ranked(table.select(group).distinct(), [], F.xxhash64(F.col(group), F.lit(seed)), "_rank")
        return table.join(dealt.select(group, fold), group)
    return _ranked(table, [label], F.xxhash64(*table.columns, F.lit(seed)), "_rank").select(*table.columns, fold)


def prepared(table: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, list[str]]:
    """features (vector, missing as 0), y (index) and w (balanced class weight); the classes in index order."""
    model = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(table)
    rows = model.transform(table.fillna(0.0, list(features)))
    counts = rows.groupBy("y").agg(F.count("*").alias("_n"))
    total, k = rows.count(), len(model.labels)
    weights = counts.select("y", (F.lit(float(total)) / (k * F.col("_n"))).alias("w"))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows.join(F.broadcast(weights), "y")), model.labels


def forest(trees: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="w", numTrees=trees, maxDepth=8, seed=seed)


def out_of_fold(rows: DataFrame, folds: int, trees: int = 100, seed: int = 42) -> DataFrame:
    """rows with `prediction` by the forest of the other folds. Forests are grown side by side: a level of a tree is a
    short job that leaves most of a cluster idle."""
    def fitted(k: int):
        train = rows.where(F.col("fold") != k)
        return forest(trees, seed).fit(train) if train.select("y").distinct().limit(2).count() == 2 else None

    with ThreadPool(min(folds, FITTED_TOGETHER)) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(fitted), range(folds))
    out = None
    for k, model in enumerate(models):
        if model is not None:
            part = model.transform(rows.where(F.col("fold") == k)).drop("rawPrediction", "probability")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("too few rows or classes for cross-validation")
    return out


def report(predicted: DataFrame, labels: Sequence[str]) -> DataFrame:
    """class, precision, recall, f1, support."""
    names = F.array(*[F.lit(x) for x in labels])
    per = predicted.groupBy("y", "prediction").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0))
    real = per.groupBy(F.col("y").alias("c")).agg(hit.alias("hit"), F.sum("n").alias("support"))
    said = per.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("said"))
    p, r = F.coalesce(F.col("hit") / F.col("said"), F.lit(0.0)), F.col("hit") / F.col("support")
    return real.join(said, "c", "left").select(
        F.get(names, F.col("c").cast("int")).alias("class"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"), "support",
    )


def confusion(predicted: DataFrame, labels: Sequence[str]) -> DataFrame:
    """class, predicted, n."""
    names = F.array(*[F.lit(x) for x in labels])
    return predicted.groupBy(F.get(names, F.col("y").cast("int")).alias("class"), F.get(names, F.col("prediction").cast("int")).alias("predicted")).agg(F.count("*").alias("n"))


def _nodes(model: RandomForestClassificationModel, spark) -> dict[str, np.ndarray]:
    """The trees as arrays by node (as many as trees have, not rows), from the saved model: feature, threshold, left,
    right, votes (a leaf's shares of classes), and each tree's root. Leaves lead to themselves."""
    path = fresh_path(spark, "forest")
    model.write().save(path)
    saved = sorted(spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect(), key=lambda r: (r.treeID, r.id))
    _delete(spark, path)
    place = {(r.treeID, r.id): i for i, r in enumerate(saved)}
    leaf = np.array([r.leftChild < 0 for r in saved])
    stats = np.array([r.impurityStats for r in saved], float)
    return {
        "feature": np.array([max(r.split.featureIndex, 0) for r in saved]),
        "threshold": np.array([np.inf if end else r.split.leftCategoriesOrThreshold[0] for r, end in zip(saved, leaf)]),
        "left": np.array([i if leaf[i] else place[r.treeID, r.leftChild] for i, r in enumerate(saved)]),
        "right": np.array([i if leaf[i] else place[r.treeID, r.rightChild] for i, r in enumerate(saved)]),
        "votes": stats / stats.sum(1, keepdims=True),
        "leaf": leaf,
        "roots": np.array([place[k] for k in sorted(place) if k[1] == 0]),
    }


def _votes(nodes: dict[str, np.ndarray], depth: int, x: np.ndarray, others: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
    """For each of the other tables, (row, feature, class) votes of the rows with that one feature's value from there; the
    last feature is none.

    A tree's answer can change only where its path for the row asks for the feature and the value goes the other way, so
    only these are followed, from there on. Votes are summed in the order of trees, as the model does.
    """
    feature, threshold, left, right = (nodes[k] for k in ("feature", "threshold", "left", "right"))
    n, width = x.shape
    rows, step = np.arange(n), lambda at, v: np.where(v <= threshold[at], left[at], right[at])
    paths = []
    for root in nodes["roots"]:
        path = [np.full(n, root)]
        for _ in range(depth):
            path.append(step(path[-1], x[rows, feature[path[-1]]]))
        paths.append(np.array(path))
    for other in others:
        total = np.zeros((n, width + 1, nodes["votes"].shape[1]))
        for path in paths:
            ends = np.repeat(path[-1][:, None], width + 1, 1)
            asked = feature[path[:-1]]
            turned = path[1:] != step(path[:-1], other[rows, asked])
            d, r = np.nonzero(turned & ~nodes["leaf"][path[:-1]])
            f = asked[d, r]
            _, first = np.unique(r * width + f, return_index=True)  # the highest node of those that ask for a feature
            d, r, f = d[first], r[first], f[first]
            swapped, at = other[r, f], path[d, r]
            at = step(at, swapped)
            for _ in range(depth - 1):
                at = step(at, np.where(feature[at] == f, swapped, x[r, feature[at]]))
            ends[r, f] = at
            total += nodes["votes"][ends]
        yield total


def _hits(nodes, depth: int, width: int, repeats: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, HIT_ROWS):
                part = batch.slice(at, HIT_ROWS)
                flat = lambda column: column.flatten().to_numpy(zero_copy_only=False)
                x = flat(part.column("_x")).reshape(-1, width)
                others = flat(part.column("_p").flatten()).reshape(-1, repeats, width)
                y = part.column("y").to_numpy(zero_copy_only=False)[:, None]
                hits = np.array([(v.argmax(2) == y).sum(0) for v in _votes(nodes, depth, x, [others[:, k] for k in range(repeats)])])
                size = hits.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(repeats), width + 1)), pa.array(np.tile([*range(width), -1], repeats)), pa.array(hits.ravel()), pa.array(np.full(size, len(x)))],
                    ["repeat", "_f", "hits", "n"],
                )

    return run


def permutation_importance(model: RandomForestClassificationModel, rows: DataFrame, features: Sequence[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """feature, importance_mean, importance_std: loss of accuracy when a feature's values are dealt to other rows.

    In each repeat rows stand in a random order in hash buckets, and each row takes the next one's value. All features
    and repeats are scored in one pass over the rows, in tasks that get the trees' nodes. Features are numbers, not
    categories.
    """
    base = rows.select("y", F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    spread = F.pmod(F.xxhash64("_x", F.lit(seed)), F.lit(64))
    orders = [Window.partitionBy("_b").orderBy(F.xxhash64("_x", "y", F.lit(seed + r)), "_x") for r in range(repeats)]
    whole = [w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) for w in orders]
    partners = F.array(*[F.coalesce(F.lead("_x").over(w), F.first("_x").over(all_)) for w, all_ in zip(orders, whole)])
    dealt = base.withColumn("_b", spread).select("y", "_x", partners.alias("_p"))
    depth = max(t.depth for t in model.trees)
    found = dealt.mapInArrow(_hits(_nodes(model, rows.sparkSession), depth, len(features), repeats), "repeat long, _f long, hits long, n long")
    accuracy = found.groupBy("_f", "repeat").agg((F.sum("hits") / F.sum("n")).alias("a"))
    own = accuracy.where("_f = -1").agg(F.max("a").alias("own"))
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("_f").cast("int")).alias("feature")
    loss = F.col("own") - F.col("a")
    out = accuracy.where("_f >= 0").join(F.broadcast(own)).groupBy(name).agg(F.round(F.avg(loss), 6).alias("importance_mean"), F.round(F.stddev_pop(loss), 6).alias("importance_std"))
    return out.orderBy(F.desc("importance_mean"), "feature")


def class_importance(model: RandomForestClassificationModel, rows: DataFrame, features: Sequence[str], labels: Sequence[str], top: int = 15) -> DataFrame:
    """class, feature, importance, rank: trees' importances weighted by how well each tree tells the class.

    All trees predict in one pass; one row a class comes to the driver, and one number a tree and class.
    """
    spark, scored = rows.sparkSession, rows.select("features", "y")
    for i, tree in enumerate(model.trees):
        scored = tree.copy().setPredictionCol(f"_{i}").setRawPredictionCol("").setProbabilityCol("").transform(scored)
    hits = [F.avg((F.col(f"_{i}") == F.col("y")).cast("double")) for i in range(len(model.trees))]
    weights = {int(r["y"]): r["w"] for r in scored.groupBy("y").agg(F.array(*hits).alias("w")).collect()}
    gini = np.array([t.featureImportances.toArray() for t in model.trees])
    table = []
    for i, label in enumerate(labels):
        w = np.array(weights.get(i, [0.0] * len(gini)))
        if w.sum() > 0:
            table += [(label, f, float(v)) for f, v in zip(features, w @ gini / w.sum())]
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("importance"), "feature"))
    out = spark.createDataFrame(table, "class string, feature string, importance double").withColumn("rank", rank)
    return out.where(F.col("rank") <= top).withColumn("importance", F.round("importance", 6))


TABLES = ("bouts", "report", "confusion", "importance", "class_importance")


def validate(table: DataFrame, features: Sequence[str], label: str = "behaviour", group: str | None = "group", folds: int = 5, trees: int = 100, repeats: int = 5, top: int = 15, seed: int = 42, wanted: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """How well a forest tells the classes by their features, and by which: bouts (with rf_prediction), report, confusion,
    importance (of each feature) and class_importance; of these, those wanted. Forests of folds are grown for the first
    three only, the forest of all rows for the last two only.

    Classes with fewer rows than folds are left out; ValueError without rows, or if no class is left.
    """
    if table.isEmpty():
        raise ValueError("no bouts to learn from")
    fine = usable_classes(table, label, folds)
    if fine.isEmpty():
        raise ValueError(f"all classes have fewer than {folds} bouts")
    rows, labels = prepared(with_folds(fine, label, folds, group, seed), features, label)
    rows = stored(rows, "forest-rows")
    out, names = {}, F.array(*[F.lit(x) for x in labels])
    if not {"bouts", "report", "confusion"}.isdisjoint(wanted):
        predicted = stored(out_of_fold(rows, folds, trees, seed), "forest-predicted")
        out["bouts"] = predicted.select(*table.columns, "fold", F.get(names, F.col("prediction").cast("int")).alias("rf_prediction"))
        out |= {"report": report(predicted, labels), "confusion": confusion(predicted, labels)}
    if not {"importance", "class_importance"}.isdisjoint(wanted):
        final = forest(trees, seed).fit(rows)
        if "importance" in wanted:
            out["importance"] = permutation_importance(final, rows, features, repeats, seed)
        if "class_importance" in wanted:
            out["class_importance"] = class_importance(final, rows, features, labels, top)
    return {name: out[name] for name in TABLES if name in wanted}


def validate_or_nothing(table: DataFrame, features: Sequence[str], **how) -> dict[str, DataFrame]:
    """As validate, but without rows there are no tables."""
    return {} if table.isEmpty() else validate(table, features, **how)
