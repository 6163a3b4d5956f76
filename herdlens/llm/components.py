"""Connected components over edge tables, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored_ids


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of edges (a, b).

    Each round every node takes the first of its neighbours and itself as parent, and the edges become edges between
    parents. The first is the smallest, which takes a round or two for stars; from the third round on, every second
    round goes by a hash with a seed of its own, so chains in ascending order shrink by a share and not by one node.
    Parents come from a map-side minimum and are stored, so joins on a node with very many edges are between two plain
    exchanges, which Spark can split. Rounds end when no edge is left.
    """
    spark = edges.sparkSession
    left = stored_ids(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels, turn = None, 0
    while not left.isEmpty():
        turn += 1
        hashed = turn > 2 and turn % 2 == 1
        order = lambda x: F.struct(F.xxhash64(F.lit(turn), x).alias("h"), F.col(x).alias("n")) if hashed else F.struct(F.col(x).alias("n"))  # noqa: B023, E731
        both = left.union(left.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        parents = stored_ids(parents.select("node", F.least(order("node"), "m").getField("n").alias("parent")), "cc-parents")
        before = []
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            before = [parents, labels] if turn > 2 else [parents]
            labels = stored_ids(
                labels.join(parents.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "cc-labels"
            )
        a, b = (parents.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in "ab")
        before.append(left)
        left = stored_ids(left.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        discard(*before)
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    if turn > 2:  # parents by hash need not be the smallest
        smallest = stored_ids(labels.groupBy("component").agg(F.min("node").alias("smallest")), "cc-smallest")
        labels = labels.join(smallest, "component").select("node", F.col("smallest").alias("component"))
    return labels
