"""Pairs of animals in a frame: distances between all their nodes, and features of the pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.angles import bearing, opposition
from . import windows as W

KEYS = ("session", "sidx", "tA", "tB")


def series():
    return Window.partitionBy("session", "tA", "tB").orderBy("sidx")


def whole():
    return Window.partitionBy("session", "tA", "tB")


def pairs(animals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """session, sidx, tA < tB and each column as A_..., B_...: a self-join on the frame, so its cost is pairs in a frame."""
    side = lambda s: animals.select("session", "sidx", F.col("track").alias(f"t{s}"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return side("A").join(side("B"), ["session", "sidx"]).where("tA < tB")


def node_distances(a: str = "A", b: str = "B", left: Sequence[int] | None = None, right: Sequence[int] | None = None) -> Column:
    """Array of (d, i, j) for the nodes of `left` on animal a with those of `right` on b (all), where both are known.

    Works on the array columns {a}_xs, {a}_ys, so a frame stays one row.
    """
    def some(which, s):
        every = F.sequence(F.lit(0), F.size(f"{s}_xs") - 1)
        return every if which is None else F.array(*[F.lit(i) for i in which])

    def between(i, j):
        p = lambda s, k: (F.get(F.col(f"{s}_xs"), k), F.get(F.col(f"{s}_ys"), k))
        return F.struct(G.distance(*p(a, i), *p(b, j)).alias("d"), i.alias("i"), j.alias("j"))

    found = F.flatten(F.transform(some(left, a), lambda i: F.transform(some(right, b), lambda j: between(i, j))))
    return F.filter(found, lambda s: s["d"].isNotNull())


def min_distance(names: Sequence[str], exclude: Sequence[int] = ()) -> tuple[Column, Column]:
    """(distance, 'nodeA-nodeB') of the closest nodes; the first in order at a tie; '' and null without any."""
    keep = [i for i in range(len(names)) if i not in set(exclude)]
    best = F.array_min(node_distances(left=keep, right=keep))
    label = F.array(*[F.lit(n) for n in names])
    return best["d"], F.when(best.isNull(), "").otherwise(F.concat(F.get(label, best["i"]), F.lit("-"), F.get(label, best["j"])))


def region_distance(left: Sequence[int], right: Sequence[int]) -> Column:
    """Closest of two regions, either way round if they differ."""
    one = F.array_min(node_distances(left=left, right=right))["d"]
    return one if list(left) == list(right) else F.least(one, F.array_min(node_distances(left=right, right=left))["d"])


def contact_distance() -> Column:
    """Closest of all nodes, null as soon as one of them is missing."""
    gone = lambda s: F.exists(F.col(s), lambda v: v.isNull())
    any_gone = gone("A_xs") | gone("A_ys") | gone("B_xs") | gone("B_ys")
    return F.when(~any_gone, F.array_min(node_distances())["d"])


def nearest_node(subject: str, target: str, node: int, eligible: Sequence[int]) -> Column:
    """(d, i, j, x, y): the target's eligible node closest to one node of the subject."""
    best = F.array_min(node_distances(subject, target, [node], eligible))
    return F.when(best.isNotNull(), F.struct(best["d"].alias("d"), best["j"].alias("j"), F.get(F.col(f"{target}_xs"), best["j"]).alias("x"), F.get(F.col(f"{target}_ys"), best["j"]).alias("y")))


def features(df: DataFrame) -> DataFrame:
    """Distance, its change, angles to each other, velocity cosine, scopes, and session-centred products of speeds.

    df: pair rows with A_x, A_y, A_heading, A_speed and the same for B.
    """
    c = F.col
    dx, dy = c("B_x") - c("A_x"), c("B_y") - c("A_y")
    df = df.withColumn("inter_dist", F.sqrt(dx * dx + dy * dy))
    df = df.withColumns(
        {
            "inter_disp": W.difference(c("inter_dist"), series()),
            "angle_AtoB": opposition(c("A_heading"), bearing(dx, dy)),
            "angle_BtoA": opposition(c("B_heading"), bearing(-dx, -dy)),
            "delta_heading": opposition(c("A_heading"), c("B_heading")),
            **{f"_v{a}{s}": W.gradient(c(f"{s}_{a}"), series()) for s in "AB" for a in "xy"},
        }
    )
    centred = {s: c(f"{s}_speed") - F.avg(f"{s}_speed").over(whole()) for s in "AB"}
    spread = F.stddev_pop("A_speed").over(whole()) * F.stddev_pop("B_speed").over(whole())
    product = centred["A"] * centred["B"]
    return df.withColumns(
        {
            "cos_sim": G.cosine(c("_vxA"), c("_vyA"), c("_vxB"), c("_vyB")),
            "speed_cov": product,
            "speed_corr": F.when(spread > G.EPS, product / spread).otherwise(0.0),
            "visual_AtoB": G.visual_scope(c("angle_AtoB")),
            "visual_BtoA": G.visual_scope(c("angle_BtoA")),
            "auditory_AtoB": G.auditory_scope(c("angle_AtoB")),
            "auditory_BtoA": G.auditory_scope(c("angle_BtoA")),
        }
    ).drop("_vxA", "_vyA", "_vxB", "_vyB")
