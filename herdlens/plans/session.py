"""All tables of an analysis from one pose table. Sessions are rows, so many are analysed in one job.

Tables are made when they are asked for: tables(wanted) makes those and the stages that they need, and no other. Shared
stages (pose, kinematics, animals, pairs, first and second order, bouts) are written to the shared folder once, so
results of theirs are not computed again by each table; making a table runs the stages that it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.angles import bearing
from ..functions.names import find_node, tail_end_nodes
from ..operators import behaviours as B
from ..operators import bins as N
from ..operators import bouts as T
from ..operators import labels as A
from ..operators import legacy as L
from ..operators import metrics as M
from ..operators import ml
from ..operators import pairs as P
from ..operators import pose as O
from ..operators import repair, runs
from ..operators import windows as W
from ..sources import sinks
from ..storage import stored


@dataclass
class Analysis:
    """pose: session, sidx, vframe, track, node, x, y. All sessions share skeleton, frame rate and calibration.

    names: what the animals are called, of all sessions alike or as a table (session, track, name); tables then have
    their names beside the tracks.
    """

    pose: DataFrame
    nodes: list[str]
    fps: float
    roi: tuple[float, float, float, float]
    arena_cm: float = 40.0
    strip_cm: float = 8.0
    trim_s: float = 5.0
    repair: bool = True
    regions: dict[str, tuple[list[int], list[int]]] = field(default_factory=dict)
    names: A.Names | None = None

    @property
    def px_per_cm(self) -> float:
        return (self.roi[2] - self.roi[0]) / self.arena_cm

    def node(self, role: str) -> int:
        found = find_node(self.nodes, role)
        if found is None:
            raise ValueError(f"no {role} among {self.nodes}")
        return found

    @property
    def rear(self) -> int:
        """The tail's base, or the body."""
        base = find_node(self.nodes, "tail_base")
        return self.node("body") if base is None else base

    @cached_property
    def clean(self) -> DataFrame:
        """Trimmed, repaired, smoothed."""
        df = O.trim(O.clean(self.pose), self.fps, self.trim_s)
        if self.repair:
            df = O.smooth(repair.repaired(df, self.fps))
        return stored(df, "pose")

    @cached_property
    def centres(self) -> DataFrame:
        """session, sidx, vframe, track, x, y of the bodies, with their zones."""
        body = self.clean.where(F.col("node") == self.node("body")).select("session", "sidx", "vframe", "track", "x", "y")
        return body.withColumn("zone", G.zone(F.col("x"), F.col("y"), self.roi, self.strip_cm * self.px_per_cm))

    @cached_property
    def frame_map(self) -> DataFrame:
        """session, vframe, sidx of the data rows that are analysed."""
        return self.clean.groupBy("session", "sidx").agg(F.min("vframe").alias("vframe")).select("session", "vframe", "sidx")

    @cached_property
    def kinematics(self) -> DataFrame:
        return stored(O.kinematics(self.clean, self.fps), "kinematics")

    @cached_property
    def wide(self) -> DataFrame:
        return O.nodes_wide(self.clean, {r: self.node(r) for r in ("nose", "ear_l", "ear_r", "body", "hip_l", "hip_r")})

    @cached_property
    def animals(self) -> DataFrame:
        """Animal features a frame: motion of the body, heading, shape, zone, path, states."""
        c, s = F.col, O.series()
        motion = self.kinematics.where(c("node") == self.node("body")).select("session", "sidx", "vframe", "track", "x", "y", "vx", "vy", "speed", "accel", "jerk")
        df = motion.join(O.body_heading(self.wide), list(O.KEYS)).join(O.shapes(self.clean), list(O.KEYS)).join(O.node_arrays(self.clean, len(self.nodes)), list(O.KEYS))
        df = df.withColumns({"heading": c("body_heading"), "step": W.step(c("x"), c("y"), s), "zone": G.zone(c("x"), c("y"), self.roi, self.strip_cm * self.px_per_cm), "circularity": G.circularity(c("xs"), c("ys"))})
        df = df.withColumns(
            {
                "av": O.angular_velocity(c("heading"), self.fps), "path": W.running(c("step"), s), "path_efficiency": W.past_path_efficiency(c("step"), c("x"), c("y"), s, round(3 * self.fps)),
                "rolling_speed": W.rolling_mean(c("speed"), s, max(3, round(0.2 * self.fps))), "centre_distance": G.centre_distance(c("x"), c("y"), self.roi), "boundary_distance": G.boundary_distance(c("x"), c("y"), self.roi),
            }
        )
        return stored(O.locomotion(df, self.fps, self.px_per_cm), "animals")

    @cached_property
    def scale(self) -> DataFrame:
        """session, dsr: by the hips, else by the extent of all points."""
        own = O.body_scale(self.wide).withColumnRenamed("dsr", "own")
        return O.fallback_scale(self.clean).join(own, "session", "left").select("session", F.coalesce("own", "dsr").alias("dsr"))

    @cached_property
    def pairs(self) -> DataFrame:
        names = self.nodes
        df = P.pairs(self.animals.drop("step"), ["x", "y", "xs", "ys", "vframe", "heading", "vx", "vy", "speed", "accel", "jerk", "av"]).join(self.scale, "session")
        d, closest = P.min_distance(names, tail_end_nodes(names))
        regions = {r: P.region_distance(a, b) for r, (a, b) in self.regions.items()}
        return stored(P.features(df).withColumns({"min_dist": d, "closest": closest, "vframe": F.col("A_vframe"), **regions}), "pairs")

    @cached_property
    def first_order(self) -> DataFrame:
        ears = (self.node("ear_l"), self.node("ear_r"))
        df = B.first_order(self.pairs, self.fps, len(self.nodes), self.node("nose"), self.rear, ears, self.node("body"), tail_end_nodes(self.nodes))
        return stored(B.engagement_speeds(df), "first-order")

    @cached_property
    def second_order(self) -> DataFrame:
        return stored(B.engagement_speeds(B.second_order(self.first_order, self.fps), "Disengaged", "Disengage"), "second-order")

    def bouts(self, flag: str) -> DataFrame:
        """Bouts of a pair's flag with initiator, disengager and the video time of their onset."""
        frames = self.second_order if flag not in self.first_order.columns else self.first_order
        found = T.with_initiators(runs.bouts(frames, flag, T.KEYS, "sidx"), frames, self.fps)
        return T.with_video_time(found, self.frame_map, self.fps)

    def pair_bins(self, seconds: float = 0.25) -> DataFrame:
        first = [f for f in ("NoseNose", "HH", "HO", "Contact", "Engaged", "Sniff_AtoB", "Sniff_BtoA")]
        return N.binned(self.second_order, list(T.KEYS), ["d", "opposition", "EngageSpeed_A", "EngageSpeed_B"], "vframe", self.fps, seconds, [*first, *B.SECOND_FLAGS])

    @cached_property
    def engagement_indices(self) -> DataFrame:
        """Indices of bouts at the resolution of bins, for the whole, minutes and minutes so far."""
        return T.binned_indices(self.first_order, "Engaged", F.col("vframe") / self.fps, self.fps)

    #: What bouts are described by: each animal's features and the pair's, with their columns.
    BY_ROLE = {
        "body_x": "x", "body_y": "y", "heading": "heading", "body_vx": "vx", "body_vy": "vy", "body_speed": "speed", "body_accel": "accel", "body_jerk": "jerk", "angular_motion": "av",
        "face_angle": "fe", "path_eff": "pe", "displacement": "disp", "approach_speed": "towards",
    }
    OF_PAIR = {
        "inter_dist": "d", "min_dist": "min_dist", "delta_heading": "opposition", "gap_dist": "gap", "cos_sim": "cos_sim", "speed_covar": "speed_cov", "speed_corr": "speed_corr",
        "Contact": "Contact", "visual_scope_A": "visual_AtoB", "visual_scope_B": "visual_BtoA",
    }

    @cached_property
    def bout_table(self) -> DataFrame:
        frames = self.second_order.withColumnsRenamed({f"{n}_{s}": f"{s}_{n}" for n in ("fe", "pe", "disp", "towards") for s in "AB"})
        return stored(T.class_table(frames, B.SECOND_FLAGS, self.BY_ROLE, self.OF_PAIR, self.fps), "bout-table")

    def forest(self, **how) -> dict[str, DataFrame]:
        """How well behaviours' bouts can be told apart; no tables without bouts."""
        return ml.validate_or_nothing(self.bout_table, T.class_features(list(self.BY_ROLE), list(self.OF_PAIR)), **how)

    FIRST_FLAGS = ("NoseNose", "HH", "HO", "Contact", "CoOriented", "AntiOriented", "Engaged", *[f"{n}_{d}" for n in ("NoseHead", "NoseBody", "NoseRear", "Sniff") for d in ("AtoB", "BtoA")])

    def wide_flags(self, order: int, tracks: list[int]) -> DataFrame:
        """One row a frame with a column for each behaviour of each of the tracks (order 1) and of their pairs, by name."""
        names = self.names if isinstance(self.names, (list, tuple)) else ()
        pairs = A.wide(self.first_order if order == 1 else self.second_order, ["session", "sidx"], A.pair_subjects(tracks, names), self.FIRST_FLAGS if order == 1 else B.SECOND_FLAGS)
        if order == 2:
            return pairs
        alone = A.wide(self.animals, ["session", "sidx"], A.animal_subjects(tracks, names), ("stationary", "walking", "running", "turning", "reversal"))
        return alone.join(pairs, ["session", "sidx"], "left")

    def earlier(self, gate_s: float = 5.0, swap: Column | None = None) -> dict[str, DataFrame]:
        """The earlier rules' tables. The lower track of each pair is the subject, or the higher where `swap`, a condition
        on session, tA and tB, holds. Lengths are by the subject's own scale (the session's, where it can't be told)."""
        roles = L.Roles(self.node("nose"), (self.node("ear_l"), self.node("ear_r")), self.node("body"), tuple(tail_end_nodes(self.nodes, middle=True)), (self.node("hip_l"), self.node("hip_r")))
        frames = self.pairs.select("session", "sidx", "tA", "tB", "A_xs", "A_ys", "B_xs", "B_ys", F.col("dsr").alias("_dsr"))
        frames = frames if swap is None else L.as_subject(frames, swap)
        frames = frames.join(L.subject_scale(frames, roles), list(L.KEYS), "left").withColumn("dsr", F.coalesce("dsr", "_dsr")).drop("_dsr", "cm_per_px")
        return L.output(L.detectors(frames, self.fps, len(self.nodes), gate_s, roles), self.fps, gate_s)

    def bins(self, seconds: float = 0.25) -> DataFrame:
        return N.binned(self.animals, ["session", "track"], ["x", "y", "speed", "accel", "jerk", "heading", "elongation"], "vframe", self.fps, seconds, ["stationary", "walking", "running", "turning"])

    @cached_property
    def metrics(self) -> DataFrame:
        parts = [M.locomotion(self.animals, self.px_per_cm), M.immobility(self.animals, self.fps), M.zone_times(self.animals, self.fps), M.contacts(self.pairs, {"All nodes": "min_dist", **{r: r for r in self.regions}}, self.fps, self.px_per_cm), M.angle_in_proximity(self.first_order, self.px_per_cm)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def makers(self) -> dict[str, Callable[[], DataFrame]]:
        """What makes each table, by output name; for sources.sinks.write_tables."""
        keys = ["session", "tA", "tB"]
        small = lambda df: df.drop(*[f"{s}_{a}s" for s in "AB" for a in "xy"], "xs", "ys")
        made = {
            "info": self.info, "tracking": lambda: self.kinematics, "animal_features": lambda: small(self.animals), "pair_features": lambda: small(self.pairs),
            "first_order": lambda: self.first_order.select("session", "sidx", "tA", "tB", *self.FIRST_FLAGS), "second_order": lambda: small(self.second_order),
            "behaviour_summary": lambda: T.summary(self.first_order, ["Engaged", "Contact", "HH", "HO"], keys, "sidx", self.fps),
            "zones": lambda: O.zone_summary(self.centres, "zone", self.fps), "entropy": lambda: O.position_entropy(self.centres, "x", "y", self.roi),
            "engagement": lambda: T.engagement(self.second_order, self.fps), "pair_bins_025": lambda: self.pair_bins(0.25), "pair_bins_1": lambda: N.rolled_up(self.pair_bins(0.25), keys),
            "engagement_indices": lambda: self.engagement_indices, "bout_table": lambda: self.bout_table, "bins_025": lambda: self.bins(0.25), "bins_1": lambda: N.rolled_up(self.bins(0.25), ["session", "track"]),
            "metrics": lambda: self.metrics, "per_second": lambda: M.per_second(self.pairs, self.fps, self.px_per_cm, list(self.regions)),
            "matrix": lambda: N.feature_matrix(self.animals, F.col("vframe") / self.fps, {"speed": "p95", "heading": "angle", "jerk": "abs", "path_efficiency": "range"}),
        }
        return {n: partial(self._named, make) for n, make in made.items()}

    def _named(self, make: Callable[[], DataFrame]) -> DataFrame:
        return make() if self.names is None else A.labelled(make(), self.names)

    def tables(self, wanted: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """The wanted tables (all) by output name. Stages that none of them needs are not worked out."""
        makers = self.makers()
        return {n: make() for n, make in makers.items() if wanted is None or n in set(wanted)}

    def info(self) -> DataFrame:
        """What the analysis was told, as keys and values."""
        told = {"fps": self.fps, "nodes": ", ".join(self.nodes), "roi": self.roi, "arena_cm": self.arena_cm, "px_per_cm": self.px_per_cm, "strip_cm": self.strip_cm, "trim_s": self.trim_s, "repair": self.repair}
        return sinks.session_info(self.pose.sparkSession, told)
