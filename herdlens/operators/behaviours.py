"""Behaviours of a pair: first-order ones from geometry, second-order ones from session statistics on top of them.

Rows are pair frames (session, sidx, tA < tB). Columns with A_ and B_ are each animal's; directed behaviours come as
{name}_AtoB and {name}_BtoA. All lengths are in units of `dsr`, the body scale, a column. Flags are 0 or 1; a missing
value makes a condition false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.angles import bearing, opposition
from ..storage import discard, stored
from . import pairs as P
from . import runs as R
from . import windows as W

SERIES_KEYS = ("session", "tA", "tB")
DIRECTIONS = (("A", "B"), ("B", "A"))
#: What second_order adds.
SECOND_FLAGS = (*[f"{n}_{d}" for n in ("Follow", "Chase", "Flee", "Approach", "ActiveAvoid", "PassiveAvoid", "SocialOrient", "VisualAttn", "AuditoryAttn") for d in ("AtoB", "BtoA")], "StationaryProx", "Disengaged")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _filled(df: DataFrame, names, fps: float, seconds: float, least: int = 1) -> DataFrame:
    for n in names:
        df = R.fill_gaps(df, n, SERIES_KEYS, "sidx", max(least, round(seconds * fps)))
    return df


def first_order(df: DataFrame, fps: float, n_nodes: int, nose: int = 0, rear: int = 6, ears: tuple[int, int] = (1, 2), body: int = 3, tail_ends=(7,)) -> DataFrame:
    """Node contacts, head-to-head, head orienting, sniffing, contact, relative positions, engagement.

    df: A_xs, A_ys, B_xs, B_ys (arrays by node), A_heading, B_heading, dsr.
    """
    c = F.col
    at = lambda s, k: (F.get(c(f"{s}_xs"), F.lit(k)), F.get(c(f"{s}_ys"), F.lit(k)))
    eligible = [i for i in range(n_nodes) if i not in tail_ends]
    df = df.withColumns({f"{s}_{a}": F.get(c(f"{s}_{a}s"), F.lit(body)) for s in "AB" for a in "xy"})
    df = df.withColumns({f"{s}_head_{a}": (F.get(c(f"{s}_{a}s"), F.lit(ears[0])) + F.get(c(f"{s}_{a}s"), F.lit(ears[1]))) / 2 for s in "AB" for a in "xy"})
    df = df.withColumns({f"fe_{s}": opposition(c(f"{s}_heading"), bearing(c(f"{t}_x") - c(f"{s}_x"), c(f"{t}_y") - c(f"{s}_y"))) for s, t in DIRECTIONS})
    df = df.withColumns({f"near_{s}": P.nearest_node(s, t, nose, eligible) for s, t in DIRECTIONS})
    d = lambda p, q: G.distance(*p, *q)
    head = lambda s: (c(f"{s}_head_x"), c(f"{s}_head_y"))
    df = df.withColumns(
        {
            "d": d((c("A_x"), c("A_y")), (c("B_x"), c("B_y"))),
            "nose_nose": d(at("A", nose), at("B", nose)),
            "head_head": d(head("A"), head("B")),
            "opposition": opposition(c("A_heading"), c("B_heading")),
            "contact_dist": P.contact_distance(),
            **{f"nose_head_{s}": d(at(s, nose), head(t)) for s, t in DIRECTIONS},
            **{f"nose_body_{s}": d(at(s, nose), (c(f"{t}_x"), c(f"{t}_y"))) for s, t in DIRECTIONS},
            **{f"nose_rear_{s}": d(at(s, nose), at(t, rear)) for s, t in DIRECTIONS},
        }
    )
    dsr = c("dsr")
    both_face = lambda deg: (c("fe_A") < deg) & (c("fe_B") < deg)
    flags = {
        "NoseNose": c("nose_nose") < 0.5 * dsr,
        "HH": ((c("head_head") < 0.85 * dsr) | (F.least("nose_head_A", "nose_head_B") < 0.9 * dsr)) & both_face(70) & (c("opposition") > 60),
        "HO": (c("nose_nose") < 0.55 * dsr) & both_face(45) & (c("opposition") > 120),
        "Contact": c("contact_dist") < 0.25 * dsr,
        "CoOriented": c("opposition") < 30,
        "AntiOriented": c("opposition") > 150,
        "Engaged": (c("d") < 3 * dsr) & both_face(60),
    }
    for s, t in DIRECTIONS:
        to_near = opposition(c(f"{s}_heading"), bearing(c(f"near_{s}")["x"] - c(f"{s}_x"), c(f"near_{s}")["y"] - c(f"{s}_y")))
        flags |= {
            f"NoseHead_{s}to{t}": c(f"nose_head_{s}") < 0.7 * dsr,
            f"NoseBody_{s}to{t}": c(f"nose_body_{s}") < 0.7 * dsr,
            f"NoseRear_{s}to{t}": c(f"nose_rear_{s}") < 0.7 * dsr,
            f"Sniff_{s}to{t}": (c(f"near_{s}")["d"] < 0.7 * dsr) & (to_near < 90),
        }
    relative = {}
    for s, t in DIRECTIONS:
        relative[f"RelPos_{s}"] = G.relative_position(*G.body_frame(c(f"{t}_x") - c(f"{s}_x"), c(f"{t}_y") - c(f"{s}_y"), c(f"{s}_heading")))
    df = df.withColumns({n: flag(f) for n, f in flags.items()} | relative)
    df = _filled(df, ("HH", "HO"), fps, 0.1)
    df = _filled(df, ("Sniff_AtoB", "Sniff_BtoA"), fps, 0.07)
    return _filled(df, ("Engaged",), fps, 0.3)


def engagement_speeds(df: DataFrame, flag_name: str = "Engaged", prefix: str = "Engage") -> DataFrame:
    """{prefix}Speed_A and _B: each animal's distance moved in the frame while the flag is set; {prefix}OnsetSpeed_A and
    _B: the same at the flag's onsets only. df: A_x, A_y, B_x, B_y and the flag."""
    w, c = P.series(), F.col
    df = df.withColumns({f"_step_{s}": W.step(c(f"{s}_x"), c(f"{s}_y"), w) for s in "AB"}).withColumn("_onset", R.onsets(c(flag_name), w))
    speeds = {f"{prefix}Speed_{s}": R.masked(c(flag_name), c(f"_step_{s}")) for s in "AB"} | {f"{prefix}OnsetSpeed_{s}": F.when(c("_onset"), c(f"_step_{s}")) for s in "AB"}
    return df.withColumns(speeds).drop("_step_A", "_step_B", "_onset")


def _then(df: DataFrame, name: str, last: DataFrame) -> DataFrame:
    """df, stored; what it was made from is discarded."""
    out = stored(df, name)
    discard(last)
    return out


def session_statistics(df: DataFrame) -> DataFrame:
    """session, tA, tB and for A and B: p35, p70, p75, p95 of active speed, median and MAD of speed and acceleration.

    Two aggregates for both animals together (the deviations need the medians), joined back: percentiles are exact and no
    series is in one window.
    """
    c = F.col
    first = [
        a for s in "AB" for a in (
            F.percentile(f"{s}_speed", F.array(F.lit(0.1), F.lit(0.5))).alias(f"{s}_v"), F.percentile(f"{s}_accel", F.array(F.lit(0.5), F.lit(0.8))).alias(f"{s}_a"),
            F.percentile(f"{s}_jerk", F.array(F.lit(0.5), F.lit(0.9))).alias(f"{s}_j"),
        )
    ]
    floor = df.groupBy(*SERIES_KEYS).agg(*first)
    joined = df.select(*SERIES_KEYS, *[f"{s}_{n}" for s in "AB" for n in ("speed", "accel")]).join(floor, list(SERIES_KEYS))
    shares = F.array(*[F.lit(p) for p in (0.35, 0.7, 0.75, 0.95)])
    rest = []
    for s in "AB":
        active = F.when(c(f"{s}_speed") > c(f"{s}_v")[0], c(f"{s}_speed"))
        rest += [
            F.coalesce(F.percentile(active, shares), F.percentile(f"{s}_speed", shares)).alias(f"{s}_p"),
            F.percentile(F.abs(c(f"{s}_speed") - c(f"{s}_v")[1]), 0.5).alias(f"{s}_mad"), F.percentile(F.abs(c(f"{s}_accel") - c(f"{s}_a")[0]), 0.5).alias(f"{s}_acc_mad"),
            *[F.first(f"{s}_{n}").alias(f"{s}_{n}") for n in "vaj"],
        ]
    out = [
        x for s in "AB" for x in (
            c(f"{s}_v")[1].alias(f"{s}_med"), f"{s}_mad", f"{s}_acc_mad", *[c(f"{s}_p")[i].alias(f"{s}_{n}") for i, n in enumerate(("p35", "p70", "p75", "p95"))],
            c(f"{s}_a")[0].alias(f"{s}_acc_med"), c(f"{s}_a")[1].alias(f"{s}_acc_p80"), c(f"{s}_j")[0].alias(f"{s}_jerk_med"), c(f"{s}_j")[1].alias(f"{s}_jerk_p90"),
        )
    ]
    return joined.groupBy(*SERIES_KEYS).agg(*rest).select(*SERIES_KEYS, *out)


def second_order(df: DataFrame, fps: float, stats: DataFrame | None = None, gap_lag_s: float | None = None) -> DataFrame:
    """Follow, chase, flee, approach, avoidance, stationary proximity, orienting, disengagement, attention.

    df: what first_order returns, with A_speed, A_accel, A_jerk, A_vx, A_vy, A_av and those of B. By default the change
    of distance is over one frame; gap_lag_s takes it over that span. Steps are stored and discarded when the next is.
    """
    c, dsr, w = F.col, F.col("dsr"), P.series()
    # the plan so far is long; statistics and detectors read it more than once, so it is worked out here
    last = df = stored(df.drop(*[f"{s}_{a}s" for s in "AB" for a in "xy"], "near_A", "near_B"), "pair-frames")
    df = df.join(stats if stats is not None else session_statistics(df), list(SERIES_KEYS))
    half, short = max(1, round(0.25 * fps)), max(2, round(0.3 * fps))
    recent = max(1, round(0.75 * fps))
    change = W.gap_change(c("d"), w) if gap_lag_s is None else c("d") - F.coalesce(F.lag("d", max(1, round(gap_lag_s * fps))).over(w), c("d"))
    df = df.withColumns({"gap": change, "gap_std": W.rolling_std(c("d"), w, short), **{f"step_{s}": W.step(c(f"{s}_x"), c(f"{s}_y"), w) for s in "AB"}})
    df = df.withColumns({f"pe_{s}": W.centred_path_efficiency(c(f"step_{s}"), c(f"{s}_x"), c(f"{s}_y"), w, half) for s in "AB"} | {f"disp_{s}": W.window_displacement(c(f"{s}_x"), c(f"{s}_y"), w, half) for s in "AB"})
    extra = {"cos_v": G.cosine(c("A_vx"), c("A_vy"), c("B_vx"), c("B_vy")), "touching": flag((c("Contact") == 1) | (c("Sniff_AtoB") == 1) | (c("Sniff_BtoA") == 1) | (c("HH") == 1) | (c("HO") == 1))}
    for s, t in DIRECTIONS:
        dx, dy = c(f"{t}_x") - c(f"{s}_x"), c(f"{t}_y") - c(f"{s}_y")
        # where the subject stands, seen from its target
        along, across = G.body_frame(-dx, -dy, c(f"{t}_heading"))
        extra |= {f"along_{s}": along, f"across_{s}": across, f"towards_{s}": G.approach(dx, dy, c(f"{s}_vx"), c(f"{s}_vy")), f"away_{s}": G.retreat(dx, dy, c(f"{s}_vx"), c(f"{s}_vy"))}
    df = df.withColumns(extra)
    last = df = _then(df, "pair-motion", last)
    # what counts as social for flight and avoidance, and for disengagement
    close = ("Engaged", "Contact", "NoseNose", "NoseHead_AtoB", "NoseHead_BtoA", "HH", "HO", "Sniff_AtoB", "Sniff_BtoA")
    closer = (*close, "NoseBody_AtoB", "NoseBody_BtoA", "NoseRear_AtoB", "NoseRear_BtoA")
    df = df.withColumn("social", F.greatest(*[c(n) for n in closer])).withColumn("recent", W.recently(c("social"), w, recent).cast("int"))

    free, span = c("touching") == 0, lambda seconds: max(1, round(seconds * fps))

    def detect(*behaviours):
        """(name, condition, gap in seconds, what the first frames must show) of behaviours that don't ask for each other."""
        nonlocal df, last
        flags = {f"{name}_{s}to{t}": (condition(s, t, f"{s}to{t}"), span(gap), passes(s) if passes else None) for name, condition, gap, passes in behaviours for s, t in DIRECTIONS}
        last = df = _then(R.gates(df, flags, SERIES_KEYS, "sidx"), "detected", last)

    follow = lambda s, t, st: (
        c("d").between(0.8 * dsr, 3.5 * dsr) & ((c("gap") < -0.15 * dsr) | (c("gap_std") < 0.25 * dsr)) & (c(f"along_{s}") < -0.2 * dsr) & (F.abs(f"across_{s}") < dsr)
        & (c("opposition") < 55) & (c(f"fe_{s}") < 50) & (c("cos_v") > 0.65) & (c(f"{s}_speed") > c(f"{s}_p35")) & (c(f"{t}_speed") > c(f"{s}_p35")) & (F.abs(f"{s}_av") < 120) & free & (c(f"pe_{s}") > 0.5)
    )
    chase = lambda s, t, st: (
        c("d").between(0.7 * dsr, 3.0 * dsr) & ((c("gap") < -0.2 * dsr) | (c("gap_std") < 0.3 * dsr)) & (c(f"along_{s}") < -0.15 * dsr) & (F.abs(f"across_{s}") < 1.2 * dsr)
        & (c("opposition") < 50) & (c(f"fe_{s}") < 45) & (c("cos_v") > 0.7) & (c(f"{s}_speed") > 0.95 * c(f"{t}_speed")) & (c(f"{s}_speed") > c(f"{s}_p70")) & (F.abs(f"{s}_av") < 140)
        & (c(f"Follow_{st}") == 0) & (c(f"pe_{s}") > 0.7)
    )
    flee = lambda s, t, st: (
        (c("gap") > 0.3 * dsr) & (c(f"fe_{s}") > 130) & (c(f"{s}_speed") > F.greatest(c(f"{s}_med") + 2 * c(f"{s}_mad"), c(f"{s}_p75"))) & (c(f"away_{s}") > 0.2 * dsr) & (c("d") < 3.5 * dsr) & (c("recent") == 1)
    )
    approach = lambda s, t, st: (
        c("d").between(dsr, 5 * dsr) & (c("gap") < -0.18 * dsr) & (c(f"fe_{s}") < 55) & (c(f"towards_{s}") > 0.12 * dsr) & c(f"{s}_speed").between(c(f"{s}_p35"), c(f"{s}_p95"))
        & (c("Contact") == 0) & (c(f"Follow_{st}") == 0) & (c(f"Chase_{st}") == 0) & (c(f"Flee_{st}") == 0) & (c(f"pe_{s}") > 0.6)
    )
    active_avoid = lambda s, t, st: (
        (c("gap") > 0.2 * dsr) & (c(f"fe_{s}") > 120) & (c(f"{s}_speed") > c(f"{s}_med") + 1.5 * c(f"{s}_mad")) & (c(f"away_{s}") > 0.15 * dsr) & (c("d") < 4 * dsr) & (c("recent") == 1) & (c("Contact") == 0) & (c(f"Flee_{st}") == 0)
    )
    passive_avoid = lambda s, t, st: (
        (c(f"fe_{s}") > 120) & (c(f"disp_{s}") < 0.2 * dsr) & (c(f"{s}_speed") < c(f"{s}_med") + 0.25 * c(f"{s}_mad")) & (c("gap") > -0.05 * dsr) & (c("d") < 3 * dsr) & (c("recent") == 1) & (c(f"{s}_accel") < c(f"{s}_acc_med"))
    )
    detect(
        ("Follow", follow, 0.15, lambda s: c(f"{s}_speed") > c(f"{s}_med")),
        ("Flee", flee, 0.1, lambda s: (c(f"{s}_jerk") > c(f"{s}_jerk_p90")) | (c(f"{s}_accel") > c(f"{s}_acc_p80"))),
        ("PassiveAvoid", passive_avoid, 0.15, None),
    )
    detect(
        ("Chase", chase, 0.1, lambda s: c(f"{s}_accel") >= c(f"{s}_acc_med") + c(f"{s}_acc_mad")),
        ("ActiveAvoid", active_avoid, 0.1, lambda s: c(f"{s}_accel") > c(f"{s}_acc_med")),
    )
    detect(("Approach", approach, 0.1, lambda s: c(f"towards_{s}") > 0.05 * dsr))
    none = lambda *names: sum((c(f"{n}_{s}to{t}") for n in names for s, t in DIRECTIONS), F.lit(0)) == 0
    still = lambda s: (c(f"{s}_speed") < c(f"{s}_med") + 0.15 * c(f"{s}_mad")) & (c(f"disp_{s}") < 0.2 * dsr) & (c(f"{s}_accel") < c(f"{s}_acc_med")) & (c(f"{s}_jerk") < c(f"{s}_jerk_med") + c(f"{s}_mad"))
    df = df.withColumn("StationaryProx", flag(still("A") & still("B") & (c("d") < 2.5 * dsr) & (c("Contact") == 0) & none("Follow", "Chase", "ActiveAvoid", "Flee")))
    df = _filled(df, ("StationaryProx",), fps, 0.2)
    df = df.withColumns({f"SocialOrient_{s}to{t}": flag((c(f"fe_{s}") < F.when(c(f"{s}_speed") > c(f"{s}_p35"), 65).otherwise(45)) & (c("d") < 5 * dsr) & (c(f"Flee_{s}to{t}") == 0) & (c(f"ActiveAvoid_{s}to{t}") == 0)) for s, t in DIRECTIONS})
    active = flag((c("Contact") == 1) | (c("Sniff_AtoB") == 1) | (c("Sniff_BtoA") == 1) | ~none("Follow", "Chase", "Approach"))
    later = [f"{n}_{s}to{t}" for n in ("Approach", "Follow", "Chase", "SocialOrient") for s, t in DIRECTIONS]
    df = df.withColumn("active", active).withColumn("was_social", W.recently(F.greatest(*[c(n) for n in (*close, *later)]), w, recent))
    slow = lambda s: c(f"{s}_speed") < c(f"{s}_med") + 0.5 * c(f"{s}_mad")
    steady = lambda s: c(f"{s}_accel") < c(f"{s}_acc_med") + 1.5 * c(f"{s}_acc_mad")
    df = df.withColumn(
        "Disengaged",
        flag(
            c("was_social") & ((c("fe_A") > 95) | (c("fe_B") > 95)) & none("Flee") & (c("active") == 0)
            & ((c("gap") > 0.05 * dsr) | (slow("A") & slow("B")) | (c("away_A") > 0.03 * dsr) | (c("away_B") > 0.03 * dsr)) & (c("d") < 4 * dsr) & (steady("A") | steady("B"))
        ),
    )
    df = _filled(df, ("Disengaged",), fps, 0.15)
    return df.withColumns({f"{n}_{s}to{t}": flag(c(f"fe_{s}") < deg) for n, deg in (("VisualAttn", 120), ("AuditoryAttn", 150)) for s, t in DIRECTIONS})
