"""Earlier variants for one subject and one stranger: lagged thresholds, scores, interval manifests.

All lengths are in body lengths BL = 2 * dsr. Rows are frames (session, sidx, tA, tB); A is the subject.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import bearing, opposition
from ..functions.geometry import body_frame
from ..storage import discard, stored
from . import pairs as P
from . import runs as R
from . import windows as W
from .bouts import interval_join

KEYS = ("session", "tA", "tB")


@dataclass(frozen=True)
class Roles:
    """Which node of the arrays is which; tail: its middle and end, which nobody sniffs at (the base may be)."""

    nose: int = 0
    ears: tuple[int, int] = (1, 2)
    body: int = 3
    tail: tuple[int, ...] = (7,)
    hips: tuple[int, int] = (4, 5)


# Behaviours in order of precedence, with their scores.
SCORES = (
    ("flee", -10), ("chase", 8), ("activeAvoid", -7), ("sniff", 6), ("follow", 5), ("passiveAvoid", -4), ("approach", 3),
    ("disengage", -2), ("hh", 9), ("ho", 10), ("statProx", 2), ("orient", 2), ("prox", 1),
)


def lagged(x: Column, w, frames: int) -> Column:
    """Change since that many frames ago; 0 while there is none."""
    return x - F.coalesce(F.lag(x, frames).over(w), x)


def trailing_std(x: Column, w, frames: int) -> Column:
    """Population spread of the frames before this one."""
    return F.stddev_pop(x).over(w.rowsBetween(-frames, -1))


def gate(flag: Column, fps: float, seconds: float = 5.0) -> Column:
    """0 in the first seconds; the frames stay."""
    return F.when(F.col("sidx") < int(seconds * fps), 0).otherwise(flag)


def lags(fps: float) -> dict[str, int]:
    """Frames of the spans that the detectors look back over."""
    frames = lambda seconds, least=1: max(least, round(seconds * fps))
    return {"second": max(1, int(fps)), "half": frames(0.5), "still": frames(0.5, 2), "flight": frames(0.4), "recent": frames(0.75)}


def _flag(condition: Column, gate_frames: int) -> Column:
    return F.when(F.col("sidx") >= gate_frames, F.coalesce(condition, F.lit(False)).cast("int")).otherwise(0)


def _mean_of(*values: Column) -> Column:
    """Of those that are known."""
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known))


def _speed(x: Column, y: Column, w, frames: int) -> dict[str, Column]:
    """Velocity over a span, a frame; 0 while there is none."""
    vx, vy = lagged(x, w, frames) / frames, lagged(y, w, frames) / frames
    return {"vx": vx, "vy": vy, "speed": F.sqrt(vx * vx + vy * vy)}


def motion(df: DataFrame, fps: float, roles: Roles = Roles()) -> DataFrame:
    """Geometry and motion of subject A and stranger B that the detectors ask for; the node arrays stay.

    df: A_xs, A_ys, B_xs, B_ys and dsr. gap is from A's nose to B's body. Spans without a frame to look back to give 0.
    """
    c, w, n = F.col, Window.partitionBy(*KEYS).orderBy("sidx"), lags(fps)
    nose, ears, body = roles.nose, roles.ears, roles.body
    at = lambda s, a, k: F.get(c(f"{s}_{a}s"), F.lit(k))
    out = {}
    for s in "AB":
        for a in "xy":
            out |= {f"{s}_{a}": at(s, a, body), f"{s}_n{a}": at(s, a, nose), f"{s}_h{a}": _mean_of(at(s, a, nose), at(s, a, ears[0]), at(s, a, ears[1]))}
        out[f"ear_{s}"] = F.struct((at(s, "x", ears[1]) - at(s, "x", ears[0])).alias("x"), (at(s, "y", ears[1]) - at(s, "y", ears[0])).alias("y"))
    df = df.withColumns(out)
    df = df.withColumns({f"{s}_heading": bearing(c(f"{s}_nx") - c(f"{s}_x"), c(f"{s}_ny") - c(f"{s}_y")) for s in "AB"})
    d = lambda p, q: F.sqrt((c(f"{p}x") - c(f"{q}x")) ** 2 + (c(f"{p}y") - c(f"{q}y")) ** 2)
    face = lambda s, p, q: opposition(c(f"{s}_heading"), bearing(c(f"{q}x") - c(f"{p}x"), c(f"{q}y") - c(f"{p}y")))
    df = df.withColumns({"d": d("A_", "B_"), "gap": d("A_n", "B_"), "fe_A": face("A", "A_", "B_"), "opposition": opposition(c("A_heading"), c("B_heading"))})
    turned = lambda s: F.coalesce(opposition(c(f"{s}_heading"), F.lag(f"{s}_heading", n["second"]).over(w)), F.lit(0.0)) * (fps / n["second"])
    out = {f"gap_{k}": lagged(c("gap"), w, n[k]) for k in ("second", "half", "flight")}
    out["spread"] = F.when(F.row_number().over(w) > n["second"], trailing_std(c("gap"), w, n["second"])) if n["second"] > 3 else F.lit(None).cast("double")
    for s in "AB":
        out |= {f"{s}_lag_{k}": v for k, v in _speed(c(f"{s}_x"), c(f"{s}_y"), w, n["second"]).items()} | {f"{s}_{k}": v for k, v in _speed(c(f"{s}_x"), c(f"{s}_y"), w, 1).items()}
        out |= {f"{s}_turn": turned(s), f"{s}_disp": n["half"] * _speed(c(f"{s}_x"), c(f"{s}_y"), w, n["half"])["speed"]}
    out["A_still"] = n["still"] * _speed(c("A_x"), c("A_y"), w, n["still"])["speed"]
    df = df.withColumns(out)
    along, across = body_frame(c("A_x") - c("B_x"), c("A_y") - c("B_y"), c("B_heading"))
    towards = (c("A_vx") * (c("B_x") - c("A_x")) + c("A_vy") * (c("B_y") - c("A_y"))) / (c("d") + 1e-9)
    size = lambda s: F.sqrt(c(f"{s}_lag_vx") ** 2 + c(f"{s}_lag_vy") ** 2)
    cos = F.when((size("A") >= 1e-6) & (size("B") >= 1e-6), (c("A_lag_vx") * c("B_lag_vx") + c("A_lag_vy") * c("B_lag_vy")) / (size("A") * size("B"))).otherwise(0.0)
    return df.withColumns({"along": along, "across": across, "towards": towards, "cos_v": cos})


def cones(df: DataFrame) -> DataFrame:
    """vision (B, ML, MR, N) and hearing (B, ML, MR, R, N) of A within 10 dsr; the sides by the line of its ears.

    Vision asks for B's body, then its nose, and takes the better; hearing asks for the body.
    """
    c, reach = F.col, 10 * F.col("dsr")

    def seen(x: str, y: str):
        dx, dy = c(x) - c("A_x"), c(y) - c("A_y")
        side = F.when(c("ear_A.x") * dy - c("ear_A.y") * dx > 0, "ML").otherwise("MR")
        return F.sqrt(dx * dx + dy * dy) <= reach, opposition(c("A_heading"), bearing(dx, dy)), side

    (near, angle, side), (near2, angle2, side2) = seen("B_x", "B_y"), seen("B_nx", "B_ny")
    vision = F.when((near & (angle <= 20)) | (near2 & (angle2 <= 20)), "B").when(near & (angle <= 120), side).when(near2 & (angle2 <= 120), side2).otherwise("N")
    hearing = F.when(~near, "N").when(angle <= 60, "B").when(angle <= 150, side).otherwise("R")
    return df.withColumns({"vision": vision, "hearing": hearing})


def contacts(df: DataFrame, gate_frames: int, nodes: int, roles: Roles = Roles()) -> DataFrame:
    """prox, hh (heads together), ho (nose to nose, face to face), sniff (A's nose at B) and touching, any of the last three.

    A sniffs at B where the node closest to its nose is within half a body scale (0.7 for the body), and not in the
    middle or at the end of B's tail.
    """
    c, dsr = F.col, F.col("dsr")
    d = lambda p, q: F.sqrt((c(f"{p}x") - c(f"{q}x")) ** 2 + (c(f"{p}y") - c(f"{q}y")) ** 2)
    face = {s: opposition(c(f"{s}_heading"), bearing(c(f"{t}_nx") - c(f"{s}_nx"), c(f"{t}_ny") - c(f"{s}_ny"))) for s, t in (("A", "B"), ("B", "A"))}
    nose_at = lambda s, t, k: F.sqrt((c(f"{s}_nx") - F.get(c(f"{t}_xs"), F.lit(k))) ** 2 + (c(f"{s}_ny") - F.get(c(f"{t}_ys"), F.lit(k))) ** 2)
    at_head = F.least(*[nose_at(s, t, k) for s, t in (("A", "B"), ("B", "A")) for k in (roles.nose, *roles.ears)])
    hh = ((at_head <= 0.9 * dsr) | (d("A_h", "B_h") <= 0.85 * dsr)) & (face["A"] <= 70) & (face["B"] <= 70) & (c("opposition") >= 60)
    ho = (d("A_n", "B_n") <= 0.55 * dsr) & (face["A"] <= 45) & (face["B"] <= 45) & (c("opposition") >= 120)
    near = P.nearest_node("A", "B", roles.nose, list(range(nodes)))
    df = df.withColumn("_near", near)
    facing = opposition(c("A_heading"), bearing(c("_near.x") - c("A_nx"), c("_near.y") - c("A_ny"))) <= 90
    sniff = facing & ~c("_near.j").isin(list(roles.tail)) & (c("_near.d") <= F.when(c("_near.j") == roles.body, 0.7).otherwise(0.5) * dsr)
    df = df.withColumns({"prox": _flag(c("d") <= 3 * dsr, gate_frames), "hh": _flag(hh, gate_frames), "ho": _flag(ho, gate_frames), "sniff": _flag(sniff, gate_frames)}).drop("_near")
    return df.withColumn("touching", F.greatest("hh", "ho", "sniff"))


def _quantiles(df: DataFrame, gate_frames: int, wanted: dict[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """df with {name}_p{percent}: exact quantiles of columns over each series' frames from the gate on."""
    late = lambda column: F.when(F.col("sidx") >= gate_frames, F.col(column))
    per = df.groupBy(*KEYS).agg(*[F.percentile(late(column), F.array(*[F.lit(q) for q in qs])).alias(name) for name, (column, qs) in wanted.items()])
    return df.join(per.select(*KEYS, *[F.col(name)[i].alias(f"{name}_p{round(100 * q)}") for name, (_, qs) in wanted.items() for i, q in enumerate(qs)]), list(KEYS))


def _baselines(df: DataFrame, gate_frames: int, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with {name}_med and {name}_mad of columns over the frames from the gate on where a condition holds; over all of
    those if it never does. Two aggregates for all of them: deviations need the medians."""
    rows = df.where(F.col("sidx") >= gate_frames).select(*KEYS, *[x for n, (column, where) in wanted.items() for x in (F.col(column).alias(f"_v_{n}"), where.alias(f"_c_{n}"))])
    own = lambda n: F.percentile(F.when(F.col(f"_c_{n}"), F.col(f"_v_{n}")), 0.5)
    med = rows.groupBy(*KEYS).agg(*[x for n in wanted for x in (F.coalesce(own(n), F.percentile(f"_v_{n}", 0.5)).alias(f"{n}_med"), F.max(f"_c_{n}").alias(f"_any_{n}"))])
    off = lambda n: F.when(F.col(f"_c_{n}") | ~F.col(f"_any_{n}"), F.abs(F.col(f"_v_{n}") - F.col(f"{n}_med")))
    mad = rows.join(med, list(KEYS)).groupBy(*KEYS).agg(*[x for n in wanted for x in (F.percentile(off(n), 0.5).alias(f"{n}_mad"), F.first(f"{n}_med").alias(f"{n}_med"))])
    return df.join(mad, list(KEYS), "left").fillna(0.0, [f"{n}_{x}" for n in wanted for x in ("med", "mad")])


def detectors(df: DataFrame, fps: float, nodes: int, gate_s: float = 5.0, roles: Roles = Roles()) -> DataFrame:
    """All behaviours of A towards B by the earlier rules, as 0 or 1 and 0 before the gate, with vision and hearing.

    df: pair frames with A_xs, A_ys, B_xs, B_ys and dsr. Adds prox, hh, ho, sniff, follow, chase, activeAvoid,
    passiveAvoid, flee, approach, statProx, orient and disengage.
    """
    c, w, n, gate_ = F.col, Window.partitionBy(*KEYS).orderBy("sidx"), lags(fps), int(gate_s * fps)
    bl, dsr = 2 * c("dsr"), c("dsr")
    df = cones(contacts(motion(df, fps, roles), gate_, nodes, roles))
    motion_table = df = stored(df.drop(*[f"{s}_{a}s" for s in "AB" for a in "xy"], "ear_A", "ear_B"), "legacy-motion")
    df = _quantiles(df, gate_, {"A_lag": ("A_lag_speed", (0.35, 0.45, 0.7, 0.95)), "B_lag": ("B_lag_speed", (0.35, 0.95)), "A": ("A_speed", (0.35, 0.75, 0.95))})
    free = c("touching") == 0
    turning = lambda most: (c("A_turn") <= most) & (c("B_turn") <= most)
    behind = lambda back, side: (c("along") <= -back * bl) & (F.abs("across") <= side * bl)
    aligned = lambda heading, face, cos: (c("opposition") <= heading) & (c("fe_A") <= face) & (c("cos_v") >= cos)
    steady = lambda most: F.coalesce(c("spread") <= most * bl, F.lit(False))
    follow = (
        c("A_lag_speed").between(c("A_lag_p35"), c("A_lag_p95")) & c("B_lag_speed").between(c("B_lag_p35"), c("B_lag_p95")) & turning(120) & behind(0.2, 1.0) & aligned(55, 50, 0.65)
        & c("d").between(0.8 * bl, 3.5 * bl) & ((c("gap_second") < -0.15 * bl) | steady(0.25)) & free
    )
    df = df.withColumn("follow", _flag(follow, gate_))
    pursuit = ((c("gap_second") < -0.2 * bl) & (c("A_lag_speed") >= c("A_lag_p70"))) | (steady(0.3) & (c("A_lag_speed") >= 0.95 * c("B_lag_speed")) & (c("follow") == 1))
    chase = (c("A_lag_speed") >= c("A_lag_p45")) & (c("B_lag_speed") >= c("B_lag_p35")) & turning(140) & behind(0.15, 1.2) & aligned(50, 45, 0.7) & c("d").between(0.7 * bl, 3 * bl) & pursuit & free
    df = df.withColumn("chase", _flag(chase, gate_))
    social, pressed = (c("touching") == 1) | (c("prox") == 1), (c("touching") == 1) | (c("chase") == 1) | (c("follow") == 1) | (c("prox") == 1)
    df = df.withColumns({"recent": W.recently(social, w, n["recent"]), "pressed": W.recently(pressed, w, n["recent"])})
    middle = df.groupBy(*KEYS).agg(F.avg("A_x").alias("_mx"), F.avg("A_y").alias("_my"))
    df = df.join(middle, list(KEYS)).withColumn("_radius", F.sqrt((c("A_x") - c("_mx")) ** 2 + (c("A_y") - c("_my")) ** 2)).drop("_mx", "_my")
    df = _quantiles(df, 0, {"_r": ("_radius", (0.75,))})
    every = F.lit(True)
    df = stored(_baselines(df, gate_, {"calm": ("A_speed", ~social), "loose": ("A_speed", ~pressed), "A": ("A_speed", every), "B": ("B_speed", every)}), "legacy-baselines")
    discard(motion_table)
    away = -c("towards")
    shy = c("recent") & free & (c("fe_A") > 120)
    active = shy & (c("A_speed") > c("calm_med") + 1.5 * c("calm_mad")) & (away > 0.15 * bl) & (c("gap_half") > 0.2 * bl)
    df = df.withColumn("activeAvoid", _flag(active, gate_))
    passive = (
        shy & (c("activeAvoid") == 0) & (c("follow") == 0) & (c("A_speed") <= c("calm_med") + 0.25 * c("calm_mad")) & (c("A_still") <= 0.2 * bl) & (c("gap_half") >= -0.05 * bl)
        & ((c("d") <= 3 * bl) | (c("_radius") >= c("_r_p75")))
    )
    flee = c("pressed") & (c("d") <= 3.5 * bl) & (c("fe_A") > 130) & (c("A_speed") >= F.greatest(c("loose_med") + 2 * c("loose_mad"), c("A_p75"))) & (away > 0.2 * bl) & (c("gap_flight") > 0.3 * bl)
    df = df.withColumns({"passiveAvoid": _flag(passive, gate_), "flee": _flag(flee, gate_)})
    shuns, busy = (c("activeAvoid") == 1) | (c("passiveAvoid") == 1), (c("follow") == 1) | (c("chase") == 1)
    approach = (
        c("A_speed").between(c("A_p35"), c("A_p95")) & (c("fe_A") <= 55) & c("d").between(bl, 5 * bl) & (c("towards") > 0.12 * bl) & (c("gap_half") < -0.18 * bl) & free & ~busy & ~shuns & (c("flee") == 0)
        & (W.soon(social, w, n["half"]) | (c("d") <= 3.5 * bl))
    )
    still = lambda s: (c(f"{s}_speed") <= c(f"{s}_med") + 0.15 * c(f"{s}_mad")) & (c(f"{s}_disp") <= 0.2 * bl)
    together = ((c("prox") == 1) | (c("d") <= 2.5 * dsr)) & still("A") & still("B") & free & ~busy & ~shuns & (c("flee") == 0)
    df = df.withColumns({"approach": _flag(approach, gate_), "statProx": _flag(together, gate_)})
    joining = busy | (c("approach") == 1)
    orient = ((c("d") <= 5 * bl) | (c("prox") == 1)) & ~shuns & (c("flee") == 0) & ((c("fe_A") <= 45) | ((c("fe_A") <= 65) & (joining | (c("touching") == 1))))
    df = df.withColumn("orient", _flag(orient, gate_))
    engaged = joining | (c("orient") == 1) | (c("touching") == 1) | (c("prox") == 1)
    lately = W.recently(engaged, w, n["recent"])
    strong = shuns & (c("A_speed") > c("A_med") + 1.2 * c("A_mad")) & (away > 0.15 * bl)
    disengage = (
        lately & free & ~joining & (c("flee") == 0) & ~strong & ((c("fe_A") >= 95) | ((c("orient") == 0) & (c("fe_A") > 55)))
        & ((c("gap_half") > 0.05 * bl) | (c("A_speed") <= c("A_med") + 0.35 * c("A_mad")) | (away > 0.03 * bl))
    )
    return df.withColumn("disengage", _flag(disengage, gate_))


def filtered(df: DataFrame, flags: Sequence[str], keys: Sequence[str], fps: float) -> DataFrame:
    """Gaps of up to 0.33 s merged, then runs under 0.9 s dropped."""
    for f in flags:
        df = R.fill_gaps(df, f, keys, "sidx", round(0.3 * fps * 1.1))
        df = R.drop_short(df, f, keys, "sidx", round(fps * 0.9))
    return df


def social_score(flags: dict[str, Column], sensory: Column | None = None) -> Column:
    """The score of the strongest behaviour of a frame, first in order at a tie; sensory scores only where there is none."""
    order = sorted(SCORES, key=lambda s: -abs(s[1]))  # stable: ties keep their order
    out = None
    for name, score in order:
        if name in flags:
            out = F.when(flags[name] == 1, float(score)) if out is None else out.when(flags[name] == 1, float(score))
    return out.otherwise(F.coalesce(sensory, F.lit(0.0)) if sensory is not None else F.lit(0.0))


def intervals(df: DataFrame, flags: Sequence[str], keys: Sequence[str], fps: float) -> DataFrame:
    """behaviour, start_s, end_s (end exclusive) of each run, in the order of `flags`, then time, with ids B00001, ..."""
    out = None
    for rank, f in enumerate(flags):
        part = R.bouts(df, f, keys, "sidx").select(*keys, F.lit(rank).alias("_rank"), F.lit(f).alias("behaviour"), (F.col("start") / fps).alias("start_s"), ((F.col("end") + 1) / fps).alias("end_s"))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy(*keys).orderBy("_rank", "start_s")
    return out.withColumn("id", F.format_string("B%05d", F.row_number().over(w))).drop("_rank")


def total_seconds(df: DataFrame, flag: str, keys: Sequence[str], fps: float) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum((F.col(flag) >= 1).cast("int")) / fps).alias("seconds"))


def alternate_frames(df: DataFrame, flag: str, keys: Sequence[str]) -> DataFrame:
    """Near frames in twos, the first of each pair with the next: start, end. Not runs."""
    near = df.where(F.col(flag) == 1).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("sidx")) - 1)
    pair = near.groupBy(*keys, F.floor(F.col("_i") / 2).alias("clip")).agg(F.min("sidx").alias("start"), F.max("sidx").alias("end"), F.count("*").alias("n"))
    return pair.where("n = 2").drop("n")


#: What kinds of bouts are about: the subject's own point, and the point of the other that it comes to.
MODES = {"proximity": ("", ""), "sniff": ("n", "h"), "hh": ("h", "h"), "ho": ("n", "n"), "generic": ("n", "")}


def instigators(bouts: DataFrame, frames: DataFrame, fps: float, mode: str = "generic", before_s: float = 0.75) -> DataFrame:
    """bouts with instigator A, B or Shared, by the span before the onset.

    mode says which points count (MODES): bodies, nose to head, heads, noses, or nose to body. An animal's score is by
    how much its point has come closer to the other's (each at its own time), three quarters of its own way in the
    direction of where the other's was, a quarter of a body length for facing the other's point at the onset at up to 55
    degrees, and a tenth for having come closer at all. Shared if both score under 0.12 body lengths, if the lower has at
    least 85 % of the higher, if a place is missing, and if there are fewer than two frames before the onset.
    frames: A_x, A_y (body), A_nx, A_ny (nose), A_hx, A_hy (head), A_heading, the same for B, and dsr.
    """
    own, other = MODES[mode]
    back, names = max(2, round(before_s * fps)), [f"{k}{a}" for k in dict.fromkeys((own, other)) for a in "xy"]
    cols = [f"{s}_{n}" for s in "AB" for n in (*names, "heading")]
    last = frames.groupBy(*KEYS).agg(F.max("sidx").alias("_last"))
    at = lambda name: frames.select(*KEYS, F.col("sidx").alias(f"_{name}"), *[F.col(x).alias(f"{name}_{x}") for x in cols], *([F.col("dsr").alias("_dsr")] if name == "e" else []))
    rows = bouts.join(last, list(KEYS), "left").withColumn("_e", F.greatest(F.lit(1), F.least("start", "_last")))
    rows = rows.withColumn("_s", F.greatest(F.lit(0), F.col("_e") - back))
    rows = rows.join(at("e"), [*KEYS, "_e"], "left").join(at("s"), [*KEYS, "_s"], "left")
    c, bl, score = F.col, 2 * F.col("_dsr"), {}
    for s, t in (("A", "B"), ("B", "A")):
        to = {k: [c(f"{k}_{t}_{other}{a}") - c(f"{k}_{s}_{own}{a}") for a in "xy"] for k in "se"}
        far = {k: F.sqrt(x * x + y * y) for k, (x, y) in to.items()}
        way = [c(f"e_{s}_{own}{a}") - c(f"s_{s}_{own}{a}") for a in "xy"]
        closer = far["s"] - far["e"]
        along = F.when(far["s"] < 1e-9, 0.0).otherwise((way[0] * to["s"][0] + way[1] * to["s"][1]) / far["s"])
        facing = opposition(c(f"e_{s}_heading"), bearing(*to["e"])) <= 55
        score[s] = closer + 0.75 * along + F.when(facing, 0.25 * bl).otherwise(0.0) + F.when(closer > 0, 0.10 * bl).otherwise(0.0)
    a, b = score["A"], score["B"]
    low, high = F.least(a, b), F.greatest(a, b)
    shared = a.isNull() | b.isNull() | (c("_e") - c("_s") < 2) | ((a < 0.12 * bl) & (b < 0.12 * bl)) | ((high > 0) & (low / high >= 0.85)) | (a == b)
    return rows.withColumn("instigator", F.when(shared, "Shared").when(a > b, "A").otherwise("B")).select(*bouts.columns, "instigator")


def instigators_by_path(bouts: DataFrame, frames: DataFrame, fps: float, before_s: float = 1.0) -> DataFrame:
    """bouts with instigator A, B or Shared, by the frames of a second before the onset.

    The one whose nose came closer to the other's body by over 0.1 px more, and moved at over half the other's speed.
    Shared with fewer than two frames. frames: A_nx, A_ny, B_nx, B_ny (noses), A_x, A_y, B_x, B_y (bodies).
    """
    c, back = F.col, max(1, round(before_s * fps))
    w = Window.partitionBy(*KEYS).orderBy("sidx")
    reach = lambda s, t: F.sqrt((c(f"{s}_nx") - c(f"{t}_x")) ** 2 + (c(f"{s}_ny") - c(f"{t}_y")) ** 2)
    moved = frames.select(*KEYS, "sidx", *[reach(s, t).alias(f"_d{s}") for s, t in (("A", "B"), ("B", "A"))], *[W.step(c(f"{s}_nx"), c(f"{s}_ny"), w).alias(f"_v{s}") for s in "AB"])
    spans = bouts.select(*KEYS, "bout", F.greatest(F.lit(0), c("start") - back).alias("_s"), (c("start") - 1).alias("_e")).where("_e >= _s")
    later = lambda name: F.avg(F.when(c("sidx") > c("_s"), c(name)))
    per = interval_join(spans, moved, KEYS, "_s", "_e").groupBy(*KEYS, "bout").agg(
        F.count("*").alias("_n"), *[(F.max_by(f"_d{s}", "sidx") - F.min_by(f"_d{s}", "sidx")).alias(f"_g{s}") for s in "AB"], *[later(f"_v{s}").alias(f"_m{s}") for s in "AB"]
    )
    came = lambda s, t: (c(f"_g{s}") < c(f"_g{t}") - 0.1) & (c(f"_m{s}") > 0.5 * c(f"_m{t}")) & (c("_n") >= 2)
    return bouts.join(per, [*KEYS, "bout"], "left").withColumn("instigator", F.when(came("A", "B"), "A").when(came("B", "A"), "B").otherwise("Shared")).select(*bouts.columns, "instigator")


def identities(df: DataFrame, columns: Sequence[str], penalty: float) -> DataFrame:
    """df with A_ and B_ columns swapped back where two animals' tracks change places, and `swapped`.

    A frame changes places if swapping makes both move less by more than `penalty`; an odd number of changes so far
    means swapped. (The least total cost over all ways to swap is found frame by frame, as a change costs the same in
    either state.) df: A_x, A_y, B_x, B_y. A change into or out of missing places isn't seen. The earlier rules compared
    a cost with itself and so never swapped: penalty infinity.
    """
    w, c = Window.partitionBy(*KEYS).orderBy("sidx"), F.col
    p = lambda n: F.lag(n).over(w)
    d = lambda a, b: F.sqrt((c(f"{a}_x") - p(f"{b}_x")) ** 2 + (c(f"{a}_y") - p(f"{b}_y")) ** 2)
    change = F.coalesce(d("A", "A") + d("B", "B") - d("A", "B") - d("B", "A") > penalty, F.lit(False)).cast("int")
    df = df.withColumn("_change", change).withColumn("swapped", (F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2).cast("int")).drop("_change")
    pick = lambda own, other: F.when(c("swapped") == 1, c(other)).otherwise(c(own))
    return df.withColumns({f"A_{n}": pick(f"A_{n}", f"B_{n}") for n in columns} | {f"B_{n}": pick(f"B_{n}", f"A_{n}") for n in columns})


def summary(df: DataFrame, flag: str, fps: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, total_s, n_bouts, durations (array, in order of time) of a flag's runs; a run ends at the frame after its
    last, but the series' last frame ends it too."""
    last = df.groupBy(*keys).agg(F.max("sidx").alias("_last"))
    found = R.bouts(df, flag, keys, "sidx").join(last, list(keys)).select(*keys, "start", ((F.least(F.col("end") + 1, F.col("_last")) - F.col("start")) / fps).alias("s"))
    return found.groupBy(*keys).agg(F.round(F.sum("s"), 4).alias("total_s"), F.count("*").alias("n_bouts"), F.transform(F.array_sort(F.collect_list(F.struct("start", "s"))), lambda r: F.round(r["s"], 4)).alias("durations"))


def padded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, row, {behaviour}: each behaviour's intervals one under the other, shorter lists with nulls. df: what intervals returns."""
    text = F.format_string("%.2f-%.2f", F.col("start_s"), F.col("end_s"))
    row = F.row_number().over(Window.partitionBy(*keys, "behaviour").orderBy("start_s"))
    return df.select(*keys, "behaviour", row.alias("row"), text.alias("span")).groupBy(*keys, "row").pivot("behaviour").agg(F.first("span"))


#: Columns of the earlier output, in its order.
MATRIX = ("approach", "follow", "chase", "sniff", "hh", "ho", "activeAvoid", "passiveAvoid", "flee", "disengage", "statProx", "orient", "prox")
SENSES = {"hearing": (("binaural", ("B",)), ("monaural", ("ML", "MR")), ("rear", ("R",))), "vision": (("binocular", ("B",)), ("monocular", ("ML", "MR")), ("no_vision", ("N",)))}


def output(found: DataFrame, fps: float, gate_s: float = 5.0) -> dict[str, DataFrame]:
    """The earlier output's sections as tables, by pair: metadata, times (totals of each behaviour and sense), intervals
    (with instigators of nearness, sniffing and heads) and matrix (filtered flags by frame). found: what detectors
    returns."""
    found = stored(found, "legacy-found")
    senses = {n: F.col(c).isin(*labels) & (F.col("sidx") >= int(gate_s * fps)) for c, kinds in SENSES.items() for n, labels in kinds}
    rows = found.withColumns({n: v.cast("int") for n, v in senses.items()})
    flags = [*MATRIX, *senses]
    matrix = stored(filtered(rows.select(*KEYS, "sidx", *flags), MATRIX, KEYS, fps), "legacy-matrix")
    sizes = found.groupBy(*KEYS).agg(F.max("dsr").alias("dsr"), F.count("*").alias("all"), F.sum((F.col("sidx") >= int(gate_s * fps)).cast("int")).alias("late"))
    named = {"duration_s": F.col("all") / fps, "frames": F.col("all"), "duration_after_gate_s": F.col("late") / fps, "frames_after_gate": F.col("late"), "dsr_px": F.col("dsr"), "cm_per_px": 3.0 / F.col("dsr")}
    metadata = sizes.withColumn("r", F.explode(F.array(*[F.struct(F.lit(n).alias("key"), v.cast("double").alias("value")) for n, v in named.items()])))
    times = F.array(*[F.struct(F.lit(n).alias("behaviour"), F.round(F.sum(n) / fps, 4).alias("seconds")) for n in flags])
    starts = None
    for n in ("prox", "sniff", "hh", "ho"):
        part = instigators(R.bouts(matrix, n, KEYS, "sidx"), found, fps, "proximity" if n == "prox" else n).select(*KEYS, F.lit(n).alias("behaviour"), (F.col("start") / fps).alias("start_s"), "instigator")
        starts = part if starts is None else starts.unionByName(part)
    spans = intervals(matrix, MATRIX, KEYS, fps).withColumn("duration_s", F.round(F.col("end_s") - F.col("start_s"), 4))
    return {
        "metadata": metadata.select(*KEYS, "r.*"),
        "times": matrix.groupBy(*KEYS).agg(times.alias("t")).select(*KEYS, F.explode("t").alias("r")).select(*KEYS, "r.*"),
        "intervals": spans.join(starts, [*KEYS, "behaviour", "start_s"], "left"),
        "matrix": matrix.select(*KEYS, "sidx", *flags),
    }


def as_subject(frames: DataFrame, swap: Column) -> DataFrame:
    """frames with A and B, their tracks and all their columns changed over where `swap` holds: A is the subject.

    swap: a condition on session, tA and tB (which animal of a pair is the subject is the user's to say).
    """
    ours = [n[2:] for n in frames.columns if n.startswith("A_")]
    pick = lambda own, other: F.when(swap, F.col(other)).otherwise(F.col(own))
    new = {f"{s}_{n}": pick(f"{s}_{n}", f"{t}_{n}") for n in ours for s, t in ("AB", "BA")}
    return frames.withColumns(new | {"tA": pick("tA", "tB"), "tB": pick("tB", "tA")})


def subject_scale(frames: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """session, tA, tB, dsr, cm_per_px: the median of A's own hip distances from their 20th to their 80th percentile.

    Null for a subject that lacks a hip in any frame: missing ones aren't left out. cm_per_px takes a body to be 3 cm
    wide. frames: A_xs, A_ys.
    """
    hip = [F.get(f"A_{a}s", F.lit(k)) for k in roles.hips for a in "xy"]
    d = frames.select(*KEYS, F.sqrt((hip[0] - hip[2]) ** 2 + (hip[1] - hip[3]) ** 2).alias("_d"))
    band = d.groupBy(*KEYS).agg(F.percentile("_d", F.array(F.lit(0.2), F.lit(0.8))).alias("_b"), F.count_if(F.col("_d").isNull()).alias("_gone"))
    inside = d.join(band, list(KEYS)).groupBy(*KEYS).agg(F.percentile(F.when(F.col("_d").between(F.col("_b")[0], F.col("_b")[1]), F.col("_d")), 0.5).alias("dsr"), F.max("_gone").alias("_gone"))
    return inside.select(*KEYS, F.when(F.col("_gone") == 0, F.col("dsr")).alias("dsr")).withColumn("cm_per_px", 3.0 / F.col("dsr"))


def nose_angle(frames: DataFrame, fps: float, gate_s: float = 5.0, roles: Roles = Roles()) -> DataFrame:
    """session, sidx, tA, tB, nose_angle: direction from A's body to its nose, of the frames from the gate on."""
    at = lambda a, k: F.get(f"A_{a}s", F.lit(k))
    angle = bearing(at("x", roles.nose) - at("x", roles.body), at("y", roles.nose) - at("y", roles.body))
    return frames.where(F.col("sidx") >= int(gate_s * fps)).select("session", "sidx", "tA", "tB", angle.alias("nose_angle"))
