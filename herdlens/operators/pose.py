"""Animal-grain tables from node-grain pose: pose(session, sidx, track, node, x, y), one row a frame, animal and node."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.angles import bearing, wrap180
from . import windows as W

KEYS = ("session", "sidx", "track")


def series():
    return Window.partitionBy("session", "track").orderBy("sidx")


def node_series():
    return Window.partitionBy("session", "track", "node").orderBy("sidx")


def clean(pose: DataFrame) -> DataFrame:
    """NaN as null: comparisons and aggregates then skip missing points."""
    return pose.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("x", "y")})


def trim(pose: DataFrame, fps: float, seconds: float = 5.0) -> DataFrame:
    """Without the first rows (data rows, not video time); sidx starts again from 0."""
    k = int(seconds * fps)
    return pose.where(F.col("sidx") >= k).withColumn("sidx", F.col("sidx") - k)


def with_video_frames(pose: DataFrame, frame_map: DataFrame) -> DataFrame:
    """vframe of each data row; rows that no video frame maps to are left out. The map is not assumed to be small."""
    return pose.join(frame_map.select("session", "vframe", "sidx"), ["session", "sidx"])


def missing(pose: DataFrame) -> DataFrame:
    bad = lambda c: (F.col(c).isNull() | F.isnan(c)).cast("long")
    return pose.agg((F.sum(bad("x")) + F.sum(bad("y"))).alias("n_missing"), F.count("*").alias("n_points"))


def nodes_wide(pose: DataFrame, nodes: dict[str, int]) -> DataFrame:
    """session, sidx, track and {name}_x, {name}_y for the nodes named: one aggregate, no join for each node."""
    at = lambda c, i: F.max(F.when(F.col("node") == i, F.col(c)))
    return pose.groupBy(*KEYS).agg(*[at(c, i).alias(f"{name}_{c}") for name, i in nodes.items() for c in "xy"])


def node_arrays(pose: DataFrame, n_nodes: int) -> DataFrame:
    """session, sidx, track, xs, ys: arrays with one place a node."""
    at = lambda c, i: F.max(F.when(F.col("node") == i, F.col(c)))
    return pose.groupBy(*KEYS).agg(*[F.array(*[at(c, i) for i in range(n_nodes)]).alias(f"{c}s") for c in "xy"])


def shapes(pose: DataFrame) -> DataFrame:
    long, ecc = G.elongation(F.col("x"), F.col("y"))
    return pose.groupBy(*KEYS).agg(long.alias("elongation"), ecc.alias("eccentricity"))


def node_pairs(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """{a}_to_{b}_dist, _angle and _angular_motion of pairs of one animal's nodes."""
    out = {}
    for a, b in pairs:
        dx, dy = F.col(f"{b}_x") - F.col(f"{a}_x"), F.col(f"{b}_y") - F.col(f"{a}_y")
        out[f"{a}_to_{b}_dist"] = F.sqrt(dx * dx + dy * dy)
        out[f"{a}_to_{b}_angle"] = bearing(dx, dy)
    df = wide.withColumns(out)
    return df.withColumns({f"{a}_to_{b}_angular_motion": W.turn(F.col(f"{a}_to_{b}_angle"), series()) for a, b in pairs})


def kinematics(pose: DataFrame, fps: float, width: int = 3, poly: int = 3) -> DataFrame:
    """Velocity, acceleration and jerk of every node by Savitzky-Golay derivatives, with speed and heading."""
    width = max(width | 1, poly + 2 if (poly + 2) % 2 else poly + 3)
    for d, name in ((1, "v"), (2, "a"), (3, "j")):
        pose = pose.withColumns({f"{name}{c}": W.savgol(F.col(c), node_series(), width, poly, d, fps) for c in "xy"})
    size = lambda n: F.sqrt(F.col(f"{n}x") * F.col(f"{n}x") + F.col(f"{n}y") * F.col(f"{n}y"))
    return pose.withColumns({"speed": size("v"), "accel": size("a"), "jerk": size("j"), "heading": bearing(F.col("vx"), F.col("vy"))})


def smooth(pose: DataFrame, width: int = 5, poly: int = 2, median: int = 3) -> DataFrame:
    """Median filter, then Savitzky-Golay, of every node's coordinates."""
    pose = pose.withColumns({c: W.median_filter(F.col(c), node_series(), median) for c in "xy"})
    return pose.withColumns({c: W.savgol(F.col(c), node_series(), width, poly) for c in "xy"})


def body_heading(wide: DataFrame, tail: str = "body", head: str = "nose", least: float = 1.0, width: int = 15, poly: int = 3) -> DataFrame:
    """Smoothed direction of the body axis: frames where it is shorter than `least` are interpolated on sine and cosine."""
    dx, dy = F.col(f"{head}_x") - F.col(f"{tail}_x"), F.col(f"{head}_y") - F.col(f"{tail}_y")
    size = F.sqrt(dx * dx + dy * dy)
    good = F.coalesce(size >= least, F.lit(False))
    df = wide.withColumns({"_c": F.when(good, dx / size), "_s": F.when(good, dy / size)})
    df = df.withColumns({c: W.interpolate(F.col(c), F.col("sidx").cast("double"), series()) for c in ("_c", "_s")})
    df = df.withColumn("_h", F.coalesce(bearing(F.col("_c"), F.col("_s")), F.lit(0.0)))
    df = df.withColumn("_h", W.unwrap(F.col("_h"), series()))
    return df.withColumn("body_heading", wrap180(W.savgol(F.col("_h"), series(), width, poly))).drop("_c", "_s", "_h")


def angular_velocity(heading: Column, fps: float) -> Column:
    return W.turn(heading, series()) * fps


def locomotion(df: DataFrame, fps: float, px_per_cm: float, slow: float = 3.0, fast: float = 20.0) -> DataFrame:
    """stationary, walking, running from median-filtered speed (px/s in `speed`), turning and reversal from `av` (deg/s)."""
    width = max(3, round(0.1 * fps) | 1)
    df = df.withColumn("_v", W.median_filter(F.col("speed"), series(), width))
    low, high = slow * px_per_cm, fast * px_per_cm
    flags = {
        "stationary": F.col("_v") < low,
        "running": F.col("_v") > high,
        "walking": (F.col("_v") >= low) & (F.col("_v") <= high),
        "turning": F.abs("av") > 30.0,
        "reversal": W.reversal(F.col("av"), series()),
    }
    return df.withColumns({n: F.coalesce(c, F.lit(False)).cast("int") for n, c in flags.items()}).drop("_v")


def body_scale(wide: DataFrame, left: str = "hip_l", right: str = "hip_r", least: int = 3) -> DataFrame:
    """session, dsr: mean over animals of the median hip distance among its 20th to 80th percentiles; null if none has enough."""
    d = wide.select("session", "track", G.distance(F.col(f"{left}_x"), F.col(f"{left}_y"), F.col(f"{right}_x"), F.col(f"{right}_y")).alias("d")).where("d is not null")
    band = d.groupBy("session", "track").agg(F.percentile("d", F.array(F.lit(0.2), F.lit(0.8))).alias("b"), F.count("*").alias("n")).where(F.col("n") >= least)
    inside = d.join(band, ["session", "track"]).where(F.col("d").between(F.col("b")[0], F.col("b")[1]))
    return inside.groupBy("session", "track").agg(F.percentile("d", 0.5).alias("m")).groupBy("session").agg(F.avg("m").alias("dsr"))


def fallback_scale(pose: DataFrame) -> DataFrame:
    """session, dsr: a tenth of the diagonal of all points' bounding box, 50 without points."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(ok, F.col("x")), F.when(ok, F.col("y"))
    dx, dy = F.max(x) - F.min(x), F.max(y) - F.min(y)
    return pose.groupBy("session").agg(F.coalesce(0.1 * F.sqrt(dx * dx + dy * dy), F.lit(50.0)).alias("dsr"))


def position_entropy(df: DataFrame, x: str, y: str, roi, bins: int = 10) -> DataFrame:
    """session, track, entropy: Shannon entropy of a grid over the arena, 0 to 1; points on the far edges count, outside ones don't."""
    x0, y0, x1, y1 = roi
    cell = lambda c, a, b: F.least(F.lit(bins - 1), F.floor((F.col(c) - a) / (b - a) * bins).cast("int"))
    inside = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    counts = inside.groupBy("session", "track", cell(x, x0, x1).alias("i"), cell(y, y0, y1).alias("j")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("session", "track"))
    shares = counts.withColumn("p", F.col("n") / total)
    scale = F.log2(F.lit(float(bins * bins)))
    return shares.groupBy("session", "track").agg(F.round(-F.sum(F.col("p") * F.log2("p")) / scale, 4).alias("entropy"))


def zone_summary(df: DataFrame, zone: str, fps: float) -> DataFrame:
    """session, track, zone, frames, seconds, percent of all the animal's rows, in the zones' order; undetected rows aren't listed."""
    order = F.array_position(F.array(*[F.lit(z) for z in ("Open", "W1", "W2", "W3", "W4", "C1", "C2", "C3", "C4")]), F.col("zone"))
    counts = df.groupBy("session", "track", F.col(zone).alias("zone")).agg(F.count("*").alias("frames"))
    total = F.sum("frames").over(Window.partitionBy("session", "track"))
    return (
        counts.withColumn("percent", F.round(100.0 * F.col("frames") / total, 2))
        .where(F.col("zone") != "Undetected")
        .select("session", "track", "zone", "frames", F.round(F.col("frames") / fps, 3).alias("seconds"), "percent", order.cast("int").alias("zone_order"))
    )
