"""Repair of trajectories: speed and drift outliers, gap filling in three tiers.

Outliers are masked with window functions, in rounds until none is left. Gaps are filled a series (session, track, node)
at a time in applyInPandas, as the smoother runs forward and back; a series is bounded by its session. NumPy only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import windows as W

SIGMA = 1.4826
SERIES = ("session", "track", "node")


def _limits(df: DataFrame, value: str, k: float) -> DataFrame:
    """SERIES, mid and limit: the median of a column and that plus k robust deviations. Two aggregates."""
    mid = df.groupBy(*SERIES).agg(F.percentile(value, 0.5).alias("mid"))
    off = df.join(mid, list(SERIES)).groupBy(*SERIES).agg(F.first("mid").alias("mid"), F.percentile(F.abs(F.col(value) - F.col("mid")), 0.5).alias("mad"))
    return off.select(*SERIES, "mid", (F.col("mid") + k * SIGMA * F.col("mad")).alias("limit"))


def mask_speed_outliers(pose: DataFrame, k: float = 5.0) -> DataFrame:
    """pose with points missing that are reached and left faster than their series' limit, again and again until there
    are none. Speeds are a frame between a known point and the one known before it, however many frames ago.

    A round looks only at series that lost a point in the one before; it is two aggregates and a window over known
    points. A series of fewer than three known points stays as it is. Points with one coordinate are unknown.
    """
    c, w = F.col, Window.partitionBy(*SERIES).orderBy("sidx")
    known = pose.where("x is not null and y is not null").select(*SERIES, "sidx", "x", "y")
    clean = None
    while True:
        before = lambda n: c(n) - F.lag(n).over(w)
        moving = known.withColumn("speed", F.sqrt(before("x") ** 2 + before("y") ** 2) / before("sidx")).withColumn("next", F.lead("speed").over(w))
        moving = moving.join(_limits(moving, "speed", k), list(SERIES))
        bad = F.coalesce((c("speed") > c("limit")) & (c("next") > c("limit")), F.lit(False))
        table = moving.withColumn("bad", bad).withColumn("any", F.max("bad").over(Window.partitionBy(*SERIES)))
        table = stored(table.select(*SERIES, "sidx", "x", "y", "bad", "any"), "speed-mask")
        done = table.where("not any").select(*SERIES, "sidx")
        clean = done if clean is None else clean.unionAll(done)
        known = table.where("any and not bad").select(*SERIES, "sidx", "x", "y")
        if known.isEmpty():
            break
    return _only(pose, clean)


def mask_drift_outliers(pose: DataFrame, fps: float, k: float = 5.0, floor: float = 15.0) -> DataFrame:
    """pose with points missing that are far from a running median over about two seconds, taken over the series with its
    gaps bridged: further than the limit of the series' distances and than `floor`. A series of fewer than three known
    points stays as it is."""
    c, w = F.col, Window.partitionBy(*SERIES).orderBy("sidx")
    width = max(3, round(2 * fps))
    width += width % 2 == 0
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ok = c("x").isNotNull() & c("y").isNotNull()
    df = pose.select(*SERIES, "sidx", *[F.when(ok, c(a)).alias(a) for a in "xy"]).withColumn("n", F.count("x").over(whole)).where("n >= 3")
    df = df.withColumns({f"f{a}": W.interpolate(c(a), c("sidx"), w) for a in "xy"})
    df = df.withColumns({f"m{a}": W.wide_median(c(f"f{a}"), w, width) for a in "xy"}).where("x is not null")
    df = stored(df.select(*SERIES, "sidx", F.sqrt((c("x") - c("mx")) ** 2 + (c("y") - c("my")) ** 2).alias("away")), "drift")
    far = df.join(_limits(df, "away", k), list(SERIES)).where(c("away") > F.greatest(c("limit"), F.lit(floor)))
    return _without(pose, far.select(*SERIES, "sidx"))


def _only(pose: DataFrame, points: DataFrame) -> DataFrame:
    """pose with the places of all other points missing."""
    kept = pose.join(points.withColumn("_k", F.lit(True)), [*SERIES, "sidx"], "left")
    return kept.select(*[F.when(F.col("_k"), F.col(c)).alias(c) if c in "xy" else F.col(c) for c in pose.columns])


def _without(pose: DataFrame, points: DataFrame) -> DataFrame:
    left = pose.join(points.withColumn("_k", F.lit(True)), [*SERIES, "sidx"], "left")
    return left.select(*[F.when(F.col("_k").isNull(), F.col(c)).alias(c) if c in "xy" else F.col(c) for c in pose.columns])


def masked(pose: DataFrame, fps: float) -> DataFrame:
    """pose without outliers of either kind. pose: session, sidx, track, node, x, y; null (not NaN) is missing."""
    return mask_drift_outliers(stored(mask_speed_outliers(pose), "speed-masked"), fps)


def gaps(missing: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of missing values."""
    edge = np.diff(np.concatenate([[0], missing.astype(int), [0]]))
    return list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1))


def pchip(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation with weighted harmonic slopes."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    if len(t) == 2:
        return v[0] + d[0] * (at - t[0])
    m = np.zeros(len(t))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = d[1:] * d[:-1] > 0
    m[1:-1][same] = ((w1 + w2)[same]) / (w1[same] / d[:-1][same] + w2[same] / d[1:][same])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(h) - 1)
    s = (at - t[i]) / h[i]
    return (1 + 2 * s) * (1 - s) ** 2 * v[i] + s * (1 - s) ** 2 * h[i] * m[i] + s * s * (3 - 2 * s) * v[i + 1] + s * s * (s - 1) * h[i] * m[i + 1]


def _filtered(v: np.ndarray, q: float, r: float, start: float):
    """A constant-velocity model filtered forward, missing values predicted: (position, speed) and covariance (three
    numbers) of each frame before and after its value. Plain numbers: a 2 by 2 matrix is too small for array calls."""
    p, u, a, b, c = start, 0.0, 1.0, 0.0, 1.0
    ahead, known = [], []
    for i, z in enumerate(v.tolist()):
        if i:
            p, a, b, c = p + u, a + 2 * b + c + q, b + c, c + q
        ahead.append((p, u, a, b, c))
        if z == z:
            k, m = a / (a + r), b / (a + r)
            p, u, a, b, c = p + k * (z - p), u + m * (z - p), a - k * a, b - k * b, c - m * b
        known.append((p, u, a, b, c))
    return ahead, known


def kalman_smooth(v: np.ndarray, q: float = 1e-3, r: float = 1e-2) -> np.ndarray:
    """Positions of a constant-velocity model, filtered forward and smoothed back; missing values are predicted."""
    ahead, known = _filtered(v, q, r, float(v[np.isfinite(v)][0]))
    p, u = known[-1][:2]
    out = [p]
    for (p0, u0, a, b, c), (p1, u1, a1, b1, c1) in zip(known[-2::-1], ahead[:0:-1]):
        det, dp, du = a1 * c1 - b1 * b1, p - p1, u - u1
        # gain: covariance times the transposed step, times the inverse of what was predicted
        x, y = (c1 * dp - b1 * du) / det, (a1 * du - b1 * dp) / det
        p, u = p0 + (a + b) * x + b * y, u0 + (b + c) * x + c * y
        out.append(p)
    return np.array(out[::-1])


def fill_converging(v: np.ndarray, fps: float, short_s: float = 0.25, q: float = 1e-3, r: float = 1e-2) -> np.ndarray:
    """The earlier filler: short inner gaps by monotone cubics, all others by the mean of the filters that run over the
    whole series forward and backward, both from its first value. Few or no values as in fill."""
    v = v.astype(float).copy()
    ok = np.isfinite(v)
    if ok.sum() < 3:
        return np.full(len(v), v[ok].mean() if ok.any() else 0.0)
    t, short, out = np.arange(len(v), dtype=float), max(2, round(short_s * fps)), v.copy()
    for a, b in gaps(~ok):
        if a > 0 and b < len(v) - 1 and b - a + 1 <= short:
            out[a : b + 1] = pchip(t[ok], v[ok], t[a : b + 1])
    start = float(v[ok][0])
    forward, backward = (np.array([k[0] for k in _filtered(x, q, r, start)[1]]) for x in (out, out[::-1]))
    return np.where(np.isfinite(out), out, (forward + backward[::-1]) / 2)


def fill(v: np.ndarray, fps: float, short_s: float = 0.25) -> np.ndarray:
    """Short inner gaps by monotone cubics, longer ones by the smoother on their surroundings, ends by the nearest value.

    Fewer than three values give their mean everywhere, none gives zeros.
    """
    v = v.astype(float).copy()
    ok = np.isfinite(v)
    if not ok.any():
        return np.zeros(len(v))
    if ok.sum() < 3:
        return np.full(len(v), v[ok].mean())
    t, short, out = np.arange(len(v), dtype=float), max(2, round(short_s * fps)), v.copy()
    for a, b in gaps(~ok):
        if a == 0 or b == len(v) - 1:
            continue
        n = b - a + 1
        if n <= short:
            out[a : b + 1] = pchip(t[ok], v[ok], t[a : b + 1])
        else:
            around = max(int(round(1.5 * fps)), 2 * n)
            lo, hi = max(0, a - around), min(len(v), b + 1 + around)
            if np.isfinite(v[lo:hi]).sum() >= 3:
                out[a : b + 1] = kalman_smooth(v[lo:hi])[a - lo : b + 1 - lo]
    left = ~np.isfinite(out)
    out[left] = np.interp(t[left], t[~left], out[~left])
    return out


def repaired(pose: DataFrame, fps: float, mask: bool = True, filler=fill) -> DataFrame:
    """pose with outliers masked and gaps filled. Smoothing (operators.pose.smooth) follows with window functions.

    A task has one node's series of one session at a time: a session is a recording of hours at most.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sidx")
        return pdf.assign(x=filler(pdf.x.to_numpy(float), fps), y=filler(pdf.y.to_numpy(float), fps))

    rows = masked(pose, fps) if mask else pose
    return rows.groupBy(*SERIES).applyInPandas(one, pose.schema)
