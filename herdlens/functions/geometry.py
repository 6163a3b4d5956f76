"""Distances, projections, zones, shapes and normalisers, as columns. A null coordinate gives null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Of two vectors; 0 if one is (almost) zero."""
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.when(size > EPS, (ax * bx + ay * by) / size).when(size.isNotNull(), 0.0)


def body_frame(dx: Column, dy: Column, heading: Column) -> tuple[Column, Column]:
    """(longitudinal, lateral) of the vector (dx, dy) seen from a body with that heading; left is positive."""
    c, s = F.cos(F.radians(heading)), F.sin(F.radians(heading))
    return dx * c + dy * s, dy * c - dx * s


def _along(dx: Column, dy: Column, vx: Column, vy: Column) -> Column:
    d = F.sqrt(dx * dx + dy * dy)
    return (vx * dx + vy * dy) / F.when(d < EPS, 1.0).otherwise(d)


def approach(dx: Column, dy: Column, vx: Column, vy: Column) -> Column:
    """Velocity towards a target at (dx, dy)."""
    return _along(dx, dy, vx, vy)


def retreat(dx: Column, dy: Column, vx: Column, vy: Column) -> Column:
    """Velocity away from it."""
    return _along(-dx, -dy, vx, vy)


def relative_position(along: Column, across: Column) -> Column:
    sideways = F.abs(across) > F.abs(along)
    side = F.when(across > 0, "Left").otherwise("Right")
    return F.when(along.isNull() | across.isNull(), None).when(sideways, side).otherwise(F.when(along >= 0, "Front").otherwise("Behind"))


def visual_scope(error: Column) -> Column:
    return F.when(error < 20, "Binocular").when(error < 120, "Monocular").otherwise("None")


def auditory_scope(error: Column) -> Column:
    return F.when(error < 60, "Binaural").when(error < 150, "Monaural").otherwise("Rear")


def zone(x: Column, y: Column, roi: tuple[float, float, float, float], strip: float, missing: str | None = "Undetected") -> Column:
    """Nine zones: corners before walls before the open field; outside the arena counts with the nearest edge.

    Clockwise: W1 top, W2 right, W3 bottom, W4 left; C1 top left, C2 top right, C3 bottom right, C4 bottom left. Later
    ones win.
    """
    x0, y0, x1, y1 = roi
    left, right, top, bottom = x < x0 + strip, x > x1 - strip, y < y0 + strip, y > y1 - strip
    named = (
        F.when(bottom & left, "C4").when(bottom & right, "C3").when(top & right, "C2").when(top & left, "C1")
        .when(left, "W4").when(bottom, "W3").when(right, "W2").when(top, "W1").otherwise("Open")
    )
    return F.when(x.isNull() | y.isNull(), missing).otherwise(named) if missing else named


def coarse_zone(name: Column) -> Column:
    """Center, Perimeter or Corner of a nine-zone name."""
    return F.when(name == "Open", "Center").when(name.startswith("W"), "Perimeter").when(name.startswith("C"), "Corner")


def centre_distance(x: Column, y: Column, roi) -> Column:
    x0, y0, x1, y1 = roi
    return distance(x, y, F.lit((x0 + x1) / 2), F.lit((y0 + y1) / 2))


def boundary_distance(x: Column, y: Column, roi) -> Column:
    """To the nearest edge from inside, 0 outside. least() skips nulls, so they are sorted out first."""
    x0, y0, x1, y1 = roi
    inside = F.least(x - x0, x1 - x, y - y0, y1 - y)
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(F.lit(0.0), inside))


def triangle_area(ax, ay, bx, by, cx, cy) -> Column:
    return F.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2


def hourglass(upper: Column, lower: Column) -> tuple[Column, Column]:
    """(area, ratio) of two triangles: a missing one counts as 0 unless both are; no ratio to a lower one of no size."""
    area = F.when(upper.isNotNull() | lower.isNotNull(), F.coalesce(upper, F.lit(0.0)) + F.coalesce(lower, F.lit(0.0)))
    return area, F.when(lower > 1e-10, upper / lower)


def elongation(xs: Column, ys: Column) -> tuple[Column, Column]:
    """Aggregates over an animal's nodes: (elongation, eccentricity) by the eigenvalues of the covariance; two nodes at least.

    Elongation is the ratio of the axes' standard deviations, eccentricity sqrt(1 - minor / major).
    """
    both = xs.isNotNull() & ys.isNotNull()
    x, y = F.when(both, xs), F.when(both, ys)
    a, b, c = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    half, root = (a + b) / 2, F.sqrt((a - b) * (a - b) / 4 + c * c)
    major, minor = F.greatest(half + root, F.lit(EPS)), F.greatest(half - root, F.lit(EPS))
    enough = F.count(x) >= 2
    return F.when(enough, F.sqrt(major / minor)), F.when(enough, F.sqrt(F.lit(1.0) - minor / major))


def _once(value: Column, then) -> Column:
    """then(value) with value worked out once, however often it is used there: a lambda's variable is not an expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _hull(xs: Column, ys: Column) -> Column:
    """hull's numbers as a struct (area, length), in one pass over the edges."""
    both = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    known = F.filter(both, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    points = F.array_distinct(F.transform(known, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))

    def edge(points, p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]

        def fits(r):
            turn = dx * (r["y"] - p["y"]) - dy * (r["x"] - p["x"])
            along = dx * (r["x"] - p["x"]) + dy * (r["y"] - p["y"])
            return (turn > 0) | ((turn == 0) & along.between(0, dx * dx + dy * dy))

        return ((dx != 0) | (dy != 0)) & F.forall(points, fits)

    def measured(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        return F.struct(((p["x"] * q["y"] - q["x"] * p["y"]) / 2).alias("area"), F.sqrt(dx * dx + dy * dy).alias("length"))

    def numbers(points):
        edges = F.flatten(F.transform(points, lambda p: F.transform(F.filter(points, lambda q: edge(points, p, q)), lambda q: measured(p, q))))
        start = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("length"))
        total = F.aggregate(edges, start, lambda s, e: F.struct((s["area"] + e["area"]).alias("area"), (s["length"] + e["length"]).alias("length")))
        return F.when(F.size(points) > 0, total)

    return _once(points, numbers)


def hull(xs: Column, ys: Column) -> tuple[Column, Column]:
    """(area, perimeter) of the convex hull of an animal's nodes (arrays of one length).

    A step between two nodes is an edge of the hull if no node is on its right and those in line are between its ends.
    That compares few nodes with each other, without leaving the JVM. Null with no valid node.
    """
    found = _hull(xs, ys)
    return F.abs(found["area"]), found["length"]


def circularity(xs: Column, ys: Column) -> Column:
    """4 pi area / perimeter^2 of the hull of an animal's nodes; null below three valid nodes and for those in line."""
    return _once(_hull(xs, ys), lambda h: F.when(F.abs(h["area"]) > 1e-10, 4 * F.pi() * F.abs(h["area"]) / (h["length"] * h["length"])))


def clip01(v: Column) -> Column:
    return F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def norm_range(v: Column, low: Column, high: Column) -> Column:
    """Into 0 to 1 between low and high; 0.5 where they meet."""
    return F.when(v.isNotNull() & (high - low < EPS), 0.5).otherwise(clip01((v - low) / F.when(high - low >= EPS, high - low)))


def norm_correlation(v: Column) -> Column:
    return clip01((v + 1) / 2)


def norm_p95(v: Column, p95: Column) -> Column:
    return F.when(v.isNotNull() & (p95 < EPS), 0.5).otherwise(clip01(v / F.when(p95 >= EPS, p95)))
