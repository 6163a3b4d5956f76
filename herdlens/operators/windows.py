"""Time-series columns over a window of one series: partitioned by the series' key, ordered by frame.

Each function takes the column and the window (w: partition and order, no frame) and returns a column, so that all
columns of one series share a single sort.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.angles import wrap180


def difference(x: Column, w: WindowSpec) -> Column:
    """From the frame before; 0 at the first."""
    return x - F.coalesce(F.lag(x).over(w), x)


def step(x: Column, y: Column, w: WindowSpec) -> Column:
    """Distance moved since the frame before."""
    dx, dy = difference(x, w), difference(y, w)
    return F.sqrt(dx * dx + dy * dy)


def running(x: Column, w: WindowSpec) -> Column:
    """Sum up to here, nulls as 0."""
    return F.sum(F.coalesce(x, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def gradient(x: Column, w: WindowSpec) -> Column:
    """Central difference, one-sided at the ends; 0 for a single frame."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first & last, 0.0).when(first, after - x).when(last, x - before).otherwise((after - before) / 2)


def turn(a: Column, w: WindowSpec) -> Column:
    """Change of an angle since the frame before, wrapped; the first frame takes the second's; 0 for a single frame."""
    change = wrap180(a - F.lag(a).over(w))
    alone = F.lead(F.lit(1)).over(w).isNull()
    first = F.lag(F.lit(1)).over(w).isNull()
    return F.when(first & alone, 0.0).when(first, wrap180(F.lead(a).over(w) - a)).otherwise(change)


def centred(w: WindowSpec, half: int) -> WindowSpec:
    return w.rowsBetween(-half, half)


def rolling_mean(x: Column, w: WindowSpec, width: int) -> Column:
    """Centred; an even width reaches one further back than ahead."""
    ahead = (width - 1) // 2
    return F.avg(x).over(w.rowsBetween(-(width - 1 - ahead), ahead))


def rolling_std(x: Column, w: WindowSpec, half: int) -> Column:
    return F.coalesce(F.stddev_samp(x).over(centred(w, half)), F.lit(0.0))


def past_path_efficiency(step_: Column, x: Column, y: Column, w: WindowSpec, width: int) -> Column:
    """Net over travelled distance of the last `width` frames, 1 when at rest. By prefix sums: cost is the same for any width."""
    total = running(step_, w)
    path = total - F.coalesce(F.lag(total, width).over(w), F.lit(0.0))
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fx, fy = F.coalesce(F.lag(x, width).over(w), F.first(x).over(first)), F.coalesce(F.lag(y, width).over(w), F.first(y).over(first))
    net = F.sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))
    return F.when(path <= 1e-6, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), net / F.when(path > 1e-6, path))))


def centred_path_efficiency(step_: Column, x: Column, y: Column, w: WindowSpec, half: int) -> Column:
    """Net over travelled distance within half a window each way; the path has the step into the window's first frame too."""
    r = centred(w, half)
    path = F.sum(F.coalesce(step_, F.lit(0.0))).over(r)
    net = window_displacement(x, y, w, half)
    return F.when(path <= 1e-12, 0.0).otherwise(F.least(F.lit(1.0), net / F.when(path > 1e-12, path)))


def window_displacement(x: Column, y: Column, w: WindowSpec, half: int) -> Column:
    r = centred(w, half)
    dx, dy = F.last(x).over(r) - F.first(x).over(r), F.last(y).over(r) - F.first(y).over(r)
    return F.sqrt(dx * dx + dy * dy)


def gap_change(d: Column, w: WindowSpec) -> Column:
    """Half the change of a distance since the frame before."""
    return (d - F.coalesce(F.lag(d).over(w), d)) / 2


def recently(flag: Column, w: WindowSpec, frames: int) -> Column:
    """Whether the flag was set in the last `frames` frames, this one included."""
    return F.coalesce(F.max(flag.cast("int")).over(w.rowsBetween(-(frames - 1), 0)) > 0, F.lit(False))


def soon(flag: Column, w: WindowSpec, frames: int) -> Column:
    return F.coalesce(F.max(flag.cast("int")).over(w.rowsBetween(0, frames)) > 0, F.lit(False))


def reversal(av: Column, w: WindowSpec, half: int = 2, least: float = 20.0) -> Column:
    """Fast turns both ways within half a window; not in the first and last frames."""
    r = centred(w, half)
    both = F.max((av > least).cast("int")).over(r) + F.max((av < -least).cast("int")).over(r) == 2
    whole = F.count(F.lit(1)).over(r) == 2 * half + 1
    return F.coalesce(both & whole, F.lit(False))


def interpolate(x: Column, at: Column, w: WindowSpec) -> Column:
    """Linear between known values by `at`, the nearest one beyond the ends; null if there is none."""
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(x.isNotNull(), at)
    x0, t0, x1, t1 = F.last(x, True).over(back), F.last(known, True).over(back), F.first(x, True).over(ahead), F.first(known, True).over(ahead)
    return F.coalesce(x, F.when(x0.isNull(), x1).when(x1.isNull(), x0).otherwise(x0 + (x1 - x0) * (at - t0) / F.when(t1 > t0, t1 - t0)))


def unwrap(a: Column, w: WindowSpec) -> Column:
    """An angle without jumps at the wrap: the first value and all wrapped changes since."""
    first = F.first(a).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return first + running(F.coalesce(wrap180(a - F.lag(a).over(w)), F.lit(0.0)), w)


def median_filter(x: Column, w: WindowSpec, width: int) -> Column:
    """Running median of odd width; at the ends the series goes on as its mirror image (d c b a | a b c d | d c b a).

    Mirrored frames are taken from the same side, so the values are gathered by lag and lead only.
    """
    half = width // 2
    position, size = F.row_number().over(w) - 1, F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def at(k: int) -> Column:
        """Value k frames on, mirrored where that is outside."""
        out = (F.lead(x, k) if k >= 0 else F.lag(x, -k)).over(w)
        for p in range(min(half, abs(k))):  # p frames from the end on that side
            mirrored = (-k - 1 - 2 * p) if k < 0 else -(k - 1 - 2 * p)
            there = position == p if k < 0 else position == size - 1 - p
            out = F.when(there, (F.lead(x, mirrored) if mirrored >= 0 else F.lag(x, -mirrored)).over(w)).otherwise(out)
        return out

    values = F.sort_array(F.array(*[at(k) for k in range(-half, half + 1)]))
    return F.when(size > half, F.element_at(values, half + 1)).otherwise(x)


def wide_median(x: Column, w: WindowSpec, width: int) -> Column:
    """As median_filter, for wide windows over a column without nulls: a frame gathers its window once, and what stands
    outside is the mirror image of the window's own ends. A series shorter than half a window is mirrored again and
    again."""
    half = width // 2
    position, size = F.row_number().over(w) - 1, F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = F.collect_list(x).over(centred(w, half))
    before, after = F.greatest(half - position, F.lit(0)), F.greatest(half - (size - 1 - position), F.lit(0))
    once = F.concat(near, F.slice(near, F.lit(1), before.cast("int")), F.slice(F.reverse(near), F.lit(1), after.cast("int")))
    place = lambda j: F.pmod(j, (2 * size).cast("int"))
    often = F.transform(F.sequence(position - half, position + half), lambda j: F.get(near, F.when(place(j) >= size, 2 * size - 1 - place(j)).otherwise(place(j)).cast("int")))
    return F.element_at(F.sort_array(F.when(size > half, once).otherwise(often)), half + 1)


@lru_cache
def savgol_taps(width: int, poly: int, deriv: int, rate: float) -> tuple[tuple[float, ...], ...]:
    """taps[position in the window][k]: weights of the window's values for the derivative of the fitted polynomial there."""
    t = np.arange(width, dtype=float)
    design = np.vander(t, poly + 1, increasing=True)
    fit = np.linalg.pinv(design)
    out = []
    for at in range(width):
        row = np.zeros(poly + 1)
        for p in range(deriv, poly + 1):
            row[p] = np.prod(np.arange(p - deriv + 1, p + 1)) * float(at) ** (p - deriv)
        out.append(tuple((row @ fit * rate**deriv).tolist()))
    return tuple(out)


def savgol(x: Column, w: WindowSpec, width: int, poly: int, deriv: int = 0, rate: float = 1.0) -> Column:
    """Least-squares polynomial over a moving window, its derivative at each frame; the end windows' fits serve the ends.

    A series shorter than the window keeps its values (derivative 0).
    """
    half, taps = width // 2, savgol_taps(width, poly, deriv, rate)
    position, size = F.row_number().over(w) - 1, F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def fitted(inside: int) -> Column:
        """The frame stands at place `inside` of its window."""
        terms = [(F.lead(x, k - inside) if k >= inside else F.lag(x, inside - k)).over(w) * taps[inside][k] for k in range(width)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total

    out = fitted(half)
    for p in range(half):
        out = F.when(position == p, fitted(p)).when(position == size - 1 - p, fitted(width - 1 - p)).otherwise(out)
    return F.when(size >= width, out).otherwise(x if deriv == 0 else F.lit(0.0))
