import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from herdlens.operators import repair
from herdlens.operators import windows as W


def running_median(x, width):
    """Odd width, ends mirrored."""
    padded = np.pad(x, width // 2, mode="symmetric")
    return np.array([np.median(padded[i : i + width]) for i in range(len(x))])


def run(spark, x, column, y=None):
    rows = [(0, i, None if v is None or v != v else float(v), float(i if y is None else y[i])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, i int, x double, y double")
    w = Window.partitionBy("k").orderBy("i")
    return np.array([np.nan if r.o is None else r.o for r in df.select("i", column(w).alias("o")).orderBy("i").collect()])


X = F.col


def test_gradient_and_turn(spark):
    v = np.array([3.0, 4, 8, 7, 1])
    assert np.allclose(run(spark, v, lambda w: W.gradient(F.col("x"), w)), np.gradient(v))
    assert np.allclose(run(spark, [170, 180, -170, -160], lambda w: W.turn(F.col("x"), w)), [10, 10, 10, 10])
    assert run(spark, [5.0], lambda w: W.turn(F.col("x"), w))[0] == 0 and run(spark, [5.0], lambda w: W.gradient(F.col("x"), w))[0] == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 30])
@pytest.mark.parametrize("width", [3, 5, 7])
def test_median_filter_mirrors_its_ends(spark, n, width):
    v = np.random.default_rng(n).normal(size=n)
    if n > width // 2:
        assert np.allclose(run(spark, v, lambda w: W.median_filter(F.col("x"), w, width)), running_median(v, width))


def savgol(v, width, poly, deriv, rate):
    out, half = [], width // 2
    for i in range(len(v)):
        lo = min(max(i - half, 0), len(v) - width)
        fit = np.poly1d(np.polyfit(np.arange(width), v[lo : lo + width], poly))
        out.append(fit.deriv(deriv)(i - lo) * rate**deriv if deriv else fit(i - lo))
    return np.array(out)


@pytest.mark.parametrize("width,poly,deriv", [(5, 3, 1), (5, 3, 2), (5, 3, 3), (5, 2, 0), (15, 3, 0), (11, 3, 1)])
def test_savgol_like_polynomial_fits(spark, width, poly, deriv):
    v = np.random.default_rng(width).normal(size=40)
    assert np.allclose(run(spark, v, lambda w: W.savgol(F.col("x"), w, width, poly, deriv, 10.0)), savgol(v, width, poly, deriv, 10.0), atol=1e-6)


def test_known_derivatives(spark):
    t = np.arange(100.0)
    assert np.allclose(run(spark, 5 * t / 30, lambda w: W.savgol(F.col("x"), w, 11, 3, 1, 30.0)), 5)
    assert np.allclose(run(spark, 3 * (t / 30) ** 2, lambda w: W.savgol(F.col("x"), w, 11, 3, 2, 30.0)), 6)
    assert np.allclose(run(spark, 3 * (t / 30) ** 2, lambda w: W.savgol(F.col("x"), w, 11, 3, 3, 30.0)), 0, atol=1e-6)


def test_interpolation(spark):
    v = [np.nan, 2, np.nan, np.nan, 8, np.nan]
    assert np.allclose(run(spark, v, lambda w: W.interpolate(F.col("x"), F.col("i").cast("double"), w)), [2, 2, 4, 6, 8, 8])
    assert np.isnan(run(spark, [np.nan] * 3, lambda w: W.interpolate(F.col("x"), F.col("i").cast("double"), w))).all()


def test_unwrap(spark):
    v = np.rad2deg(np.angle(np.exp(1j * np.linspace(0, 20, 50))))
    assert np.allclose(run(spark, v, lambda w: W.unwrap(F.col("x"), w)), np.rad2deg(np.unwrap(np.deg2rad(v))))


def test_lookback_has_this_frame(spark):
    flags = [0, 1, 0, 0, 0]
    assert run(spark, flags, lambda w: W.recently(F.col("x") > 0, w, 2).cast("int")).tolist() == [0, 1, 1, 0, 0]


def test_straight_paths(spark):
    x = [float(i) for i in range(20)]
    step = lambda w: W.step(F.col("x"), F.lit(0.0), w)
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "k int, i int, x double")
    w = Window.partitionBy("k").orderBy("i")
    df = df.withColumn("s", step(w))
    got = df.select(W.past_path_efficiency(F.col("s"), F.col("x"), F.lit(0.0), w, 5).alias("past"), W.centred_path_efficiency(F.col("s"), F.col("x"), F.lit(0.0), w, 2).alias("mid"), "i").orderBy("i").collect()
    assert all(abs(r.past - 1) < 1e-9 for r in got) and abs(got[10].mid - 4 / 5) < 1e-9


def series_of(spark, *series):
    """A node each; NaN is missing."""
    fine = lambda v: None if np.isnan(v) else float(v)
    rows = [("s", i, 0, n, fine(a), fine(b)) for n, (x, y) in enumerate(series) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "session string, sidx int, track int, node int, x double, y double")


def missing_of(df, n):
    out = [[] for _ in range(n)]
    for r in df.where("x is null or y is null").collect():
        out[r.node].append(r.sidx)
    return [sorted(o) for o in out]


def plain_masks(x, y, fps):
    """Both masks by definition, one series at a time."""
    x, y = x.copy(), y.copy()
    while True:
        at = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        if len(at) < 3:
            break
        v = np.hypot(np.diff(x[at]), np.diff(y[at])) / np.diff(at)
        limit = np.median(v) + 5 * 1.4826 * np.median(np.abs(v - np.median(v)))
        bad = [at[i + 1] for i in range(len(v) - 1) if v[i] > limit and v[i + 1] > limit]
        if not bad:
            break
        x[bad] = y[bad] = np.nan
    ok = np.isfinite(x) & np.isfinite(y)
    if ok.sum() < 3:
        return x, y
    width = max(3, round(2 * fps))
    width += width % 2 == 0
    base = []
    for v in (x, y):
        full = np.interp(np.arange(len(v)), np.flatnonzero(ok), v[ok])
        padded = np.pad(full, width // 2, mode="symmetric")
        base.append([np.median(padded[i : i + width]) for i in range(len(v))])
    away = np.hypot(x - base[0], y - base[1])[ok]
    limit = max(np.median(away) + 5 * 1.4826 * np.median(np.abs(away - np.median(away))), 15.0)
    bad = np.flatnonzero(ok)[away > limit]
    x[bad] = y[bad] = np.nan
    return x, y


def test_speed_outliers_and_drift(spark):
    rng = np.random.default_rng(3)
    x, y = (f(np.arange(200) / 9) * 20 + rng.normal(size=200) * 0.3 for f in (np.sin, np.cos))
    x[50], y[120] = 400, -300
    assert missing_of(repair.mask_speed_outliers(series_of(spark, (x, y))), 1) == [[50, 120]]
    x[50], y[120] = 0, 0
    x[30:36] += 100
    drift = missing_of(repair.mask_drift_outliers(series_of(spark, (x, y)), 24), 1)[0]
    assert set(range(30, 36)) <= set(drift)


def test_masks_like_plain_ones(spark):
    """Outliers beside gaps, outliers that only show when others are gone, short series, standstill, half-known points."""
    rng = np.random.default_rng(8)
    series = []
    for k in range(6):
        x, y = (np.cumsum(rng.normal(size=90)) for _ in "xy")
        for i in rng.integers(1, 89, 4):
            x[i] += rng.choice([40, 90, 600])
        x[20], x[21] = x[20] + 1000, x[21] - 1000  # neighbours
        gone = rng.random(90) < 0.15 * (k % 3)
        x[gone] = y[gone] = np.nan
        series.append((x, y))
    series += [(np.array([1.0, 900, 2, np.nan]), np.zeros(4)), (np.array([1.0, np.nan, 5]), np.zeros(3)), (np.zeros(40), np.zeros(40)), (np.full(9, np.nan), np.zeros(9))]
    still = np.zeros(60)
    still[30] = 500
    series.append((still, np.zeros(60)))
    half = series[0][0].copy(), series[0][1].copy()
    half[1][10] = np.nan
    series.append(half)
    got = missing_of(repair.masked(series_of(spark, *series), 10.0), len(series))
    want = [np.flatnonzero(~(np.isfinite(a) & np.isfinite(b))).tolist() for a, b in (plain_masks(x, y, 10.0) for x, y in series)]
    assert got == want and any(20 in w and 21 in w for w in want) and 30 in want[-2]


def test_wide_median(spark):
    rows = [(k, i, float((7 * i * i + 5 * k) % 23)) for k, n in ((0, 30), (1, 6), (2, 3), (3, 4), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    w = Window.partitionBy("k").orderBy("i")
    for width in (3, 7, 21):
        got = [(r.k, r.i, r.m) for r in df.select("k", "i", W.wide_median(F.col("x"), w, width).alias("m")).orderBy("k", "i").collect()]
        want = [(k, i, m) for k in range(5) for i, m in enumerate(running_median(np.array([x for g, _, x in rows if g == k]), width))]
        assert got == want


def test_pchip_is_monotone_and_exact():
    t = np.array([0.0, 1, 2, 5, 6])
    v = np.array([0.0, 1, 1, 4, 10])
    at = np.linspace(0, 6, 121)
    p = repair.pchip(t, v, at)
    assert np.allclose(p[np.isin(at, t)], v) and (np.diff(p) >= -1e-12).all() and np.allclose(p[(at >= 1) & (at <= 2)], 1)
    line = repair.pchip(t, 3 * t + 1, at)
    assert np.allclose(line, 3 * at + 1)


def dense_smoother(v, q=1e-3, r=1e-2):
    """The same estimate as one least-squares problem: the mode of the joint density of all states."""
    n, rows, rhs = len(v), [], []
    add = lambda row, b, var: (rows.append(row / var**0.5), rhs.append(b / var**0.5))
    for j, m in enumerate((v[np.isfinite(v)][0], 0.0)):
        row = np.zeros(2 * n)
        row[j] = 1
        add(row, m, 1.0)
    for i in range(1, n):
        for j in range(2):
            row = np.zeros(2 * n)
            row[2 * i + j] = 1
            row[2 * (i - 1) + j] -= 1
            if j == 0:
                row[2 * (i - 1) + 1] -= 1
            add(row, 0.0, q)
    for i, z in enumerate(v):
        if np.isfinite(z):
            row = np.zeros(2 * n)
            row[2 * i] = 1
            add(row, z, r)
    return np.linalg.lstsq(np.array(rows), np.array(rhs), rcond=None)[0][::2]


def test_smoother_like_least_squares():
    rng = np.random.default_rng(42)
    v = np.cumsum(rng.normal(size=60)) + np.linspace(0, 30, 60)
    v[20:35] = np.nan
    assert np.allclose(repair.kalman_smooth(v), dense_smoother(v), atol=1e-4)


@pytest.mark.parametrize("gap", [(40, 80), (0, 30), (170, 199), (50, 52)])
def test_fill(gap):
    v = np.sin(np.arange(200) / 15) * 30
    want = v.copy()
    v[gap[0] : gap[1] + 1] = np.nan
    out = repair.fill(v, 24)
    assert np.isfinite(out).all() and np.array_equal(out[np.isfinite(v)], want[np.isfinite(v)])
    if gap[0] == 0:
        assert (out[:31] == want[31]).all()
    if gap == (50, 52):
        assert np.abs(out - want).max() < 0.5


def test_fill_of_little():
    assert (repair.fill(np.full(5, np.nan), 24) == 0).all() and (repair.fill(np.array([np.nan, 4, 6, np.nan]), 24) == 5).all()


def test_earlier_filler():
    line = 2.0 * np.arange(60) + 5
    v = line.copy()
    v[[10, 11, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 58, 59]] = np.nan
    out = repair.fill_converging(v, 24)
    ok = np.isfinite(v)
    assert (out[ok] == v[ok]).all() and np.isfinite(out).all() and np.allclose(out[[10, 11]], line[[10, 11]])
    # the mean of two predictions that run on from either side
    assert np.abs(out[30:40] - line[30:40]).max() < 8
    assert (repair.fill_converging(np.full(5, np.nan), 24) == 0).all() and (repair.fill_converging(np.array([np.nan, 4, 6]), 24) == 5).all()
