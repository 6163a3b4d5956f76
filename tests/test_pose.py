import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdlens.functions import angles as A
from herdlens.functions import geometry as G
from herdlens.functions import names as N
from herdlens.operators import bins, metrics, pairs
from herdlens.operators import pose as O
from herdlens.sources import pose as S
from herdlens.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("o")).first().o


@pytest.mark.parametrize("a,b,want", [(0, 180, 180), (0, 90, 90), (10, 350, 20), (170, 190, 20), (350, 10, 20), (0, 0, 0)])
def test_opposition(spark, a, b, want):
    assert one(spark, A.opposition(F.lit(float(a)), F.lit(float(b)))) == pytest.approx(want)


@pytest.mark.parametrize("values,want", [([350, 10], 0), ([90, 90], 90), ([270, 270], -90)])
def test_circular_mean(spark, values, want):
    df = spark.createDataFrame([(float(v),) for v in values], "a double")
    got = df.select(A.circular_mean(F.col("a")).alias("m"), A.circular_mean_360(F.col("a")).alias("n")).first()
    assert got.m == pytest.approx(want, abs=1e-9) and min(abs(got.n - want % 360), 360 - abs(got.n - want % 360)) < 1e-9


def test_zones(spark):
    points = [(50, 50), (5, 50), (50, 5), (5, 5), (95, 95), (10, 50), (9, 50)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(7, None, 5.0)], "i int, x double, y double")
    z = G.zone(F.col("x"), F.col("y"), (0, 0, 100, 100), 10)
    got = [(r.z, r.c) for r in df.select("i", z.alias("z"), G.coarse_zone(z).alias("c")).orderBy("i").collect()]
    assert [g[0] for g in got] == ["Open", "W4", "W1", "C1", "C3", "Open", "W4", "Undetected"]
    assert [g[1] for g in got] == ["Center", "Perimeter", "Perimeter", "Corner", "Corner", "Center", "Perimeter", None]


def arrays(spark, a, b):
    pts = lambda p: ([None if v is None else float(v) for v, _ in p], [None if v is None else float(v) for _, v in p])
    return spark.createDataFrame([(*pts(a), *pts(b))], "A_xs array<double>, A_ys array<double>, B_xs array<double>, B_ys array<double>")


@pytest.mark.parametrize(
    "a,b,names,skip,want",
    [
        ([(0, 0), (10, 10)], [(5, 0), (15, 10)], ["node0", "node1"], [], (5.0, "node0-node0")),
        ([(0, 0)], [(3, 4)], ["body"], [], (5.0, "body-body")),
        ([(None, None)] * 2, [(None, None)] * 2, ["a", "b"], [], (None, "")),
        ([(0, 0), (5, 0), (10, 0)], [(100, 0), (105, 0), (11, 0)], ["body", "nose", "tailend"], [], (1.0, "tailend-tailend")),
        ([(0, 0), (5, 0), (10, 0)], [(100, 0), (105, 0), (11, 0)], ["body", "nose", "tailend"], [2], (95.0, "nose-body")),
    ],
)
def test_closest_nodes(spark, a, b, names, skip, want):
    d, label = pairs.min_distance(names, skip)
    got = arrays(spark, a, b).select(d.alias("d"), label.alias("l")).first()
    assert (got.d, got.l) == want


def test_contact_needs_all_nodes(spark):
    df = arrays(spark, [(0, 0), (None, None)], [(3, 4), (9, 9)])
    assert df.select(pairs.contact_distance().alias("d")).first().d is None and df.select(pairs.region_distance([0], [0, 1]).alias("d")).first().d == 5


def pose_rows(spark, points, node=0):
    return spark.createDataFrame([("s", i, 0, node, float(x), float(y)) for i, (x, y) in enumerate(points)], "session string, sidx int, track int, node int, x double, y double")


def test_speed_of_steady_motion_and_rest(spark):
    k = O.kinematics(pose_rows(spark, [(i, 0) for i in range(100)]), 10.0).where("sidx = 50").first()
    assert k.speed == pytest.approx(10, abs=1e-2) and k.heading == pytest.approx(0, abs=1e-6)
    assert O.kinematics(pose_rows(spark, [(42, 17)] * 50), 10.0).agg(F.max("speed")).first()[0] < 1e-3


@pytest.mark.parametrize("dx,dy,want", [(1, 0, 0), (0, 1, 90)])
def test_body_heading(spark, dx, dy, want):
    rows = [("s", i, 0, 10.0, 10.0, 10.0 + 5 * dx, 10.0 + 5 * dy) for i in range(30)]
    df = spark.createDataFrame(rows, "session string, sidx int, track int, body_x double, body_y double, nose_x double, nose_y double")
    assert all(abs(r.body_heading - want) < 1 for r in O.body_heading(df).collect())


@pytest.mark.parametrize("speed,want", [(10, "stationary"), (50, "walking"), (250, "running")])
def test_states_exclude_each_other(spark, speed, want):
    df = spark.createDataFrame([("s", i, 0, float(speed), 0.0) for i in range(20)], "session string, sidx int, track int, speed double, av double")
    for r in O.locomotion(df, 10.0, 10.0).collect():
        assert [n for n in ("stationary", "walking", "running") if r[n]] == [want] and not r.turning


def test_proximity_seconds(spark):
    df = spark.createDataFrame([("s", 0, 1, i, float(d)) for i, d in enumerate([5, 25, 35, 8, 10, 31])], "session string, tA int, tB int, sidx int, d double")
    keys = ["session", "tA", "tB"]
    last = lambda cm: metrics.cumulative_time(df, F.col("d") <= cm * 10, keys, 10.0, "t").agg(F.max_by("t", "sidx")).first()[0]
    assert last(3.0) == pytest.approx(0.4) and last(1.0) == pytest.approx(0.3)


def test_bins_of_a_matrix(spark):
    v = [10.0] * 10 + [20.0] * 10 + [30.0] * 10
    df = spark.createDataFrame([("s", 0, i, x, 350.0 if i % 2 else 10.0) for i, x in enumerate(v)], "session string, track int, i int, speed double, heading double")
    m = {(r.metric, r.bin): (r.value, r.norm) for r in bins.feature_matrix(df, F.col("i") / 1.0, {"speed": "range", "heading": "angle"}).collect()}
    assert [m["speed", b] for b in range(3)] == [(10, 0), (20, 0.5), (30, 1)]
    assert all(min(m["heading", b][0], 360 - m["heading", b][0]) < 1e-6 for b in range(3))


def test_empty_and_constant_bins(spark):
    df = spark.createDataFrame([("s", 0, t, 42.0) for t in (0, 1, 2, 25, 26)], "session string, track int, t int, v double")
    rows = {r.bin: (r.value, r.norm) for r in bins.feature_matrix(df, F.col("t") / 1.0, {"v": "range"}).collect()}
    assert rows == {0: (42.0, 0.5), 1: (None, None), 2: (42.0, 0.5)}


def test_correlation_of_constants_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    cov, corr = bins.cov_corr(F.col("a"), F.col("b"))
    assert tuple(df.select(cov.alias("c"), corr.alias("r")).first()) == (0.0, None)


def test_roll_up_needs_whole_bins(spark):
    with pytest.raises(ValueError):
        bins.rolled_up(spark.createDataFrame([(0, 1.0)], "bin int, x_mean double"), [], 0.3)


def test_roles():
    nodes = ["Nose", "ear_L", "ear_R", "centermass1", "hip_l", "hip_r", "tail_base", "tail1"]
    assert [N.find_node(nodes, r) for r in ("nose", "ear_l", "body", "tail_base", "hip_r")] == [0, 1, 3, 6, 5]
    assert N.find_node(["front_nose_tip"], "nose") == 0 and N.find_node(["BL", "hl"], "hip_l") == 1 and N.find_node(["mid body"], "body") == 0 and N.find_node(["x"], "nose") is None
    assert N.tail_end_nodes(nodes) == [7] and N.tail_end_nodes(["tail", "body"]) == []
    assert N.feature_class("thorax_to_nose_dist") == "distance" and N.feature_class("A_vs_B/HO") == "binary" and N.feature_class("hourglass_area") == "shape" and N.feature_class("thorax_x") == "position" and N.feature_class("nose_vx") == "velocity" and N.feature_class("covar") == "distance"
    assert N.frames(0.25, 30) == 8 and N.frames(0.25, 10) == 2


def monotone_chain(points):
    """(area, perimeter) of the hull."""
    p = sorted(set(points))
    if len(p) < 3:
        return 0.0, 2 * math.dist(p[0], p[-1]) if p else None

    def half(rows):
        out = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = half(p) + half(p[::-1])
    steps = list(zip(ring, ring[1:] + ring[:1]))
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in steps)) / 2, sum(math.dist(a, b) for a, b in steps)


def test_hull(spark):
    rng = np.random.default_rng(2)
    shapes = [[(0, 0), (4, 0), (4, 3), (0, 3), (1, 1), (0, 0)], [(0, 0), (1, 1), (2, 2)], [(0, 0), (2, 0), (4, 0), (4, 4), (2, 2)], [(5, 5)], [(1, 2), (1, 2)]]
    shapes += [[tuple(map(float, q)) for q in rng.integers(0, 5, (8, 2))] for _ in range(60)] + [[tuple(map(float, q)) for q in rng.normal(size=(8, 2))] for _ in range(20)]
    rows = [(i, [float(x) for x, _ in s] + [None, 1.0], [float(y) for _, y in s] + [1.0, float("nan")]) for i, s in enumerate(shapes)] + [(999, [None], [1.0])]
    df = spark.createDataFrame(rows, "i int, xs array<double>, ys array<double>")
    area, around = G.hull(F.col("xs"), F.col("ys"))
    got = {r.i: (r.a, r.p, r.c) for r in df.select("i", area.alias("a"), around.alias("p"), G.circularity(F.col("xs"), F.col("ys")).alias("c")).collect()}
    for i, s in enumerate(shapes):
        a, p = monotone_chain([(float(x), float(y)) for x, y in s])
        assert got[i][:2] == pytest.approx((a, p)) and got[i][2] == (pytest.approx(4 * math.pi * a / p**2) if a > 1e-10 else None)
    assert got[999] == (None, None, None)


def test_elongation(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(9, 2)) * [5, 1]
    df = spark.createDataFrame([("s", 0, 0, i, *map(float, p)) for i, p in enumerate(pts)], "session string, sidx int, track int, node int, x double, y double")
    got, ev = O.shapes(df).first(), np.sort(np.linalg.eigvalsh(np.cov(pts.T, bias=True)))
    assert got.elongation == pytest.approx(math.sqrt(ev[1] / ev[0])) and got.eccentricity == pytest.approx(math.sqrt(1 - ev[0] / ev[1]))


def test_write_and_read(spark, tmp_path):
    df = pose_rows(spark, [(1, 2), (3, float("nan"))])
    names = sinks.write_tables({"tracking": df, "pair_features": df, "other": df}, f"file://{tmp_path}/out", "csv", ["tracking", "pair_features"], animals=1)
    assert names == ["tracking"]
    back = S.read_long(spark, f"file://{tmp_path}/out/tracking", "csv")
    assert sorted((r.sidx, r.vframe, r.x, r.y) for r in back.collect()) == [(0, 0, 1.0, 2.0), (1, 1, 3.0, None)]
    assert sinks.unique_path(spark, f"file://{tmp_path}/out").endswith("out_1") and sinks.unique_path(spark, f"file://{tmp_path}/new").endswith("new")


def test_whole_analysis(spark, data, tmp_path):
    from herdlens.plans.session import Analysis
    from herdlens.queries.fixtures import NODES, ROI, pose

    p = pose(spark, f"{data}/sf0.001").where("session = 's0' and track < 2").withColumn("vframe", F.col("sidx"))
    a = Analysis(p, NODES, 10.0, ROI, regions={"NoseNose_region": ([0], [0])})
    assert a.metrics.count() > 20 and a.animals.count() == 400 and a.bouts("Engaged").where("initiator not in ('A', 'B')").count() == 0
    some = p.where("sidx < 200")
    b = Analysis(some, NODES, 10.0, ROI, repair=False, trim_s=0.0)
    assert b.engagement_indices.columns == ["session", "tA", "tB", "scope", "number", "n_bouts", "EI", "RI", "RTI"] and b.pair_bins().count() == 80
    folder, names = sinks.write_set("earlier", b.earlier(), f"file://{tmp_path}/s0")
    assert folder.endswith("s0_earlier") and names == ["metadata", "times", "intervals", "matrix"]
    meta = {r.key: float(r.value) for r in spark.read.option("header", True).csv(f"{folder}/metadata").collect()}
    assert 3.0 / meta.pop("dsr_px") == pytest.approx(meta.pop("cm_per_px"))
    assert meta == {"duration_s": 20.0, "frames": 200.0, "duration_after_gate_s": 15.0, "frames_after_gate": 150.0}
    assert sinks.write_set("earlier", b.earlier(), f"file://{tmp_path}/s0", wanted=["metadata"])[0].endswith("s0_earlier_1")
