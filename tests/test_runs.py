import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from herdlens.operators import bouts as T
from herdlens.operators import runs as R


def table(spark, series, kind="int"):
    return spark.createDataFrame([(k, i, v) for k, vs in enumerate(series) for i, v in enumerate(vs)], f"k int, i int, f {kind}")


def ones(v):
    out, start = [], None
    for i, x in enumerate([*v, 0]):
        if x == 1 and start is None:
            start = i
        elif x != 1 and start is not None:
            out.append((start, i - 1))
            start = None
    return out


def filled(v, most):
    v = [int(x == 1) for x in v]
    runs = ones(v)
    for (_, b), (c, _) in zip(runs, runs[1:]):
        if c - b - 1 <= most:
            v[b + 1 : c] = [1] * (c - b - 1)
    return v


def kept(v, least):
    out = [0] * len(v)
    for a, b in ones(v):
        if b - a + 1 >= least:
            out[a : b + 1] = [1] * (b - a + 1)
    return out


def held(v, least):
    runs, i = [], 0
    while i < len(v):
        j = i
        while j < len(v) and v[j] == v[i]:
            j += 1
        runs.append((i, j))
        i = j
    sure = [x for i, j in runs for x in [v[i] if j - i >= least else None] * (j - i)]
    out = []
    for i in range(len(v)):
        before = [x for x in sure[: i + 1] if x is not None]
        after = [x for x in sure[i:] if x is not None]
        out.append(before[-1] if before else after[0] if after else v[i])
    return out


def column(df, name="f"):
    out = {}
    for r in df.orderBy("k", "i").collect():
        out.setdefault(r.k, []).append(r[name])
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from([0, 1, None]), min_size=1, max_size=40), min_size=1, max_size=30), st.integers(1, 4))
def test_runs_like_brute_force(spark, series, n):
    df = table(spark, series)
    assert column(R.fill_gaps(df, "f", ["k"], "i", n)) == {k: filled(v, n) for k, v in enumerate(series)}
    plain = [[x or 0 for x in v] for v in series]
    assert column(R.drop_short(table(spark, plain), "f", ["k"], "i", n)) == {k: kept(v, n) for k, v in enumerate(plain)}
    got = {}
    for r in R.bouts(df, "f", ["k"], "i").orderBy("k", "bout").collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    assert got == {k: ones(v) for k, v in enumerate(series) if ones(v)}


def test_state_hold_like_brute_force(spark):
    rng = random.Random(1)
    series = [[rng.choice("aab") for _ in range(rng.randint(1, 30))] for _ in range(40)]
    assert column(R.state_hold(table(spark, series, "string"), "f", ["k"], "i", 3)) == {k: held(v, 3) for k, v in enumerate(series)}


def test_known_bouts(spark):
    """Ten frames a second: gaps of up to two frames are bridged, bouts have eight frames at least."""
    t, f = [1], [0]
    series = [t * 20, t * 4 + f * 2 + t * 14, t * 4 + f * 4 + t * 12, t * 5, [0], f * 10, t * 4 + f * 2 + t * 16]
    got = {r.k: (r.start, r.end) for r in R.detect_bouts(table(spark, series), "f", ["k"], "i", 10.0).collect()}
    assert got == {0: (0, 19), 1: (0, 19), 2: (8, 19), 6: (0, 21)}


@pytest.mark.parametrize("n,found", [(23, 0), (24, 1)])
def test_least_bout_at_thirty_frames_a_second(spark, n, found):
    assert R.detect_bouts(table(spark, [[1] * n + [0] * 20]), "f", ["k"], "i", 30.0).count() == found


def test_onset_gate(spark):
    df = spark.createDataFrame([(0, i, f, m) for i, (f, m) in enumerate([(1, 0), (1, 0), (1, 0), (1, 9), (0, 0), (0, 0), (1, 0), (0, 0), (1, 9), (1, 0)])], "k int, i int, f int, m int")
    from pyspark.sql import functions as F

    assert column(R.onset_gate(df, "f", ["k"], "i", 1, F.col("m") > 5))[0] == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1]


def test_second_marks_at_a_tie(spark):
    t, f = [1], [0]
    series = [f * 5 + t * 15 + f * 10, t * 15 + f * 15]
    df = table(spark, series)
    got = {(r.k, r.second): r.mark for r in R.second_marks(df, "f", ["k"], "i", "i", 10.0).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (0, 2): 0, (1, 0): 1, (1, 1): 0, (1, 2): 0}


def test_many_gates_at_once_are_like_each_alone(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(k, i, rng.choice([0, 0, 1]), rng.choice([0, 1, 1]), rng.randint(0, 9)) for k in range(30) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "k int, i int, f int, g int, m int")
    both = R.gates(df, {"f": (F.col("f") == 1, 2, F.col("m") > 7), "g": (F.col("g") == 1, 1, None)}, ["k"], "i")
    assert column(both, "f") == column(R.onset_gate(df, "f", ["k"], "i", 2, F.col("m") > 7), "f")
    assert column(both, "g") == column(R.fill_gaps(df, "g", ["k"], "i", 1), "g")


def test_bout_indices_cover_the_whole_session(spark, data, monkeypatch):
    from herdlens.queries import runs as Q

    # user 1 has 700 frames, which are 5.8 minutes at two frames a second; user 2 has one minute
    rows = [(u, i, float(i % 7), int(i % 10 < 4)) for u, n in ((1, 700), (2, 100)) for i in range(n)]
    monkeypatch.setattr(Q, "signal", lambda *a: spark.createDataFrame(rows, "user_id long, idx int, value double, flag int"))
    got = {(r.session, r.scope, r.number): r.n_bouts for r in Q.bout_indices(spark, "").collect()}
    assert [got["1", "full", 0], got["2", "full", 0]] == [70, 10]
    assert [got["1", "minute", i] for i in range(6)] == [12] * 5 + [10] and ("1", "minute", 6) not in got
    assert [got["1", "cumulative", i] for i in range(1, 7)] == [12, 24, 36, 48, 60, 70] and ("1", "cumulative", 7) not in got
    assert got["2", "minute", 0] == 10 and ("2", "minute", 1) not in got


def test_spine_by_session(spark):
    from herdlens.operators import bouts as T

    pairs = spark.createDataFrame([("a", 0, 1), ("b", 0, 1)], "session string, tA int, tB int")
    frames = spark.createDataFrame([("a", 0, 1, 0), ("a", 0, 1, 250), ("b", 0, 1, 30)], "session string, tA int, tB int, sidx int")
    from pyspark.sql import functions as F

    out = T.spine(T.with_last_second(pairs, frames, F.col("sidx")), F.col("last_second")).groupBy("session", "scope").count().collect()
    assert {(r.session, r.scope): r["count"] for r in out} == {("a", "full"): 1, ("a", "minute"): 5, ("a", "cumulative"): 5, ("b", "full"): 1, ("b", "minute"): 1, ("b", "cumulative"): 1}
    assert T.spine(pairs, 120.0).count() == 2 * 5


def test_bouts_of_bins(spark):
    """Bins of three frames; B faces A before the first bout and turns away after it, the second bout ends the series."""
    flags = [0, 0, 0, 1, 1, 0, 1, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 1, 1]
    rows = [("s", 0, 1, i, f, 50.0, 10.0 if i < 9 else 170.0) for i, f in enumerate(flags)]
    frames = spark.createDataFrame(rows, "session string, tA int, tB int, sidx int, near int, fe_A double, fe_B double")
    bins = {r.place: r.near for r in T.flagged_bins(frames, "near", F.col("sidx") / 3.0, 3.0, 1.0).collect()}
    assert [bins[i] for i in range(7)] == [0, 1, 1, 0, 0, 0, 1]
    found = sorted((r.start, r.end, r.initiator, r.disengager, r.start_s, r.last_s) for r in T.binned_bouts(frames, "near", F.col("sidx") / 3.0, 3.0, 1.0).collect())
    # the second bout's own last two bins stand for what comes after it
    assert found == [(1, 2, "B", "B", 1.0, 6.0), (6, 6, "A", "B", 6.0, 6.0)]
    indices = {(r.scope, r.number): (r.n_bouts, r.EI, r.RI) for r in T.binned_indices(frames, "near", F.col("sidx") / 3.0, 3.0, 1.0).collect()}
    assert indices == {("full", 0): (2, 0.5, 0.5), ("minute", 0): (2, 0.5, 0.5), ("cumulative", 1): (2, 0.5, 0.5)}


def test_bouts_of_many_behaviours(spark):
    rows = [("s", 0, 1, i, int(2 <= i < 6), int(4 <= i < 9), int(i == 1), float(i), 10.0 * i, 1.0) for i in range(12)]
    frames = spark.createDataFrame(rows, "session string, tA int, tB int, sidx int, Go_AtoB int, Go_BtoA int, Still int, A_v double, B_v double, d double")
    found = {(r.behaviour, r.direction): r for r in T.behaviour_table(frames, ["Go_AtoB", "Go_BtoA", "Still"], ["v"], ["d"], 10.0).collect()}
    assert set(found) == {("Go", "AtoB"), ("Go", "BtoA")}
    a, b = found["Go", "AtoB"], found["Go", "BtoA"]
    assert (a.start, a.end, a.duration_s, a.group, a.actor_v_p50, a.target_v_mean, a.d_p95) == (2, 5, 0.4, "s/0/1", 3.5, 35.0, 1.0)
    assert (b.start, b.end, b.actor_v_p50, b.target_v_p50) == (4, 8, 60.0, 6.0)


def test_features_by_class(spark):
    """Angles over the seam, signed jerks, values that are no numbers, flags of all frames, categories left out, both roles."""
    nan, inf = float("nan"), float("inf")
    rows = [
        ("s", 0, 1, i, int(1 <= i < 5), int(6 <= i < 9), 170.0 + 5 * i, -170.0, [1.0, 2.0, nan, inf, 4.0][i % 5], None if i == 2 else float(i), -float(i), int(i % 2), "Front", float(i))
        for i in range(10)
    ]
    frames = spark.createDataFrame(rows, "session string, tA int, tB int, sidx int, Go_AtoB int, Go_BtoA int, A_h double, B_h double, A_v double, B_v double, A_j double, Contact int, place string, d double")
    frames = frames.withColumn("B_j", F.col("A_j") * 2)
    table = T.class_table(frames, ["Go_AtoB", "Go_BtoA"], {"heading": "h", "nose_speed": "v", "jerk": "j"}, {"inter_dist": "d", "Contact": "Contact", "RelPos_A": "place"}, 10.0)
    names = T.class_features(["heading", "nose_speed", "jerk"], ["inter_dist", "Contact", "RelPos_A"])
    assert table.columns[10:] == names and not [n for n in names if "RelPos" in n] and len(names) == 13
    found = {r.direction: r for r in table.collect()}
    a, b = found["AtoB"], found["BtoA"]
    assert a.actor_heading_cmean == pytest.approx(-177.5) and a.target_heading_cmean == pytest.approx(-170.0)  # 175 to 190
    assert (a.actor_nose_speed_p50, a.target_nose_speed_p50) == (3.0, 3.0)  # of 2, 4; of 1, 3, 4 without the missing one
    assert (a.actor_jerk_p50, a.target_jerk_p50, a.actor_jerk_p95) == (2.5, 5.0, pytest.approx(1.15))
    assert (a.inter_dist_mean, a.inter_dist_median, a.Contact_prop) == (2.5, 2.5, 0.5)
    assert b.actor_jerk_p50 == 14.0 and b.target_jerk_p50 == 7.0 and b.actor_heading_cmean == pytest.approx(-170.0)
    all_gone = T.class_table(frames.withColumn("A_v", F.lit(nan)), ["Go_AtoB"], {"nose_speed": "v"}, {}, 10.0).first()
    assert all_gone.actor_nose_speed_p50 is None
