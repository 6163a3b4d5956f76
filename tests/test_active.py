from herdlens.operators import bouts as T
from herdlens.operators import metrics as M


def test_active_bouts_by_precedence(spark):
    frames = spark.createDataFrame([("s", 0, 1, i) for i in range(12)] + [("t", 0, 1, 3)], "session string, tA int, tB int, sidx int")
    one = lambda *spans: spark.createDataFrame([("s", 0, 1, a, b) for a, b in spans], "session string, tA int, tB int, start int, end int")
    got = {(r.session, r.sidx): (r.kind, r.start, r.end) for r in T.active(frames, {"contact": one((4, 5)), "proximity": one((2, 7), (10, 11))}).collect()}
    assert len(got) == 13 and got["t", 3] == (None, None, None)
    assert [got["s", i][0] for i in range(12)] == [None] * 2 + ["proximity"] * 2 + ["contact"] * 2 + ["proximity"] * 2 + [None] * 2 + ["proximity"] * 2
    assert got["s", 6] == ("proximity", 2, 7) and got["s", 5] == ("contact", 4, 5)


def test_contacts_of_several_distances(spark):
    # at 10 frames a second and 1 px a cm: near for 4 s, with a gap of one frame, and for half a second, which is too short
    near = [1.0 if 100 <= i < 140 and i != 120 or 400 <= i < 405 else 9.0 for i in range(700)]
    rows = [("s", 0, 1, i, i, near[i], None if i % 2 else 2.5) for i in range(700)]
    df = spark.createDataFrame(rows, "session string, tA int, tB int, sidx int, vframe int, a double, b double")
    got = {(r.category, r.metric): r.value for r in M.contacts(df, {"All": "a", "Nose-Nose": "b"}, 10.0, 1.0).collect()}
    assert got["Proximity", "All"] == got["Contact", "All"] == 4.0 and got["Contact", "Nose-Nose"] == 0.0
    assert got["Proximity", "All 0–30s"] == 4.0 and got["Proximity", "All 30–60s"] == 0.0 and got["Proximity", "All 0–1min"] == 4.0 and got["Proximity", "All 1–2min"] == 0.0
    assert got["Proximity", "Nose-Nose"] == 69.9  # single missing frames are bridged, not the last
