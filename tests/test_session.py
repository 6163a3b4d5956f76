"""What an analysis makes, and what it doesn't."""

import pytest
from pyspark.sql import functions as F

from herdlens.functions.names import find_distance
from herdlens.operators import bouts as T
from herdlens.operators import labels as A
from herdlens.plans import session as S
from herdlens.queries.fixtures import NODES, staged
from herdlens.sources import sinks

ROI = (-250.0, -200.0, 250.0, 200.0)


@pytest.fixture(scope="module")
def pose(spark, data):
    df = staged(spark, f"{data}/sf0.001").where("session = 's0' and track < 2 and sidx < 120").withColumn("vframe", F.col("sidx") * 3)
    return df.cache()


@pytest.fixture
def counted(monkeypatch):
    names = []
    plain = S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: names.append(name) or plain(df, name))
    return names


def analysis(pose, **how):
    return S.Analysis(pose, NODES, 10.0, ROI, repair=False, trim_s=0.0, **how)


def test_only_the_stages_that_wanted_tables_need_are_stored(pose, counted, tmp_path):
    a = analysis(pose)
    assert counted == []
    assert list(a.tables(["entropy"])) == ["entropy"] and counted == ["pose"]
    a.tables(["zones", "info"])
    assert counted == ["pose"]
    a.tables(["tracking"])
    assert counted == ["pose", "kinematics"]
    written = sinks.write_tables(a.makers(), f"file://{tmp_path}/out", "parquet", ["entropy", "bins_025"])
    assert written == ["entropy", "bins_025"] and counted == ["pose", "kinematics", "animals"]
    a.tables(["pair_features"])
    assert counted[3:] == ["pairs"]


def test_names_in_tables(spark, pose):
    a = analysis(pose, names=["white", "black"])
    t = a.tables(["zones", "pair_features", "first_order", "info", "tracking"])
    assert {(r.track, r.animal) for r in t["zones"].select("track", "animal").distinct().collect()} == {(0, "white"), (1, "black")}
    assert t["first_order"].select("pair").distinct().collect() == [("white vs black",)]
    columns = t["pair_features"].columns
    assert columns[columns.index("tB") + 1] == "pair" and "animal" in t["tracking"].columns
    assert {r.key: r.value for r in t["info"].collect()}["fps"] == "10.0"
    table = spark.createDataFrame([("s0", 1, "black"), ("s9", 0, "other")], "session string, track int, name string")
    by_table = A.labelled(a.first_order.select("session", "sidx", "tA", "tB"), table)
    assert by_table.select("pair").distinct().collect() == [("t0 vs black",)] and by_table.count() == a.first_order.count()
    assert A.labelled(table.drop("track"), ["x"]).columns == ["session", "name"]


def test_wide_tables(pose):
    a = analysis(pose, names=["white", "black"])
    one, two = a.wide_flags(1, [0, 1]), a.wide_flags(2, [0, 1])
    assert one.count() == two.count() == 120
    assert {"white/running", "black/turning", "white_vs_black/Engaged"} <= set(one.columns) and "white_vs_black/Follow_AtoB" in two.columns
    row, flags = one.where("sidx = 60").first(), a.first_order.where("sidx = 60").first()
    assert all(row[f"white_vs_black/{f}"] == flags[f] for f in a.FIRST_FLAGS)


def test_onsets_are_in_video_time(spark, pose):
    found = analysis(pose).bouts("Engaged").collect()
    assert found and all(r.vframe == 3 * r.start and r.onset_s == pytest.approx(0.3 * r.start) for r in found)
    bouts = spark.createDataFrame([("s", 0, 1, 1, 4, 9), ("s", 0, 1, 2, 20, 22)], "session string, tA int, tB int, bout long, start int, end int")
    shown = spark.createDataFrame([("s", 31, 4), ("s", 30, 4), ("s", 50, 21), ("t", 9, 20)], "session string, vframe long, sidx int")
    assert [(r.bout, r.vframe, r.onset_s) for r in T.with_video_time(bouts, shown, 10.0).collect()] == [(1, 30, 3.0)]  # the second has no frame


def test_distance_columns():
    columns = ["Nose_speed", "nose_EarL_angle", "EarL_TailBase_dist", "Nose_TailEnd_dist", "nose_tailbase_dist"]
    assert find_distance(columns, ("nose",), ("tail",)) == "Nose_TailEnd_dist"
    assert find_distance(columns, ("tailbase", "tb"), ("NOSE",)) == "nose_tailbase_dist"
    assert find_distance(columns, ("nose",), ("hip",)) is None


def test_every_set_is_written(spark, pose, tmp_path):
    base = f"file://{tmp_path}/run"
    a = analysis(pose, names=["white", "black"], regions={"NoseNose": ([0], [0])})
    folder, names = sinks.write_set("main", a.makers(), base, "parquet")
    assert folder.endswith("run_main") and {"info", "tracking", "zones", "entropy", "first_order", "second_order", "engagement"} <= set(names)
    assert sinks.write_set("key_metrics", a.makers(), base)[1] == ["metrics", "per_second"]
    assert set(sinks.write_set("binned", a.makers(), base, "parquet")[1]) >= {"bins_025", "bins_1", "pair_bins_025"}
    back = spark.read.parquet(f"{folder}/second_order")
    assert back.count() == 120 and "pair" in back.columns
    # a forest of what is left of the bouts, over two classes at least
    forest = a.forest(folds=2, trees=5)
    if forest:
        assert set(sinks.write_set("forest", {"bouts": a.bout_table, **forest}, base)[1]) >= {"bouts", "report", "confusion"}
