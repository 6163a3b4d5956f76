"""The earlier rules on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from herdlens.functions.names import tail_end_nodes
from herdlens.operators import legacy as L

FPS, DSR = 10.0, 10.0  # spans of 8 frames before an onset; a body length is 20
POINTS = [f"{s}_{k}{a}" for s in "AB" for k in ("", "n", "h") for a in "xy"]


def frames_of(spark, moving, headings=(0.0, 0.0), n=12, gone=()):
    """One pair; moving: {column: (until frame 2, at frame 10)}, straight between; all else stays where it is put."""
    rows = []
    for f in range(n):
        row = {c: 500.0 for c in POINTS}
        for c, (a, b) in moving.items():
            row[c] = a + (b - a) * min(max(f - 2, 0), 8) / 8
        row |= {c: None for c in gone}
        rows.append(("s", f, 0, 1, *[row[c] for c in POINTS], *map(float, headings), DSR))
    return spark.createDataFrame(rows, "session string, sidx int, tA int, tB int, " + ", ".join(f"{c} double" for c in POINTS) + ", A_heading double, B_heading double, dsr double")


def bout(spark, start=10):
    return spark.createDataFrame([("s", 0, 1, 1, start, start + 3)], "session string, tA int, tB int, bout long, start int, end int")


def judged(spark, mode, moving, start=10, **how):
    return L.instigators(bout(spark, start), frames_of(spark, moving, **how), FPS, mode).first().instigator


def still(s, kind, x):
    return {f"{s}_{kind}x": (x, x), f"{s}_{kind}y": (0.0, 0.0)}


@pytest.mark.parametrize("mode", list(L.MODES))
def test_the_one_that_comes_instigates(spark, mode):
    own, other = L.MODES[mode]
    # A's point goes from 20 to 10 px of B's: 10 closer, 7.5 for the way, 5 for facing it, 2 for having come closer
    coming = {**still("A", other, 0.0), **still("B", own, 20.0), **still("B", other, 20.0), f"A_{own}x": (0.0, 10.0), f"A_{own}y": (0.0, 0.0)}
    assert judged(spark, mode, coming) == "A"
    back = {("B" if c[0] == "A" else "A") + c[1:]: v for c, v in coming.items()}
    assert judged(spark, mode, back) == "B"


def test_facing_counts_at_the_onset_and_distance_at_each_time(spark):
    # heads on one line, each 4 px nearer: 4 + 3 + 2 = 9 each, and 5 more for the one that faces the other
    both = {**still("A", "", 0.0), **still("B", "", 40.0), "A_x": (0.0, 4.0), "B_x": (40.0, 36.0)}
    # the way of each is 4, the gap shrinks by 8: 8 + 3 + 2 = 13, facing 18; 13 / 18 is under 85 %
    assert judged(spark, "proximity", both, headings=(0, 0)) == "A"
    assert judged(spark, "proximity", both, headings=(180, 180)) == "B"
    assert judged(spark, "proximity", both, headings=(0, 180)) == "Shared"  # 18 each
    # B walks off as A follows at the same pace: the gap doesn't shrink, though A has come nearer to where B was
    chased = {**still("A", "", 0.0), **still("B", "", 40.0), "A_x": (0.0, 2.0), "B_x": (40.0, 42.0)}
    # A: 0 + 1.5 + 5 = 6.5; B: 0 - 1.5 + 0: A alone is over 2.4
    assert judged(spark, "proximity", chased) == "A"
    assert judged(spark, "proximity", chased, headings=(90, 0)) == "Shared"  # 1.5 and -1.5 are both under 2.4


def test_short_spans_and_missing_places_are_shared(spark):
    coming = {**still("A", "", 0.0), **still("B", "", 20.0), "A_x": (0.0, 10.0)}
    assert judged(spark, "proximity", coming, start=1) == "Shared"
    assert judged(spark, "proximity", coming, gone=["B_x"]) == "Shared"
    assert judged(spark, "proximity", coming, start=99) == "A"  # the last frame stands for an onset beyond


NODES = 9


def pose_rows(order):
    """Two animals on a line, B's tail base at A's nose; node k of the plain order stands at place order[k]."""
    #        nose   ears          body  hips          base  middle  end
    ahead = [7.0, 5.0, 5.0, 0.0, -3.0, -3.0, -6.0, -9.0, -12.0]
    aside = [0.0, 2.0, -2.0, 0.0, 5.0, -5.0, 0.0, 0.0, 0.0]
    rows = []
    for f in range(30):
        for shift in (-13.5,):
            ax, bx = [a + shift + 0.01 * f for a in ahead], [a + 0.01 * f for a in ahead]
            put = lambda xs: [xs[order.index(j)] for j in range(NODES)]  # noqa: B023, E731
            rows.append(("s", f, 0, 1, put(ax), put(aside), put(bx), put(aside), 10.0))
    return rows


SCHEMA = "session string, sidx int, tA int, tB int, A_xs array<double>, A_ys array<double>, B_xs array<double>, B_ys array<double>, dsr double"


def test_sniffing_at_the_tail_base_and_roles_in_any_order(spark):
    flags = ["prox", "hh", "ho", "sniff", "touching"]
    found = []
    for order in (list(range(NODES)), [4, 8, 0, 6, 2, 1, 3, 7, 5]):
        roles = L.Roles(order[0], (order[1], order[2]), order[3], (order[7], order[8]), (order[4], order[5]))
        frames = spark.createDataFrame(pose_rows(order), SCHEMA)
        out = L.contacts(L.motion(frames, FPS, roles), 5, NODES, roles)
        found.append([tuple(r) for r in out.select("sidx", *flags).orderBy("sidx").collect()])
        scale = L.subject_scale(frames, roles).first()
        assert scale.dsr == 10.0 and scale.cm_per_px == pytest.approx(0.3)
        assert {round(r.nose_angle, 6) for r in L.nose_angle(frames, FPS, 0.5, roles).collect()} == {0.0}
        assert L.nose_angle(frames, FPS, 0.5, roles).agg(F.min("sidx")).first()[0] == 5
    assert found[0] == found[1] and found[0][10][4] == 1  # the nose is 0.5 px from the tail's base
    middle = L.Roles(0, (1, 2), 3, (6, 7, 8))  # where the base counts as tail nobody sniffs
    out = L.contacts(L.motion(spark.createDataFrame(pose_rows(list(range(NODES))), SCHEMA), FPS, middle), 5, NODES, middle)
    assert out.agg(F.max("sniff")).first()[0] == 0
    assert tail_end_nodes(["nose", "TailBase", "TailMid1", "TailEnd"], middle=True) == [2, 3]


def test_missing_hips_give_no_scale(spark):
    rows = pose_rows(list(range(NODES)))
    rows[3][4][4] = None
    assert L.subject_scale(spark.createDataFrame(rows, SCHEMA)).first().dsr is None


def test_swapped_roles_swap_results(spark):
    frames = spark.createDataFrame(pose_rows(list(range(NODES))), SCHEMA)
    swapped = L.as_subject(frames, F.col("tA") == 0)
    row = swapped.first()
    assert (row.tA, row.tB) == (1, 0) and row.A_xs == frames.first().B_xs
    assert L.as_subject(swapped, F.lit(True)).collect() == frames.collect()
    assert L.as_subject(frames, F.col("session") == "another").collect() == frames.collect()
    sniffs = lambda df: L.contacts(L.motion(df, FPS), 5, NODES).agg(F.max("sniff")).first()[0]
    assert (sniffs(frames), sniffs(swapped)) == (1, 0)  # B turns its back on A
