"""Pair-grain queries: distances, features, behaviours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import geometry as G
from ..operators import behaviours as B
from ..operators import bouts as T
from ..operators import labels as N
from ..operators import runs as R
from ..operators import pairs as P
from ..operators import pose as O
from ..storage import stored
from . import query
from .fixtures import FPS, NODES, PAIR_SQL, POSE_SQL, STAGED_SQL, node_pairs, pairs, pose, rounded, staged
from .pose import savgol_sql
from .runs import bouts_sql, fill_sql

KEYS = ["session", "sidx", "tA", "tB"]
OPP = "case when abs({0} - {1}) % 360 > 180 then 360 - abs({0} - {1}) % 360 else abs({0} - {1}) % 360 end"
TO_B, TO_A = 'degrees(atan2("B_y" - "A_y", "B_x" - "A_x"))', 'degrees(atan2("A_y" - "B_y", "A_x" - "B_x"))'


@query(
    "with " + PAIR_SQL + f""", g as (select *, sqrt(("B_x" - "A_x") * ("B_x" - "A_x") + ("B_y" - "A_y") * ("B_y" - "A_y")) d, {OPP.format('"A_heading"', '"B_heading"')} opp, {OPP.format('"A_heading"', TO_B)} fe, cos(radians("A_heading")) c, sin(radians("A_heading")) s from pair),
f as (select *, ("B_x" - "A_x") * c + ("B_y" - "A_y") * s lon, ("B_y" - "A_y") * c - ("B_x" - "A_x") * s lat from g)
select session, sidx, "tA", "tB", round(d, 4) d, round(opp, 4) opposition, round(fe, 4) face_error, round(lon, 4) + 0.0 along, round(lat, 4) + 0.0 across,
  case when abs(lat) > abs(lon) then (case when lat > 0 then 'Left' else 'Right' end) else (case when lon >= 0 then 'Front' else 'Behind' end) end position,
  case when fe < 20 then 'Binocular' when fe < 120 then 'Monocular' else 'None' end visual, case when fe < 60 then 'Binaural' when fe < 150 then 'Monaural' else 'Rear' end auditory from f"""
)
def pair_angles(spark, sf_dir):
    c, df = F.col, pairs(spark, sf_dir)
    dx, dy = c("B_x") - c("A_x"), c("B_y") - c("A_y")
    lon, lat = G.body_frame(dx, dy, c("A_heading"))
    fe = A.face_error(c("A_heading"), dx, dy)
    out = df.select(
        *KEYS, G.distance(c("A_x"), c("A_y"), c("B_x"), c("B_y")).alias("d"), A.opposition(c("A_heading"), c("B_heading")).alias("opposition"), fe.alias("face_error"), lon.alias("along"), lat.alias("across"),
        G.relative_position(lon, lat).alias("position"), G.visual_scope(fe).alias("visual"), G.auditory_scope(fe).alias("auditory"),
    )
    return rounded(out, KEYS)


_GRAD = "(case when lag(sidx) over w is null and lead(sidx) over w is null then 0 when lag(sidx) over w is null then lead({0}) over w - {0} when lead(sidx) over w is null then {0} - lag({0}) over w else (lead({0}) over w - lag({0}) over w) / 2 end)"


@query(
    "with " + PAIR_SQL + f""", v as (select *, sqrt(("B_x" - "A_x") * ("B_x" - "A_x") + ("B_y" - "A_y") * ("B_y" - "A_y")) d, {_GRAD.format('"A_x"')} ax, {_GRAD.format('"A_y"')} ay, {_GRAD.format('"B_x"')} bx, {_GRAD.format('"B_y"')} by_,
  "A_speed" - avg("A_speed") over p ca, "B_speed" - avg("B_speed") over p cb, stddev_pop("A_speed") over p * stddev_pop("B_speed") over p sp
  from pair window w as (partition by session, "tA", "tB" order by sidx), p as (partition by session, "tA", "tB"))
select session, sidx, "tA", "tB", round(d, 4) inter_dist, round(d - coalesce(lag(d) over (partition by session, "tA", "tB" order by sidx), d), 4) + 0.0 inter_disp,
  round({OPP.format('"A_heading"', TO_B)}, 4) "angle_AtoB", round({OPP.format('"B_heading"', TO_A)}, 4) "angle_BtoA",
  round(case when sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_) > 1e-12 then (ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_)) else 0 end, 4) + 0.0 cos_sim,
  round(ca * cb, 1) + 0.0 speed_cov, round(case when sp > 1e-12 then ca * cb / sp else 0 end, 4) + 0.0 speed_corr from v"""
)
def pair_features(spark, sf_dir):
    out = P.features(pairs(spark, sf_dir))
    r = lambda n, d=4: (F.round(n, d) + 0.0).alias(n)
    return out.select(*KEYS, r("inter_dist"), r("inter_disp"), r("angle_AtoB"), r("angle_BtoA"), r("cos_sim"), r("speed_cov", 1), r("speed_corr"))


_NAMES = "[" + ", ".join(f"'{n}'" for n in NODES) + "]"
_CROSS = POSE_SQL + """,
x as (select a.session, a.sidx, a.track "tA", b.track "tB", a.node i, b.node j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d from pose a join pose b on a.session = b.session and a.sidx = b.sidx and a.track < b.track)"""


@query(
    "with " + _CROSS + f""", r as (select *, row_number() over (partition by session, sidx, "tA", "tB" order by d, i, j) r from x where i <> 7 and j <> 7),
m as (select session, sidx, "tA", "tB", min(d) contact, min(d) filter (i = 0 and j = 0) nn, min(d) filter ((i in (0, 1, 2) and j in (6, 7)) or (i in (6, 7) and j in (0, 1, 2))) ht from x group by 1, 2, 3, 4),
s as (select session, sidx, "tA", "tB", j nearest_node, d nearest_dist, row_number() over (partition by session, sidx, "tA", "tB" order by d, j) k from x where i = 0 and j <> 7)
select session, sidx, "tA", "tB", round(r.d, 4) min_dist, {_NAMES}[r.i + 1] || '-' || {_NAMES}[r.j + 1] closest, round(contact, 4) contact, round(nn, 4) nose_nose, round(ht, 4) head_tail, s.nearest_node, round(s.nearest_dist, 4) nearest_dist
from r join m using (session, sidx, "tA", "tB") join s using (session, sidx, "tA", "tB") where r.r = 1 and s.k = 1"""
)
def node_distances(spark, sf_dir):
    df = node_pairs(spark, sf_dir)
    d, label = P.min_distance(NODES, exclude=[7])
    near = P.nearest_node("A", "B", 0, list(range(7)))
    out = df.select(*KEYS, d.alias("min_dist"), label.alias("closest"), P.contact_distance().alias("contact"), P.region_distance([0], [0]).alias("nose_nose"), P.region_distance([0, 1, 2], [6, 7]).alias("head_tail"), near["j"].cast("int").alias("nearest_node"), near["d"].alias("nearest_dist"))
    return rounded(out, KEYS)


def scaled(spark, sf_dir, factor: float = 0.25, source=pose) -> DataFrame:
    """Pair frames with node arrays, headings, motion and a share of the body scale."""
    p = source(spark, sf_dir)
    c = F.col
    wide = O.nodes_wide(p, {n: i for i, n in enumerate(NODES)})
    heading = A.bearing(c("nose_x") - c("body_x"), c("nose_y") - c("body_y"))
    motion = O.kinematics(p.where("node = 3"), FPS).select("session", "sidx", "track", "vx", "vy", "speed", "accel", "jerk")
    animal = O.node_arrays(p, len(NODES)).join(wide.select("session", "sidx", "track", heading.alias("heading")), ["session", "sidx", "track"]).join(motion, ["session", "sidx", "track"])
    animal = animal.withColumn("av", O.angular_velocity(c("heading"), FPS))
    scale = O.body_scale(wide).withColumn("dsr", c("dsr") * factor)
    return P.pairs(animal, ["xs", "ys", "heading", "vx", "vy", "speed", "accel", "jerk", "av"]).join(scale, "session")


_KEYS_SQL = 'session, "tA", "tB"'


def _fills(source: str, flags: dict[str, int]) -> tuple[str, str]:
    """CTEs that bridge the flags' gaps one after the other, and the last one's name."""
    steps, at = [], source
    for n, (name, gap) in enumerate(flags.items()):
        steps.append(fill_sql(name, gap, at, f"{source}_{n}", _KEYS_SQL, "sidx"))
        at = f"{source}_{n}"
    return ",\n".join(steps), at


#: After a pose: to be formatted with the body scale's factor.
_FIRST = (
    """,
w as (select session, sidx, track, """ + ", ".join(f"max(case when node = {i} then {c} end) {c}{i}" for i in range(8) for c in "xy") + """ from pose group by 1, 2, 3),
h as (select *, degrees(atan2(y0 - y3, x0 - x3)) hd, (x1 + x2) / 2 hx, (y1 + y2) / 2 hy from w),
hip as (select session, track, sqrt((x4 - x5) * (x4 - x5) + (y4 - y5) * (y4 - y5)) d from w), band as (select session, track, quantile_cont(d, 0.2) lo, quantile_cont(d, 0.8) hi from hip group by 1, 2),
scale as (select session, {factor} * avg(m) dsr from (select session, track, quantile_cont(d, 0.5) m from hip join band using (session, track) where d between lo and hi group by 1, 2) group by 1),
cross_ as (select a.session, a.sidx, a.track "tA", b.track "tB", a.node i, b.node j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d, a.x ax, a.y ay, b.x bx, b.y by_ from pose a join pose b on a.session = b.session and a.sidx = b.sidx and a.track < b.track),
closest as (select session, sidx, "tA", "tB", min(d) contact, arg_min({{'d': d, 'x': bx, 'y': by_}}, {{'d': d, 'j': j}}) filter (i = 0 and j <> 7) na, arg_min({{'d': d, 'x': ax, 'y': ay}}, {{'d': d, 'j': i}}) filter (j = 0 and i <> 7) nb from cross_ group by 1, 2, 3, 4),
f as (select a.session, a.sidx, a.track "tA", b.track "tB", dsr, contact, na, nb, a.hd ha, b.hd hb, a.x3 ax, a.y3 ay, b.x3 bx, b.y3 by_,
  sqrt((a.x3 - b.x3) ** 2 + (a.y3 - b.y3) ** 2) d, sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) nn, sqrt((a.hx - b.hx) ** 2 + (a.hy - b.hy) ** 2) hh, sqrt((a.x0 - b.hx) ** 2 + (a.y0 - b.hy) ** 2) nha, sqrt((b.x0 - a.hx) ** 2 + (b.y0 - a.hy) ** 2) nhb,
  sqrt((a.x0 - b.x6) ** 2 + (a.y0 - b.y6) ** 2) nra, sqrt((b.x0 - a.x6) ** 2 + (b.y0 - a.y6) ** 2) nrb, sqrt((a.x0 - b.x3) ** 2 + (a.y0 - b.y3) ** 2) nba, sqrt((b.x0 - a.x3) ** 2 + (b.y0 - a.y3) ** 2) nbb, """ + OPP.format("a.hd", "b.hd") + " opp, " + OPP.format("a.hd", "degrees(atan2(b.y3 - a.y3, b.x3 - a.x3))") + " fa, " + OPP.format("b.hd", "degrees(atan2(a.y3 - b.y3, a.x3 - b.x3))") + """ fb
  from h a join h b on a.session = b.session and a.sidx = b.sidx and a.track < b.track join scale s on s.session = a.session join closest c on c.session = a.session and c.sidx = a.sidx and c."tA" = a.track and c."tB" = b.track),
g as (select session, sidx, "tA", "tB", dsr, ax a_x, ay a_y, bx b_x, by_ b_y, ha a_h, hb b_h, d, opp, fa a_fe, fb b_fe, (nn < 0.5 * dsr)::int NoseNose, ((hh < 0.85 * dsr or least(nha, nhb) < 0.9 * dsr) and fa < 70 and fb < 70 and opp > 60)::int HH, (nn < 0.55 * dsr and fa < 45 and fb < 45 and opp > 120)::int HO,
  (contact < 0.25 * dsr)::int Contact, (opp < 30)::int CoOriented, (opp > 150)::int AntiOriented, (d < 3 * dsr and fa < 60 and fb < 60)::int Engaged, (nha < 0.7 * dsr)::int NoseHead_AtoB, (nhb < 0.7 * dsr)::int NoseHead_BtoA, (nba < 0.7 * dsr)::int NoseBody_AtoB, (nbb < 0.7 * dsr)::int NoseBody_BtoA, (nra < 0.7 * dsr)::int NoseRear_AtoB, (nrb < 0.7 * dsr)::int NoseRear_BtoA,
  (na.d < 0.7 * dsr and """ + OPP.format("ha", "degrees(atan2(na.y - ay, na.x - ax))") + " < 90)::int Sniff_AtoB, (nb.d < 0.7 * dsr and " + OPP.format("hb", "degrees(atan2(nb.y - by_, nb.x - bx))") + " < 90)::int Sniff_BtoA from f),\n"
    + _fills("g", {"HH": 1, "HO": 1, "Sniff_AtoB": 1, "Sniff_BtoA": 1, "Engaged": 3})[0]
)
_FIRST_FLAGS = ["NoseNose", "HH", "HO", "Contact", "CoOriented", "AntiOriented", "Engaged", *[f"{n}_{d}" for n in ("NoseHead", "NoseBody", "NoseRear", "Sniff") for d in ("AtoB", "BtoA")]]


@query("with " + POSE_SQL + _FIRST.format(factor=0.25) + f" select session, sidx, \"tA\", \"tB\", {', '.join(_FIRST_FLAGS)} from g_4")
def first_order_behaviours(spark, sf_dir):
    return B.first_order(scaled(spark, sf_dir), FPS, len(NODES)).select(*KEYS, *_FIRST_FLAGS)


SECOND = B.SECOND_FLAGS


def all_behaviours(spark, sf_dir) -> DataFrame:
    first = B.first_order(scaled(spark, sf_dir, 1.0, staged), FPS, len(NODES))
    return B.second_order(first, FPS)


_ON_PAIR = f"partition by {_KEYS_SQL} order by sidx"
_WRAP = "(({0}) + 180 - 360 * floor((({0}) + 180) / 360) - 180)"


def _gated(flag: str, condition: str, gap: int, passes: str | None, source: str) -> tuple[str, str]:
    """CTEs for a behaviour: the condition, gaps bridged and, if asked for, bouts kept that pass in their first frames."""
    steps = [f"{flag}_r as (select *, coalesce({condition}, false)::int {flag} from {source})", fill_sql(flag, gap, f"{flag}_r", f"{flag}_f", _KEYS_SQL, "sidx")]
    if passes is None:
        return ",\n".join(steps), f"{flag}_f"
    steps += [
        f"{flag}_c as (select *, coalesce(({flag} <> lag({flag}) over ({_ON_PAIR}))::int, 1) ch from {flag}_f)",
        f"{flag}_n as (select *, sum(ch) over ({_ON_PAIR}) rn from {flag}_c)",
        f"{flag}_p as (select *, row_number() over (partition by {_KEYS_SQL}, rn order by sidx) pos from {flag}_n)",
        f"{flag}_g as (select * exclude ({flag}, ch, rn, pos), ({flag} = 1 and max((pos <= 3 and {passes})::int) over (partition by {_KEYS_SQL}, rn) = 1)::int {flag} from {flag}_p)",
    ]
    return ",\n".join(steps), f"{flag}_g"


def _any(*names: str) -> str:
    return "(" + " or ".join(f"{n} = 1" for n in names) + ")"


def _second_sql() -> tuple[str, str]:
    """CTEs from the pose to all behaviours, and the last one's name."""
    half, short, recent = 2, 3, 8  # at ten frames a second
    sides = (("a", "b", "AtoB"), ("b", "a", "BtoA"))
    kin = ", ".join(f"{savgol_sql(c, 5, 3, d, FPS)} {n}{c}" for d, n in ((1, "v"), (2, "a"), (3, "j")) for c in "xy")
    of = lambda side: ", ".join(f"{side}k.{c} {side}_{c}" for c in ("vx", "vy", "speed", "accel", "jerk")) + f", {side}k.av {side}_av"
    ctes = [
        STAGED_SQL + _FIRST.format(factor=1.0),
        "q as (select *, row_number() over (partition by session, track order by sidx) - 1 pos, count(*) over (partition by session, track) n from pose where node = 3)",
        f"k0 as (select session, sidx, track, {kin} from q window w as (partition by session, track order by sidx))",
        f"""kin as (select session, sidx, track, vx, vy, sqrt(vx * vx + vy * vy) speed, sqrt(ax * ax + ay * ay) accel, sqrt(jx * jx + jy * jy) jerk,
  {FPS} * coalesce(case when lag(hd) over w is null then {_WRAP.format("lead(hd) over w - hd")} else {_WRAP.format("hd - lag(hd) over w")} end, 0) av
  from k0 join h using (session, sidx, track) window w as (partition by session, track order by sidx))""",
        f'pf as (select g_4.*, {of("a")}, {of("b")} from g_4 join kin ak on ak.session = g_4.session and ak.sidx = g_4.sidx and ak.track = "tA" join kin bk on bk.session = g_4.session and bk.sidx = g_4.sidx and bk.track = "tB")',
        "s1 as (select session, \"tA\", \"tB\", " + ", ".join(f"quantile_cont({s}_speed, 0.1) {s}_p10, quantile_cont({s}_speed, 0.5) {s}_med, quantile_cont({s}_accel, 0.5) {s}_acc_med, quantile_cont({s}_accel, 0.8) {s}_acc_p80, quantile_cont({s}_jerk, 0.5) {s}_jerk_med, quantile_cont({s}_jerk, 0.9) {s}_jerk_p90" for s in "ab") + " from pf group by all)",
        "s2 as (select session, \"tA\", \"tB\", " + ", ".join([f"coalesce(quantile_cont({s}_speed, {q}) filter ({s}_speed > {s}_p10), quantile_cont({s}_speed, {q})) {s}_p{round(100 * q)}" for s in "ab" for q in (0.35, 0.7, 0.75, 0.95)] + [f"quantile_cont(abs({s}_speed - {s}_med), 0.5) {s}_mad, quantile_cont(abs({s}_accel - {s}_acc_med), 0.5) {s}_acc_mad" for s in "ab"]) + ' from pf join s1 using (session, "tA", "tB") group by all)',
        f"""m0 as (select *, (d - coalesce(lag(d) over w, d)) / 2 gap, coalesce(stddev_samp(d) over ({_ON_PAIR} rows between {short} preceding and {short} following), 0) gap_std, """ + ", ".join(f"sqrt(({s}_x - coalesce(lag({s}_x) over w, {s}_x)) ** 2 + ({s}_y - coalesce(lag({s}_y) over w, {s}_y)) ** 2) {s}_step" for s in "ab") + f' from pf join s1 using (session, "tA", "tB") join s2 using (session, "tA", "tB") window w as ({_ON_PAIR}))',
        "m1 as (select *, " + ", ".join(f"sum({s}_step) over r {s}_path, sqrt((last_value({s}_x) over r - first_value({s}_x) over r) ** 2 + (last_value({s}_y) over r - first_value({s}_y) over r) ** 2) {s}_disp" for s in "ab") + f" from m0 window r as ({_ON_PAIR} rows between {half} preceding and {half} following))",
    ]
    motion = ["case when sqrt(a_vx ** 2 + a_vy ** 2) * sqrt(b_vx ** 2 + b_vy ** 2) > 1e-12 then (a_vx * b_vx + a_vy * b_vy) / (sqrt(a_vx ** 2 + a_vy ** 2) * sqrt(b_vx ** 2 + b_vy ** 2)) else 0 end cos_v", f"{_any('Contact', 'Sniff_AtoB', 'Sniff_BtoA', 'HH', 'HO')}::int touching"]
    for s, t, _ in sides:
        dx, dy = f"({t}_x - {s}_x)", f"({t}_y - {s}_y)"
        to = f"({s}_vx * {dx} + {s}_vy * {dy}) / case when d < 1e-12 then 1 else d end"
        motion += [f"case when {s}_path <= 1e-12 then 0 else least(1, {s}_disp / {s}_path) end {s}_pe", f"-{dx} * cos(radians({t}_h)) - {dy} * sin(radians({t}_h)) {s}_along", f"{dx} * sin(radians({t}_h)) - {dy} * cos(radians({t}_h)) {s}_across", f"{to} {s}_towards", f"-({to}) {s}_away"]
    close = ["Engaged", "Contact", "NoseNose", "NoseHead_AtoB", "NoseHead_BtoA", "HH", "HO", "Sniff_AtoB", "Sniff_BtoA"]
    closer = [*close, "NoseBody_AtoB", "NoseBody_BtoA", "NoseRear_AtoB", "NoseRear_BtoA"]
    ctes += [f"m2 as (select *, {', '.join(motion)}, {_any(*closer)}::int social from m1)", f"m3 as (select *, max(social) over ({_ON_PAIR} rows between {recent - 1} preceding and current row) recent from m2)"]
    at = "m3"

    def detect(name, condition, gap, passes=None):
        nonlocal at
        for s, t, st in sides:
            cte, at = _gated(f"{name}_{st}", condition(s, t, st), gap, passes and passes(s), at)
            ctes.append(cte)

    detect("Follow", lambda s, t, st: f"d between 0.8 * dsr and 3.5 * dsr and (gap < -0.15 * dsr or gap_std < 0.25 * dsr) and {s}_along < -0.2 * dsr and abs({s}_across) < dsr and opp < 55 and {s}_fe < 50 and cos_v > 0.65 and {s}_speed > {s}_p35 and {t}_speed > {s}_p35 and abs({s}_av) < 120 and touching = 0 and {s}_pe > 0.5", 2, lambda s: f"{s}_speed > {s}_med")
    detect("Flee", lambda s, t, st: f"gap > 0.3 * dsr and {s}_fe > 130 and {s}_speed > greatest({s}_med + 2 * {s}_mad, {s}_p75) and {s}_away > 0.2 * dsr and d < 3.5 * dsr and recent = 1", 1, lambda s: f"({s}_jerk > {s}_jerk_p90 or {s}_accel > {s}_acc_p80)")
    detect("PassiveAvoid", lambda s, t, st: f"{s}_fe > 120 and {s}_disp < 0.2 * dsr and {s}_speed < {s}_med + 0.25 * {s}_mad and gap > -0.05 * dsr and d < 3 * dsr and recent = 1 and {s}_accel < {s}_acc_med", 2)
    detect("Chase", lambda s, t, st: f"d between 0.7 * dsr and 3 * dsr and (gap < -0.2 * dsr or gap_std < 0.3 * dsr) and {s}_along < -0.15 * dsr and abs({s}_across) < 1.2 * dsr and opp < 50 and {s}_fe < 45 and cos_v > 0.7 and {s}_speed > 0.95 * {t}_speed and {s}_speed > {s}_p70 and abs({s}_av) < 140 and Follow_{st} = 0 and {s}_pe > 0.7", 1, lambda s: f"{s}_accel >= {s}_acc_med + {s}_acc_mad")
    detect("ActiveAvoid", lambda s, t, st: f"gap > 0.2 * dsr and {s}_fe > 120 and {s}_speed > {s}_med + 1.5 * {s}_mad and {s}_away > 0.15 * dsr and d < 4 * dsr and recent = 1 and Contact = 0 and Flee_{st} = 0", 1, lambda s: f"{s}_accel > {s}_acc_med")
    detect("Approach", lambda s, t, st: f"d between dsr and 5 * dsr and gap < -0.18 * dsr and {s}_fe < 55 and {s}_towards > 0.12 * dsr and {s}_speed between {s}_p35 and {s}_p95 and Contact = 0 and Follow_{st} = 0 and Chase_{st} = 0 and Flee_{st} = 0 and {s}_pe > 0.6", 1, lambda s: f"{s}_towards > 0.05 * dsr")
    both = lambda *names: [f"{n}_{st}" for n in names for _, _, st in sides]
    still = " and ".join(f"{s}_speed < {s}_med + 0.15 * {s}_mad and {s}_disp < 0.2 * dsr and {s}_accel < {s}_acc_med and {s}_jerk < {s}_jerk_med + {s}_mad" for s in "ab")
    cte, at = _gated("StationaryProx", f"{still} and d < 2.5 * dsr and Contact = 0 and not {_any(*both('Follow', 'Chase', 'ActiveAvoid', 'Flee'))}", 2, None, at)
    orient = ", ".join(f"({s}_fe < case when {s}_speed > {s}_p35 then 65 else 45 end and d < 5 * dsr and Flee_{st} = 0 and ActiveAvoid_{st} = 0)::int SocialOrient_{st}" for s, _, st in sides)
    ctes += [cte, f"o1 as (select *, {orient} from {at})"]
    ctes.append(f"o2 as (select *, {_any('Contact', 'Sniff_AtoB', 'Sniff_BtoA', *both('Follow', 'Chase', 'Approach'))}::int active, max({_any(*close, *both('Approach', 'Follow', 'Chase', 'SocialOrient'))}::int) over ({_ON_PAIR} rows between {recent - 1} preceding and current row) was_social from o1)")
    slow, steady = ([f"{s}_{x} < {s}_{m} + {k} * {s}_{e}" for s in "ab"] for x, m, k, e in (("speed", "med", 0.5, "mad"), ("accel", "acc_med", 1.5, "acc_mad")))
    cte, at = _gated("Disengaged", f"was_social = 1 and (a_fe > 95 or b_fe > 95) and not {_any(*both('Flee'))} and active = 0 and (gap > 0.05 * dsr or ({' and '.join(slow)}) or a_away > 0.03 * dsr or b_away > 0.03 * dsr) and d < 4 * dsr and ({' or '.join(steady)})", 2, None, "o2")
    attention = ", ".join(f"({s}_fe < {deg})::int {n}_{st}" for n, deg in (("VisualAttn", 120), ("AuditoryAttn", 150)) for s, _, st in sides)
    ctes += [cte, f"detected as (select *, {attention} from {at})"]
    return ",\n".join(ctes), "detected"


SECOND_SQL = _second_sql()[0]


@query("with " + SECOND_SQL + f' select session, sidx, "tA", "tB", {", ".join(SECOND)} from detected')
def second_order_behaviours(spark, sf_dir):
    return all_behaviours(spark, sf_dir).select(*KEYS, *SECOND)


_STATS = """with s as (select session, "tA", "tB", quantile_cont("A_speed", 0.1) p10, quantile_cont("A_speed", 0.5) med from pair group by 1, 2, 3)
select session, "tA", "tB", round(quantile_cont("A_speed", 0.35) filter ("A_speed" > p10), 3) p35, round(quantile_cont("A_speed", 0.95) filter ("A_speed" > p10), 3) p95, round(any_value(med), 3) med, round(quantile_cont(abs("A_speed" - med), 0.5), 3) mad
from pair join s using (session, "tA", "tB") group by 1, 2, 3"""


@query("with " + PAIR_SQL + ", " + _STATS.removeprefix("with "))
def session_statistics(spark, sf_dir):
    df = pairs(spark, sf_dir).withColumns({f"{s}_{n}": F.col(f"{s}_speed") for s in "AB" for n in ("accel", "jerk")})
    out = B.session_statistics(df)
    return out.select("session", "tA", "tB", *[F.round(f"A_{n}", 3).alias(n) for n in ("p35", "p95", "med", "mad")])


_TRACKS, _CALLED = [0, 1, 2, 3], ["ash", "birch", "cedar"]
_LABEL = {t: (_CALLED[t] if t < len(_CALLED) else f"t{t}") for t in _TRACKS}


def _wide_sql(source: str, flags) -> str:
    columns = ", ".join(f"max({f}) filter (\"tA\" = {a} and \"tB\" = {b}) as \"{_LABEL[a]}_vs_{_LABEL[b]}/{f}\"" for a in _TRACKS for b in _TRACKS if a < b for f in flags)
    return f"select session, sidx, {columns} from {source} group by 1, 2"


@query("with " + POSE_SQL + _FIRST.format(factor=0.25) + " " + _wide_sql("g_4", _FIRST_FLAGS))
def first_order_wide(spark, sf_dir):
    """One row a frame, a column for each pair's behaviours, by the animals' names (the fourth has none)."""
    frames = B.first_order(scaled(spark, sf_dir), FPS, len(NODES))
    return N.wide(frames, ["session", "sidx"], N.pair_subjects(_TRACKS, _CALLED), _FIRST_FLAGS)


@query("with " + SECOND_SQL + " " + _wide_sql("detected", SECOND))
def second_order_wide(spark, sf_dir):
    return N.wide(all_behaviours(spark, sf_dir), ["session", "sidx"], N.pair_subjects(_TRACKS, _CALLED), SECOND)


#: A data row is shown by one to three video frames, two frames apart; every seventh by none. Rows come late in the video.
_MAP_SQL = "frame_map as (select session, 10 + 6 * sidx + 2 * k vframe, sidx from (select distinct session, sidx from pose), range(3) r(k) where k <= sidx % 3 and sidx % 7 <> 0)"


@query(
    "with " + POSE_SQL + _FIRST.format(factor=0.25) + ",\n" + bouts_sql("Engaged", "g_4", "eb", _KEYS_SQL, "sidx") + ",\n" + _MAP_SQL + f""",
first_ as (select session, sidx, min(vframe) vframe from frame_map group by 1, 2)
select eb.session, "tA", "tB", case "tA" when 0 then 'ash' when 1 then 'birch' when 2 then 'cedar' else 't' || "tA" end || ' vs ' || case "tB" when 0 then 'ash' when 1 then 'birch' when 2 then 'cedar' else 't' || "tB" end pair,
  bout::bigint bout, s::int as "start", e::int as "end", vframe::bigint vframe, round(vframe / {FPS}, 4) onset_s from eb join first_ on first_.session = eb.session and first_.sidx = s"""
)
def bout_onsets_in_video(spark, sf_dir):
    """When bouts of engagement begin in the video, of sparse recordings."""
    p = pose(spark, sf_dir)
    shown = p.select("session", "sidx").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("k <= sidx % 3 and sidx % 7 <> 0")
    frame_map = shown.select("session", (10 + 6 * F.col("sidx") + 2 * F.col("k")).cast("long").alias("vframe"), "sidx")
    found = R.bouts(B.first_order(scaled(spark, sf_dir), FPS, len(NODES)), "Engaged", ["session", "tA", "tB"], "sidx")
    out = N.labelled(T.with_video_time(found, frame_map, FPS), _CALLED)
    return out.select("session", "tA", "tB", "pair", "bout", "start", "end", "vframe", F.round("onset_s", 4).alias("onset_s"))


@query("with " + POSE_SQL + _FIRST.format(factor=0.25).split(",\ncross_ as")[0] + f""", p as (select a.session, floor(a.sidx / {FPS})::bigint as second, a.track "tA", b.track "tB", {OPP.format("a.hd", "b.hd")} o from h a join h b on a.session = b.session and a.sidx = b.sidx and a.track < b.track)
select session, "tA", "tB", second, round(avg(o), 4) delta_heading, count(*) frames from p group by 1, 2, 3, 4""")
def per_second_headings(spark, sf_dir):
    """The mean difference of two animals' headings in each second."""
    df = scaled(spark, sf_dir).withColumn("delta_heading", A.opposition(F.col("A_heading"), F.col("B_heading")))
    per = df.groupBy("session", "tA", "tB", F.floor(F.col("sidx") / FPS).alias("second")).agg(F.avg("delta_heading").alias("delta_heading"), F.count("*").alias("frames"))
    return per.select("session", "tA", "tB", "second", F.round("delta_heading", 4).alias("delta_heading"), "frames")


@query(
    "with " + STAGED_SQL + _FIRST.format(factor=0.5) + ",\npx as (select *, (d <= 3 * dsr)::int near from g_4),\n" + bouts_sql("Contact", "px", "cb", _KEYS_SQL, "sidx") + ",\n" + bouts_sql("near", "px", "nb", _KEYS_SQL, "sidx") + """
select p.session, p.sidx, p."tA", p."tB", case when c.s is not null then 'contact' when n.s is not null then 'proximity' end kind, coalesce(c.s, n.s)::int as "start", case when c.s is not null then c.e else n.e end::int as "end" from px p
  left join cb c on c.session = p.session and c."tA" = p."tA" and c."tB" = p."tB" and p.sidx between c.s and c.e left join nb n on n.session = p.session and n."tA" = p."tA" and n."tB" = p."tB" and p.sidx between n.s and n.e"""
)
def active_bouts(spark, sf_dir):
    """The bout that each frame is in: contact before proximity."""
    keys = ["session", "tA", "tB"]
    frames = B.first_order(scaled(spark, sf_dir, 0.5, staged), FPS, len(NODES)).withColumn("near", (F.col("d") <= 3 * F.col("dsr")).cast("int"))
    frames = stored(frames.select(*KEYS, "Contact", "near"), "contact-frames")
    return T.active(frames, {"contact": R.bouts(frames, "Contact", keys, "sidx"), "proximity": R.bouts(frames, "near", keys, "sidx")}).select(*KEYS, "kind", "start", "end")
