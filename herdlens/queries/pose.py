"""Animal-grain queries: scans, kinematics, shapes, windows, repair, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import pose as O
from ..operators import windows as W
from ..operators.windows import savgol_taps
from . import query
from .fixtures import FPS, MOVING_SQL, NODES, POSE_SQL, PX_PER_CM, ROI, STRIP, WIDE_SQL, animals, moving, pose, rounded, wide

X0, Y0, X1, Y1 = ROI


def savgol_sql(col: str, width: int, poly: int, deriv: int, rate: float) -> str:
    taps, half = savgol_taps(width, poly, deriv, rate), width // 2

    def at(p):
        return " + ".join(f"({taps[p][k]!r}) * {'lead' if k >= p else 'lag'}({col}, {abs(k - p)}) over w" for k in range(width))

    ends = "".join(f" when pos = {p} then {at(p)} when pos = n - 1 - {p} then {at(width - 1 - p)}" for p in range(half))
    return f"case{ends} else {at(half)} end"


@query("with " + POSE_SQL + " select session, count(*) n_points, (count(*) filter (x is null or isnan(x)) + count(*) filter (y is null or isnan(y)))::bigint n_missing, count(distinct track)::bigint n_tracks, count(distinct node)::bigint n_nodes, max(sidx)::int last_sidx, round(sum(x), 2) sum_x from pose group by session")
def pose_scan(spark, sf_dir):
    bad = lambda c: (F.col(c).isNull() | F.isnan(c)).cast("long")
    return pose(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n_points"), (F.sum(bad("x")) + F.sum(bad("y"))).alias("n_missing"), F.countDistinct("track").alias("n_tracks"), F.countDistinct("node").alias("n_nodes"), F.max("sidx").alias("last_sidx"), F.round(F.sum("x"), 2).alias("sum_x"))


@query("with " + POSE_SQL + f", m as (select session, vec_id % 250 sidx, vec_id % 250 * 2 vframe from (select 's' || (vec_id // 250) session, vec_id from embeddings) where vec_id % 3 <> 1) select p.session, (p.sidx - {int(2 * FPS)})::int sidx, m.vframe::bigint vframe, track, node, round(x, 4) x, round(y, 4) y from pose p join m on p.session = m.session and p.sidx = m.sidx where p.sidx >= {int(2 * FPS)}")
def pose_trim_and_video_frames(spark, sf_dir):
    p = pose(spark, sf_dir)
    frame_map = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 3 <> 1").select(F.concat(F.lit("s"), F.floor(F.col("vec_id") / 250).cast("string")).alias("session"), (F.col("vec_id") % 250 * 2).alias("vframe"), (F.col("vec_id") % 250).cast("int").alias("sidx"))
    frame_map = frame_map.where(F.col("sidx") >= int(2 * FPS)).withColumn("sidx", F.col("sidx") - int(2 * FPS))
    return rounded(O.with_video_frames(O.trim(O.clean(p), FPS, 2.0), frame_map), ["session", "sidx", "vframe", "track", "node"])


_KIN = ", ".join(f"{savgol_sql(c, 5, 3, d, FPS)} {n}{c}" for d, n in ((1, "v"), (2, "a"), (3, "j")) for c in "xy")


@query(
    "with " + POSE_SQL + ", q as (select *, row_number() over (partition by session, track, node order by sidx) - 1 pos, count(*) over (partition by session, track, node) n from pose), "
    f"k as (select session, sidx, track, node, {_KIN} from q window w as (partition by session, track, node order by sidx)) "
    "select session, sidx, track, node, round(sqrt(vx * vx + vy * vy), 3) speed, round(sqrt(ax * ax + ay * ay), 2) accel, round(sqrt(jx * jx + jy * jy), 1) jerk, round(degrees(atan2(vy, vx)), 3) + 0.0 heading from k"
)
def pose_kinematics(spark, sf_dir):
    k = O.kinematics(pose(spark, sf_dir), FPS)
    return k.select("session", "sidx", "track", "node", F.round("speed", 3).alias("speed"), F.round("accel", 2).alias("accel"), F.round("jerk", 1).alias("jerk"), (F.round("heading", 3) + 0.0).alias("heading"))


@query(
    "with " + POSE_SQL + ", m as (select session, sidx, track, node, list_sort([coalesce(lag(x) over w, x), x, coalesce(lead(x) over w, x)])[2] x, list_sort([coalesce(lag(y) over w, y), y, coalesce(lead(y) over w, y)])[2] y from pose window w as (partition by session, track, node order by sidx)), "
    "q as (select *, row_number() over w - 1 pos, count(*) over (partition by session, track, node) n from m window w as (partition by session, track, node order by sidx)) "
    f"select session, sidx, track, node, round({savgol_sql('x', 5, 2, 0, 1.0)}, 3) + 0.0 x, round({savgol_sql('y', 5, 2, 0, 1.0)}, 3) + 0.0 y from q window w as (partition by session, track, node order by sidx)"
)
def pose_smoothing(spark, sf_dir):
    return rounded(O.smooth(pose(spark, sf_dir)), ["session", "sidx", "track", "node"], 3)


@query(
    "with " + POSE_SQL + ", g as (select session, track, node, sidx, case when abs(x) <= 12 then x end x from pose), "
    "k as (select *, last_value(x ignore nulls) over b x0, last_value(case when x is not null then sidx end ignore nulls) over b t0, first_value(x ignore nulls) over a x1, first_value(case when x is not null then sidx end ignore nulls) over a t1 from g "
    "window b as (partition by session, track, node order by sidx rows between unbounded preceding and current row), a as (partition by session, track, node order by sidx rows between current row and unbounded following)) "
    "select session, sidx, track, node, round(coalesce(x, case when x0 is null then x1 when x1 is null then x0 else x0 + (x1 - x0) * (sidx - t0) / (t1 - t0) end), 4) + 0.0 x from k"
)
def pose_interpolation(spark, sf_dir):
    p = pose(spark, sf_dir).withColumn("x", F.when(F.abs("x") <= 12, F.col("x")))
    return rounded(p.withColumn("x", W.interpolate(F.col("x"), F.col("sidx").cast("double"), O.node_series())).drop("y"), ["session", "sidx", "track", "node"])


#: Points with outliers and gaps, made from the given coordinates.
_JUMPY_SQL = POSE_SQL + """,
jumpy as (select session, track, node, sidx, case when abs(y) <= 21 then x + case when abs(x) > 20 then 300 else 0 end end x, case when abs(y) <= 21 then y end y from pose)"""
_SERIES_SQL = "session, track, node"


def _speed_mask_sql(source: str, rounds: int) -> str:
    """The rounds one by one: beyond the last that masks anything they change nothing."""
    out, at = [], source
    for r in range(rounds):
        out.append(
            f"""v{r} as (select {_SERIES_SQL}, sidx, x, y, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) / (sidx - lag(sidx) over w) v from {at} where x is not null window w as (partition by {_SERIES_SQL} order by sidx)),
a{r} as (select {_SERIES_SQL}, quantile_cont(v, 0.5) mid from v{r} group by all), b{r} as (select {_SERIES_SQL}, any_value(mid) + 5 * 1.4826 * quantile_cont(abs(v - mid), 0.5) lim from v{r} join a{r} using ({_SERIES_SQL}) group by all),
k{r} as (select {_SERIES_SQL}, sidx, x, y from (select *, coalesce(v > lim and lead(v) over (partition by {_SERIES_SQL} order by sidx) > lim, false) bad from v{r} join b{r} using ({_SERIES_SQL})) where not bad)"""
        )
        at = f"k{r}"
    return ",\n".join(out)


_ROUNDS, _WIDTH = 6, 21
_MIRRORED = f"case when j < 0 then -j - 1 when j >= n then 2 * n - 1 - j else j end"


@query(
    "with " + _JUMPY_SQL + ",\n" + _speed_mask_sql("jumpy", _ROUNDS) + f""",
s as (select j.session, j.track, j.node, j.sidx, k.x, k.y from jumpy j left join k{_ROUNDS - 1} k on k.session = j.session and k.track = j.track and k.node = j.node and k.sidx = j.sidx),
e as (select *, last_value(x ignore nulls) over b x0, last_value(y ignore nulls) over b y0, last_value(case when x is not null then sidx end ignore nulls) over b t0, first_value(x ignore nulls) over a x1, first_value(y ignore nulls) over a y1, first_value(case when x is not null then sidx end ignore nulls) over a t1 from s
  window b as (partition by {_SERIES_SQL} order by sidx rows between unbounded preceding and current row), a as (partition by {_SERIES_SQL} order by sidx rows between current row and unbounded following)),
f as (select {_SERIES_SQL}, sidx, x, y, {", ".join(f"coalesce({c}, case when {c}0 is null then {c}1 when {c}1 is null then {c}0 else {c}0 + ({c}1 - {c}0) * (sidx - t0) / (t1 - t0) end) f{c}" for c in "xy")}, row_number() over w - 1 p, count(*) over (partition by {_SERIES_SQL}) n, count(x) over (partition by {_SERIES_SQL}) known from e window w as (partition by {_SERIES_SQL} order by sidx)),
g as (select f.session, f.track, f.node, f.sidx, p + d j, f.n from f, range(-{_WIDTH // 2}, {_WIDTH // 2 + 1}) r(d) where x is not null and known >= 3 and n > {_WIDTH // 2}),
m as (select g.session, g.track, g.node, g.sidx, quantile_cont(f.fx, 0.5) mx, quantile_cont(f.fy, 0.5) my from g join f on f.session = g.session and f.track = g.track and f.node = g.node and f.p = ({_MIRRORED.replace(" n ", " g.n ").replace("* n ", "* g.n ")}) group by all),
w as (select f.*, sqrt((x - coalesce(mx, fx)) ** 2 + (y - coalesce(my, fy)) ** 2) away from f left join m using ({_SERIES_SQL}, sidx) where x is not null and known >= 3),
q as (select {_SERIES_SQL}, quantile_cont(away, 0.5) mid from w group by all), l as (select {_SERIES_SQL}, greatest(any_value(mid) + 5 * 1.4826 * quantile_cont(abs(away - mid), 0.5), 15) lim from w join q using ({_SERIES_SQL}) group by all),
far as (select {_SERIES_SQL}, sidx from w join l using ({_SERIES_SQL}) where away > lim)
select s.session, s.sidx, s.track, s.node, round(case when far.sidx is null then s.x end, 4) + 0.0 x, round(case when far.sidx is null then s.y end, 4) + 0.0 y from s left join far on far.session = s.session and far.track = s.track and far.node = s.node and far.sidx = s.sidx"""
)
def pose_outliers(spark, sf_dir):
    """Outliers of speed, then of drift, as missing points."""
    from ..operators.repair import masked

    c = F.col
    known = lambda v: F.when(F.abs("y") <= 21, v)
    jumpy = pose(spark, sf_dir).select("session", "sidx", "track", "node", known(c("x") + F.when(F.abs("x") > 20, 300.0).otherwise(0.0)).alias("x"), known(c("y")).alias("y"))
    return rounded(masked(jumpy, FPS), ["session", "sidx", "track", "node"])


@query()
def pose_repair(spark, sf_dir):
    from ..operators.repair import repaired

    gappy = pose(spark, sf_dir).withColumn("x", F.when(F.abs("x") <= 20, F.col("x")))
    return rounded(repaired(gappy, FPS), ["session", "sidx", "track", "node"])


_INTERPOLATED = "coalesce({0}, case when {0}0 is null then {0}1 when {0}1 is null then {0}0 else {0}0 + ({0}1 - {0}0) * (sidx - t0) / (t1 - t0) end)"


@query(
    "with " + WIDE_SQL + """, g as (select session, sidx, track, nose_x - body_x dx, nose_y - body_y dy, sqrt((nose_x - body_x) ** 2 + (nose_y - body_y) ** 2) size from wide),
u as (select *, case when size >= 1 then dx / size end c, case when size >= 1 then dy / size end s, case when size >= 1 then sidx end t from g),
k as (select *, last_value(c ignore nulls) over b c0, last_value(s ignore nulls) over b s0, last_value(t ignore nulls) over b t0, first_value(c ignore nulls) over a c1, first_value(s ignore nulls) over a s1, first_value(t ignore nulls) over a t1 from u
  window b as (partition by session, track order by sidx rows between unbounded preceding and current row), a as (partition by session, track order by sidx rows between current row and unbounded following)),
h as (select session, sidx, track, coalesce(degrees(atan2(""" + _INTERPOLATED.format("s") + ", " + _INTERPOLATED.format("c") + """)), 0) h from k),
j as (select *, h - lag(h) over w e from h window w as (partition by session, track order by sidx)),
r as (select *, first_value(h) over w + sum(coalesce(e + 180 - 360 * floor((e + 180) / 360) - 180, 0)) over w v, row_number() over w - 1 pos, count(*) over (partition by session, track) n from j window w as (partition by session, track order by sidx)),
f as (select session, sidx, track, case when n >= 15 then """ + savgol_sql("v", 15, 3, 0, 1.0) + """ else v end v from r window w as (partition by session, track order by sidx))
select session, sidx, track, round(v + 180 - 360 * floor((v + 180) / 360) - 180, 3) + 0.0 body_heading from f"""
)
def pose_body_heading(spark, sf_dir):
    return O.body_heading(wide(spark, sf_dir)).select("session", "sidx", "track", (F.round("body_heading", 3) + 0.0).alias("body_heading"))


@query(
    "with " + POSE_SQL + ", m as (select session, sidx, track, var_pop(x) a, var_pop(y) b, covar_pop(x, y) c from pose group by 1, 2, 3), "
    "e as (select session, sidx, track, greatest((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c), 1e-12) major, greatest((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c), 1e-12) minor from m) "
    "select session, sidx, track, round(sqrt(major / minor), 3) elongation, round(sqrt(1 - minor / major), 4) eccentricity from e"
)
def body_shapes(spark, sf_dir):
    return O.shapes(pose(spark, sf_dir)).select("session", "sidx", "track", F.round("elongation", 3).alias("elongation"), F.round("eccentricity", 4).alias("eccentricity"))


_TRI = "abs(({0}_x - body_x) * ({1}_y - body_y) - ({1}_x - body_x) * ({0}_y - body_y)) / 2"


@query("with " + WIDE_SQL + f", t as (select session, sidx, track, {_TRI.format('ear_l', 'ear_r')} u, {_TRI.format('hip_l', 'hip_r')} l from wide) select session, sidx, track, round(u + l, 4) area, case when l > 1 then round(u / l, 4) end ratio from t")
def hourglass_areas(spark, sf_dir):
    c = F.col
    tri = lambda a, b: G.triangle_area(c("body_x"), c("body_y"), c(f"{a}_x"), c(f"{a}_y"), c(f"{b}_x"), c(f"{b}_y"))
    low = tri("hip_l", "hip_r")
    area, ratio = G.hourglass(tri("ear_l", "ear_r"), low)
    return wide(spark, sf_dir).select("session", "sidx", "track", F.round(area, 4).alias("area"), F.when(low > 1, F.round(ratio, 4)).alias("ratio"))


@query(
    "with " + POSE_SQL + """, e as (select p.session, p.sidx, p.track, p.node i, q.node j, any_value((p.x * q.y - q.x * p.y) / 2) area, any_value(sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2)) len,
  bool_and(r.node in (p.node, q.node) or (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0) hull
  from pose p join pose q on p.session = q.session and p.sidx = q.sidx and p.track = q.track and p.node <> q.node join pose r on p.session = r.session and p.sidx = r.sidx and p.track = r.track group by 1, 2, 3, 4, 5),
m as (select session, sidx, track, coalesce(sum(area) filter (hull), 0) area, coalesce(sum(len) filter (hull), 0) len from e group by 1, 2, 3)
select session, sidx, track, case when area > 1e-10 then round(4 * pi() * area / (len * len), 4) end circularity from m"""
)
def hull_circularity(spark, sf_dir):
    return O.node_arrays(pose(spark, sf_dir), len(NODES)).select("session", "sidx", "track", F.round(G.circularity(F.col("xs"), F.col("ys")), 4).alias("circularity"))


@query(
    "with " + WIDE_SQL + ", a as (select *, sqrt((body_x - nose_x) ** 2 + (body_y - nose_y) ** 2) d, degrees(atan2(body_y - nose_y, body_x - nose_x)) g from wide), "
    "l as (select *, lag(g) over w p, lead(g) over w q from a window w as (partition by session, track order by sidx)), "
    "t as (select *, case when p is null then q - g else g - p end c from l) "
    "select session, sidx, track, round(d, 4) nose_to_body_dist, round(g, 4) + 0.0 nose_to_body_angle, round(coalesce((c + 180) - 360 * floor((c + 180) / 360) - 180, 0), 4) + 0.0 nose_to_body_angular_motion from t"
)
def node_pair_features(spark, sf_dir):
    out = O.node_pairs(wide(spark, sf_dir), [("nose", "body")])
    return rounded(out.select("session", "sidx", "track", "nose_to_body_dist", "nose_to_body_angle", "nose_to_body_angular_motion"), ["session", "sidx", "track"])


_W = "(partition by session, track order by sidx"
_WIDTH, _HALF = round(3 * FPS), 3


@query(
    "with " + MOVING_SQL + f""", s as (select *, speed / {FPS} step, x - coalesce(lag(x) over w, x) dx,
  case when lag(sidx) over w is null and lead(sidx) over w is null then 0 when lag(sidx) over w is null then lead(x) over w - x when lead(sidx) over w is null then x - lag(x) over w else (lead(x) over w - lag(x) over w) / 2 end grad,
  avg(speed) over {_W} rows between 1 preceding and 1 following) roll, coalesce(stddev_samp(speed) over {_W} rows between {_HALF} preceding and {_HALF} following), 0) std,
  last_value(x) over {_W} rows between {_HALF} preceding and {_HALF} following) - first_value(x) over {_W} rows between {_HALF} preceding and {_HALF} following) wx,
  last_value(y) over {_W} rows between {_HALF} preceding and {_HALF} following) - first_value(y) over {_W} rows between {_HALF} preceding and {_HALF} following) wy,
  coalesce(lag(x, {_WIDTH}) over w, first_value(x) over {_W})) fx, coalesce(lag(y, {_WIDTH}) over w, first_value(y) over {_W})) fy,
  (max((speed > 200)::int) over {_W} rows between 7 preceding and current row) > 0)::int recent
  from moving window w as (partition by session, track order by sidx)),
c as (select *, sum(step) over {_W} rows between unbounded preceding and current row) cum, sum(step) over {_W} rows between {_HALF} preceding and {_HALF} following) near from s),
p as (select *, cum - coalesce(lag(cum, {_WIDTH}) over {_W}), 0) path from c)
select session, sidx, track, round(dx, 4) + 0.0 difference, round(grad, 4) + 0.0 gradient, round(cum, 3) path, round(roll, 3) rolling_mean, round(std, 3) rolling_std, round(sqrt(wx * wx + wy * wy), 4) displacement,
  round(case when path <= 1e-6 then 1 else least(1.0, sqrt((x - fx) ** 2 + (y - fy) ** 2) / path) end, 4) efficiency, round(case when near <= 1e-12 then 0 else least(1.0, sqrt(wx * wx + wy * wy) / near) end, 4) efficiency_centred, recent from p"""
)
def series_windows(spark, sf_dir):
    df, w, c = moving(spark, sf_dir), O.series(), F.col
    df = df.withColumn("step", c("speed") / FPS)
    df = df.withColumns(
        {
            "difference": W.difference(c("x"), w), "gradient": W.gradient(c("x"), w), "path": W.running(c("step"), w), "rolling_mean": W.rolling_mean(c("speed"), w, 3), "rolling_std": W.rolling_std(c("speed"), w, _HALF),
            "displacement": W.window_displacement(c("x"), c("y"), w, _HALF), "efficiency": W.past_path_efficiency(c("step"), c("x"), c("y"), w, _WIDTH), "efficiency_centred": W.centred_path_efficiency(c("step"), c("x"), c("y"), w, _HALF),
            "recent": W.recently(c("speed") > 200, w, 8).cast("int"),
        }
    )
    r = lambda n, d: (F.round(n, d) + 0.0).alias(n)
    return df.select("session", "sidx", "track", r("difference", 4), r("gradient", 4), r("path", 3), r("rolling_mean", 3), r("rolling_std", 3), r("displacement", 4), r("efficiency", 4), r("efficiency_centred", 4), "recent")


_AV = "(case when lag(heading) over w is null then lead(heading) over w - heading else heading - lag(heading) over w end)"


@query(
    "with " + MOVING_SQL + f""", a as (select *, {_AV} c, list_sort([coalesce(lag(speed) over w, speed), speed, coalesce(lead(speed) over w, speed)])[2] v from moving window w as (partition by session, track order by sidx)),
b as (select *, coalesce((c + 180) - 360 * floor((c + 180) / 360) - 180, 0) * {FPS} av from a),
r as (select *, max((av > 20)::int) over f hi, max((av < -20)::int) over f lo, count(*) over f n from b window f as (partition by session, track order by sidx rows between 2 preceding and 2 following))
select session, sidx, track, (v < {3 * PX_PER_CM})::int stationary, (v > {20 * PX_PER_CM * 2})::int running, (v >= {3 * PX_PER_CM} and v <= {20 * PX_PER_CM * 2})::int walking, (abs(av) > 30)::int turning, (hi = 1 and lo = 1 and n = 5)::int reversal from r"""
)
def locomotion_states(spark, sf_dir):
    df = moving(spark, sf_dir).withColumn("av", O.angular_velocity(F.col("heading"), FPS))
    return O.locomotion(df, FPS, PX_PER_CM, fast=40.0).select("session", "sidx", "track", "stationary", "running", "walking", "turning", "reversal")


_ZONE = f"""case when y > {Y1 - STRIP} and x < {X0 + STRIP} then 'C4' when y > {Y1 - STRIP} and x > {X1 - STRIP} then 'C3' when y < {Y0 + STRIP} and x > {X1 - STRIP} then 'C2' when y < {Y0 + STRIP} and x < {X0 + STRIP} then 'C1'
  when x < {X0 + STRIP} then 'W4' when y > {Y1 - STRIP} then 'W3' when x > {X1 - STRIP} then 'W2' when y < {Y0 + STRIP} then 'W1' else 'Open' end"""


@query(
    "with " + WIDE_SQL + f" select session, sidx, track, {_ZONE} zone, round((x - {X0}) / {PX_PER_CM}, 3) + 0.0 x_cm, round(sqrt(x * x + y * y), 4) centre_distance, round(greatest(0.0, least(x - {X0}, {X1} - x, y - {Y0}, {Y1} - y)), 4) + 0.0 boundary_distance from animal"
)
def zones(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return animals(spark, sf_dir).select("session", "sidx", "track", G.zone(x, y, ROI, STRIP).alias("zone"), (F.round((x - X0) / PX_PER_CM, 3) + 0.0).alias("x_cm"), F.round(G.centre_distance(x, y, ROI), 4).alias("centre_distance"), (F.round(G.boundary_distance(x, y, ROI), 4) + 0.0).alias("boundary_distance"))


@query(
    "with " + WIDE_SQL + f", z as (select session, track, {_ZONE} zone, count(*) n from animal group by 1, 2, 3), t as (select *, sum(n) over (partition by session, track) total from z) "
    f"select session, track, zone, n frames, round(n / {FPS}, 3) as seconds, round(100.0 * n / total, 2) percent, list_position(['Open', 'W1', 'W2', 'W3', 'W4', 'C1', 'C2', 'C3', 'C4'], zone)::int zone_order from t"
)
def zone_summary(spark, sf_dir):
    return O.zone_summary(animals(spark, sf_dir).withColumn("zone", G.zone(F.col("x"), F.col("y"), ROI, STRIP)), "zone", FPS)


@query(
    "with " + WIDE_SQL + ", d as (select session, track, sqrt((hip_l_x - hip_r_x) * (hip_l_x - hip_r_x) + (hip_l_y - hip_r_y) * (hip_l_y - hip_r_y)) d from wide), b as (select session, track, quantile_cont(d, 0.2) lo, quantile_cont(d, 0.8) hi from d group by 1, 2 having count(*) >= 3), "
    "m as (select session, track, quantile_cont(d, 0.5) m from d join b using (session, track) where d between lo and hi group by 1, 2), f as (select session, 0.1 * sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) f from pose group by 1) "
    "select session, round(avg(m), 5) dsr, round(any_value(f), 5) fallback from m join f using (session) group by session"
)
def body_scales(spark, sf_dir):
    own, other = O.body_scale(wide(spark, sf_dir)), O.fallback_scale(pose(spark, sf_dir)).withColumnRenamed("dsr", "fallback")
    return own.join(other, "session").select("session", F.round("dsr", 5).alias("dsr"), F.round("fallback", 5).alias("fallback"))


@query(
    "with " + WIDE_SQL + f", g as (select session, track, least(9, floor((x - {X0}) / {X1 - X0} * 10)) i, least(9, floor((y - {Y0}) / {Y1 - Y0} * 10)) j, count(*) n from animal where x between {X0} and {X1} and y between {Y0} and {Y1} group by 1, 2, 3, 4), "
    "p as (select *, n / sum(n) over (partition by session, track) p from g) select session, track, round(-sum(p * log2(p)) / log2(100), 4) entropy from p group by 1, 2"
)
def position_entropy(spark, sf_dir):
    return O.position_entropy(animals(spark, sf_dir), "x", "y", ROI)


@query(
    "with v as (select n_name stem, n_regionkey dir, n_nationkey id from nation), h as (select n.n_name || '_' || c.c_custkey stem, (c.c_custkey % 5)::int dir, c.c_custkey id from customer c join nation n on c.c_nationkey = n.n_nationkey union all select lower(n_name), 3, -n_nationkey from nation where n_nationkey % 2 = 0), "
    "m as (select v.stem video, h.id, row_number() over (partition by v.id order by (h.dir = v.dir) desc, (lower(h.stem) = lower(v.stem)) desc, length(h.stem), h.stem, h.id) r from v join h on starts_with(lower(h.stem), lower(v.stem))) "
    "select v.stem video, m.id::bigint matched from v left join m on m.video = v.stem and r = 1"
)
def file_pairing(spark, sf_dir):
    from ..sources.pairing import match

    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    videos = nation.select(F.col("n_name").alias("stem"), F.col("n_regionkey").alias("dir"))
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.concat("n_name", F.lit("_"), "c_custkey").alias("stem"), (F.col("c_custkey") % 5).cast("int").alias("dir"), F.col("c_custkey").alias("id"))
    files = named.union(nation.where("n_nationkey % 2 = 0").select(F.lower("n_name"), F.lit(3), -F.col("n_nationkey").cast("long")))
    return match(videos, files).select(F.col("stem").alias("video"), F.col("matched_id").alias("matched"))

