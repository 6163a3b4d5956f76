"""Pose and signal tables made from the test tables, in both engines.

A vector's 64 numbers are the coordinates of four animals with eight nodes; 250 vectors are a session at FPS frames a
second. An event is a frame of its user's signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import pose as O

NODES = ["nose", "ear_l", "ear_r", "body", "hip_l", "hip_r", "tail_base", "tail_end"]
FPS = 10.0
ROI = (-30.0, -30.0, 30.0, 30.0)
STRIP = 8.0
PX_PER_CM = 2.0

POSE_SQL = """pose as (select 's' || (vec_id // 250) session, (vec_id % 250)::int sidx, (i // 8)::int track, (i % 8)::int node,
  100 * embedding[2 * i + 1]::double x, 100 * embedding[2 * i + 2]::double y from embeddings, range(32) r(i))"""
#: Four animals on one winding path, each some frames behind the one before, now closing up and now falling back, with
#: rests and looks over the shoulder; the vectors make the tremor. All behaviours occur.
_FRONT, _LEFT = (7.0, 4.0, 4.0, 0.0, -3.0, -3.0, -6.0, -11.0), (0.0, 2.5, -2.5, 0.0, 4.0, -4.0, 0.0, 0.0)
STAGED_SQL = f"""place as (select 's' || (vec_id // 250) session, (vec_id % 250)::int sidx, k::int track, embedding, vec_id % 250 + 14 * sin(vec_id % 250 / 14.0) t from embeddings, range(4) r(k)),
path as (select *, t - track * (2.4 + 1.2 * sin(t / 9.0 + track)) - 2.2 * sin(t / 2.7 + 2 * track) u from place),
stance as (select *, 200 * cos(u / 25) px, 150 * sin(u / 18) py, atan2(150 / 18.0 * cos(u / 18), -8 * sin(u / 25)) + case when sin(t / 13.0 + 2 * track) > 0.85 then pi() else 0 end phi from path),
pose as (select session, sidx, track, i::int node, px + ahead * cos(phi) - aside * sin(phi) + 0.3 * embedding[2 * (8 * track + i) + 1]::double x, py + ahead * sin(phi) + aside * cos(phi) + 0.3 * embedding[2 * (8 * track + i) + 2]::double y
  from stance, (select unnest(range(8)) i, unnest({list(_FRONT)})::double ahead, unnest({list(_LEFT)})::double aside))"""
#: One row an animal and frame: body and nose, heading of the body axis.
WIDE_SQL = (
    POSE_SQL
    + ",\nwide as (select session, sidx, track, "
    + ", ".join(f"max(case when node = {i} then {c} end) {n}_{c}" for i, n in enumerate(NODES) for c in "xy")
    + " from pose group by 1, 2, 3),\nanimal as (select session, sidx, track, body_x x, body_y y, degrees(atan2(nose_y - body_y, nose_x - body_x)) heading from wide)"
)
#: Speed by the last step, as pixels a second.
MOVING_SQL = WIDE_SQL + f""",
moving as (select *, coalesce(sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)), 0) * {FPS} speed
  from animal window w as (partition by session, track order by sidx))"""
PAIR_SQL = MOVING_SQL + """,
pair as (select a.session, a.sidx, a.track "tA", b.track "tB", a.x "A_x", a.y "A_y", b.x "B_x", b.y "B_y", a.heading "A_heading", b.heading "B_heading", a.speed "A_speed", b.speed "B_speed"
  from moving a join moving b on a.session = b.session and a.sidx = b.sidx and a.track < b.track)"""
SIGNAL_SQL = "signal as (select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int idx, value, event_type, (value > {cut})::int flag from events)"


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's row becomes its points' rows: no shuffle."""
    point = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")
    at = lambda k: 100.0 * F.get(F.col("embedding"), (2 * F.col("i") + k).cast("int")).cast("double")
    return (
        spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        .select("vec_id", "embedding", point)
        .select(
            F.concat(F.lit("s"), F.floor(F.col("vec_id") / 250).cast("string")).alias("session"), (F.col("vec_id") % 250).cast("int").alias("sidx"),
            F.floor(F.col("i") / 8).cast("int").alias("track"), (F.col("i") % 8).cast("int").alias("node"), at(0).alias("x"), at(1).alias("y"),
        )
    )


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of pose, by STAGED_SQL."""
    c, late = F.col, F.col("vec_id") % 250
    track = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("track")
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", track)
    df = df.withColumn("t", late + 14 * F.sin(late / 14.0))
    df = df.withColumn("u", c("t") - c("track") * (2.4 + 1.2 * F.sin(c("t") / 9.0 + c("track"))) - 2.2 * F.sin(c("t") / 2.7 + 2 * c("track")))
    phi = F.atan2(150 / 18.0 * F.cos(c("u") / 18), -8 * F.sin(c("u") / 25)) + F.when(F.sin(c("t") / 13.0 + 2 * c("track")) > 0.85, F.pi()).otherwise(0.0)
    df = df.withColumns({"phi": phi, "px": 200 * F.cos(c("u") / 25), "py": 150 * F.sin(c("u") / 18)}).withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(7))))
    ahead, aside = (F.get(F.array(*[F.lit(x) for x in xs]), c("node")) for xs in (_FRONT, _LEFT))
    tremor = lambda k: 0.3 * F.get(c("embedding"), (2 * (8 * c("track") + c("node")) + k).cast("int")).cast("double")
    return df.select(
        F.concat(F.lit("s"), F.floor(c("vec_id") / 250).cast("string")).alias("session"), late.cast("int").alias("sidx"), "track", "node",
        (c("px") + ahead * F.cos("phi") - aside * F.sin("phi") + tremor(0)).alias("x"), (c("py") + ahead * F.sin("phi") + aside * F.cos("phi") + tremor(1)).alias("y"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.nodes_wide(pose(spark, sf_dir), {n: i for i, n in enumerate(NODES)})


def animals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.angles import bearing

    c = F.col
    return wide(spark, sf_dir).select("session", "sidx", "track", c("body_x").alias("x"), c("body_y").alias("y"), bearing(c("nose_x") - c("body_x"), c("nose_y") - c("body_y")).alias("heading"))


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.windows import step

    return animals(spark, sf_dir).withColumn("speed", step(F.col("x"), F.col("y"), O.series()) * FPS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pairs(moving(spark, sf_dir), ["x", "y", "heading", "speed"])


def node_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pairs(O.node_arrays(pose(spark, sf_dir), len(NODES)), ["xs", "ys"])


def signal(spark: SparkSession, sf_dir: str, cut: float) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.row_number().over(w) - 1).cast("int").alias("idx"), "value", "event_type", (F.col("value") > cut).cast("int").alias("flag"))


def rounded(df: DataFrame, keys, digits: int = 4) -> DataFrame:
    """Doubles rounded, -0 as 0, in a stated order of columns."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[(F.round(F.col(c), digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in keys])
