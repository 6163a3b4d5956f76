"""Session metrics in long form: category, metric, subject, value, unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import runs as R

COLUMNS = ("session", "category", "metric", "subject", "value", "unit")


def _long(df: DataFrame, subject: Column, rows: Sequence[tuple[str, str, Column, str]]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric"), F.round(v.cast("double"), 4).alias("value"), F.lit(u).alias("unit")) for c, m, v, u in rows])
    return df.select("session", subject.alias("subject"), F.explode(items).alias("r")).select("session", "r.category", "r.metric", "subject", "r.value", "r.unit")


def locomotion(df: DataFrame, px_per_cm: float) -> DataFrame:
    """df: session, sidx, track, path (cumulative), speed, accel."""
    per = df.groupBy("session", "track").agg(
        F.max_by("path", "sidx").alias("path"), F.avg("speed").alias("mean"), F.percentile("speed", F.array(F.lit(0.5), F.lit(0.95))).alias("p"),
        F.avg(F.abs(F.col("accel"))).alias("acc"), F.percentile(F.abs(F.col("accel")), 0.95).alias("acc95"),
    )
    cm = 1 / px_per_cm
    c = F.col
    rows = [("Distance", c("path"), "cm"), ("Mean speed", c("mean"), "cm/s"), ("Median speed", c("p")[0], "cm/s"), ("P95 speed", c("p")[1], "cm/s"), ("Mean acceleration", c("acc"), "cm/s2"), ("P95 acceleration", c("acc95"), "cm/s2")]
    return _long(per, c("track").cast("string"), [("Locomotion", m, v * cm, u) for m, v, u in rows])


def immobility(df: DataFrame, fps: float, flag: str = "stationary", least_s: float = 1.0) -> DataFrame:
    """Seconds and share of frames in stationary bouts of at least least_s."""
    kept = R.drop_short(df.select("session", "sidx", "track", flag), flag, ("session", "track"), "sidx", max(1, round(least_s * fps)))
    per = kept.groupBy("session", "track").agg(F.sum(flag).alias("n"), F.count("*").alias("all"))
    return _long(per, F.col("track").cast("string"), [("Immobility", "Time", F.col("n") / fps, "s"), ("Immobility", "Share", 100.0 * F.col("n") / F.col("all"), "%")])


def zone_times(df: DataFrame, fps: float, zone: str = "zone", hold_s: float = 1.0) -> DataFrame:
    """Seconds in the centre, along the walls and in corners, after holding states of under hold_s."""
    held = R.state_hold(df.select("session", "sidx", "track", zone), zone, ("session", "track"), "sidx", max(1, round(hold_s * fps)))
    coarse = G.coarse_zone(F.col(zone))
    per = held.groupBy("session", "track").agg(*[F.sum((coarse == z).cast("int")).alias(z) for z in ("Center", "Perimeter", "Corner")])
    return _long(per, F.col("track").cast("string"), [("Zones", z, F.coalesce(F.col(z), F.lit(0)) / fps, "s") for z in ("Center", "Perimeter", "Corner")])


def bout_seconds(df: DataFrame, distance: str, keys: Sequence[str], fps: float, near: float, gap_s: float = 0.1, least_s: float = 1.0) -> DataFrame:
    """Rows with `near_bout`: 1 in bouts within `near`, short gaps bridged and short bouts left out. A missing distance is far."""
    df = df.withColumn("near_bout", F.coalesce(F.col(distance) <= near, F.lit(False)).cast("int"))
    df = R.fill_gaps(df, "near_bout", keys, "sidx", max(1, round(gap_s * fps)))
    return R.drop_short(df, "near_bout", keys, "sidx", max(1, round(least_s * fps)))


def contacts(df: DataFrame, distances: dict[str, str], fps: float, px_per_cm: float, windows: Sequence[int] = (30, 60), proximity_cm: float = 3.0, contact_cm: float = 1.0, least_s: float = 1.0) -> DataFrame:
    """Proximity and contact seconds of pairs: in all, and for windows of so many seconds (0-30s, ...). distances: label
    to column.

    A frame becomes a row for each distance and threshold, so all of them share one chain of windows; sums are by the
    smallest spans first, and the spans' sums (few rows) add up to windows and totals.
    """
    keys, c = ("session", "tA", "tB"), F.col
    limits = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(kind).alias("category"), F.coalesce(c(f"`{d}`") <= cm * px_per_cm, F.lit(False)).cast("int").alias("near")) for label, d in distances.items() for kind, cm in (("Proximity", proximity_cm), ("Contact", contact_cm))])
    rows = df.select(*keys, "sidx", "vframe", F.explode(limits).alias("r")).select(*keys, "sidx", "vframe", "r.*")
    of = (*keys, "label", "category")
    marked = R.drop_short(R.fill_gaps(rows, "near", of, "sidx", max(1, round(0.1 * fps))), "near", of, "sidx", max(1, round(least_s * fps)))
    spans = marked.groupBy(*of, *[F.floor(c("vframe") / fps / w).cast("int").alias(f"_{w}") for w in windows]).agg(F.sum("near").alias("n"))

    def text(w: int):
        step, unit = (w, "s") if w < 60 else (w // 60, "min")
        return F.format_string(f"%s %d–%d{unit}", c("label"), c(f"_{w}") * step, (c(f"_{w}") + 1) * step)

    named = spans.withColumn("metric", F.explode(F.array(c("label"), *[text(w) for w in windows])))
    per = named.groupBy(*of, "metric").agg(F.sum("n").alias("n"))
    subject = F.concat_ws("-", c("tA").cast("string"), c("tB").cast("string"))
    return per.select("session", "category", "metric", subject.alias("subject"), F.round(c("n") / fps, 4).alias("value"), F.lit("s").alias("unit"))


def angle_in_proximity(df: DataFrame, px_per_cm: float, cm: float = 3.0) -> DataFrame:
    """Mean of both animals' angles to each other while their bodies are near."""
    near = F.col("d") <= cm * px_per_cm
    per = df.groupBy("session", "tA", "tB").agg(F.avg(F.when(near, F.col("fe_A"))).alias("a"), F.avg(F.when(near, F.col("fe_B"))).alias("b"))
    return _long(per, F.concat_ws("-", F.col("tA").cast("string"), F.col("tB").cast("string")), [("Orientation", "Mean angle in proximity", (F.col("a") + F.col("b")) / 2, "deg")])


def cumulative_time(df: DataFrame, flag: Column, keys: Sequence[str], fps: float, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("sidx").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(w) / fps)


def per_second(df: DataFrame, fps: float, px_per_cm: float, regions: Sequence[str], keys: Sequence[str] = ("session", "tA", "tB"), proximity_cm: float = 3.0, contact_cm: float = 1.0) -> DataFrame:
    """keys, second: marks of proximity and contact, the most frequent closest pair of nodes (smallest at a tie), mean
    difference of headings, mean region distances in cm. df: min_dist, closest, delta_heading, region columns, vframe."""
    rows = df.withColumn("second", F.floor(F.col("vframe") / fps))
    per = rows.groupBy(*keys, "second").agg(
        F.mode(F.when(F.col("closest") != "", F.col("closest")), True).alias("closest"),
        F.avg("delta_heading").alias("delta_heading"),
        *[F.avg(F.col(r) / px_per_cm).alias(f"{r}_cm") for r in regions],
    )
    for name, cm in (("within_proximity", proximity_cm), ("within_contact", contact_cm)):
        near = df.withColumn("_n", F.coalesce(F.col("min_dist") <= cm * px_per_cm, F.lit(False)).cast("int"))
        per = per.join(R.second_marks(near, "_n", keys, "sidx", "vframe", fps).withColumnRenamed("mark", name), [*keys, "second"])
    return per
