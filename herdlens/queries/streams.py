"""Streams over the events table. A window is written when the watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows as S
from . import query

_CLOSED = "(select max(ts) - interval 10 minute from events)"


@query(
    "with b as (select user_id, time_bucket(interval 1 hour, ts) as \"start\", count(*) n, round(avg(value), 4) mean from events group by 1, 2) "
    f"select user_id, \"start\", n, mean from b where \"start\" + interval 1 hour <= {_CLOSED}"
)
def stream_tumbling_bins(spark, sf_dir):
    out = S.drained(S.tumbling(S.events(spark, sf_dir), "user_id", "1 hour"), spark, "tumbling")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 4).alias("mean"))


@query(
    "with e as (select user_id, value, time_bucket(interval 1 hour, ts) - i * interval 1 hour as \"start\" from events, range(2) r(i)), b as (select user_id, \"start\", count(*) n, round(avg(value), 4) mean from e group by 1, 2) "
    f"select user_id, \"start\", n, mean from b where \"start\" + interval 2 hour <= {_CLOSED}"
)
def stream_sliding_means(spark, sf_dir):
    out = S.drained(S.sliding(S.events(spark, sf_dir), "user_id", "2 hours", "1 hour"), spark, "sliding")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 4).alias("mean"))


@query(
    "with a as (select user_id, ts, lag(ts) over (partition by user_id order by ts) p from events where value > 40), g as (select *, sum((p is null or ts >= p + interval 6 hour)::int) over (partition by user_id order by ts rows unbounded preceding) k from a), "
    f"b as (select user_id, min(ts) as \"start\", max(ts) + interval 6 hour as \"end\", count(*) n from g group by user_id, k) select user_id, \"start\", \"end\", n from b where \"end\" <= (select max(ts) - interval 10 minute from events where value > 40)"
)
def stream_bouts(spark, sf_dir):
    out = S.drained(S.bouts(S.events(spark, sf_dir), "user_id", F.col("value") > 40, "6 hours"), spark, "bouts")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select user_id, round(count(*) filter (value > 40) / 10.0, 4) as seconds from events group by 1")
def stream_tally(spark, sf_dir):
    out = S.drained(S.tally(S.events(spark, sf_dir), "user_id", F.col("value") > 40, 10.0), spark, "tally", "update")
    return out.groupBy("user_id").agg(F.round(F.max_by("seconds", "batch"), 4).alias("seconds"))
