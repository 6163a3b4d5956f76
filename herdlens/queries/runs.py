"""Runs of flags and labels on the event signal (a frame is an event, FPS frames a second)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bouts as T
from ..operators import legacy as L
from ..operators import runs as R
from . import query
from .fixtures import FPS, SIGNAL_SQL, rounded, signal

CUT = 40.0
USER = ["user_id"]


def fill_sql(flag: str, gap: int, source: str, out: str, keys: str = "user_id", order: str = "idx") -> str:
    w = f"partition by {keys} order by {order}"
    return f"""{out} as (select * exclude ({flag}, one, p, q), case when {flag} = 1 then 1 when q - p - 1 <= {gap} then 1 else 0 end::int {flag} from (
  select *, last_value(one ignore nulls) over ({w} rows between unbounded preceding and current row) p, first_value(one ignore nulls) over ({w} rows between current row and unbounded following) q
  from (select *, case when {flag} = 1 then row_number() over ({w}) end one from {source})))"""


def drop_sql(flag: str, least: int, source: str, out: str, keys: str = "user_id", order: str = "idx") -> str:
    return f"""{out} as (select * exclude ({flag}, ch, rn), case when {flag} = 1 and count(*) over (partition by {keys}, rn) >= {least} then 1 else 0 end::int {flag} from (
  select *, sum(ch) over (partition by {keys} order by {order}) rn from (select *, coalesce(({flag} <> lag({flag}) over (partition by {keys} order by {order}))::int, 1) ch from {source})))"""


def bouts_sql(flag: str, source: str, out: str, keys: str = "user_id", order: str = "idx") -> str:
    return f"""{out} as (select {keys}, bout, min({order}) s, max({order}) e, count(*) n from (select *, sum(st) over (partition by {keys} order by {order}) bout from (
  select *, ({flag} = 1 and coalesce(lag({flag}) over (partition by {keys} order by {order}), 0) <> 1)::int st from {source})) where {flag} = 1 group by {keys}, bout)"""


_GAP, _LEAST = max(1, round(0.25 * FPS)), max(1, round(0.8 * FPS))
_BOUTS = "with " + SIGNAL_SQL.format(cut=CUT) + ", " + fill_sql("flag", _GAP, "signal", "b1") + ", " + drop_sql("flag", _LEAST, "b1", "b2") + ", " + bouts_sql("flag", "b2", "bouts")


@query(_BOUTS + " select user_id, bout::bigint bout, s::int as \"start\", e::int as \"end\", n from bouts")
def bouts(spark, sf_dir):
    return R.detect_bouts(signal(spark, sf_dir, CUT), "flag", USER, "idx", FPS)


@query(_BOUTS + f" select user_id, count(*) n_bouts, round(sum(n) / {FPS}, 4) total_s, round(avg(n) / {FPS}, 4) mean_s from bouts group by user_id")
def bout_statistics(spark, sf_dir):
    return rounded(R.bout_stats(bouts(spark, sf_dir), USER, FPS), USER)


@query(
    "with " + SIGNAL_SQL.format(cut=CUT) + ", r as (select *, sum(ch) over (partition by user_id order by idx) rn from (select *, coalesce((event_type <> lag(event_type) over (partition by user_id order by idx))::int, 1) ch from signal)), "
    "c as (select *, case when count(*) over (partition by user_id, rn) >= 3 then event_type end conf from r) "
    "select user_id, idx, coalesce(last_value(conf ignore nulls) over (partition by user_id order by idx rows between unbounded preceding and current row), first_value(conf ignore nulls) over (partition by user_id order by idx rows between current row and unbounded following), event_type) state from c"
)
def state_hold(spark, sf_dir):
    return R.state_hold(signal(spark, sf_dir, CUT), "event_type", USER, "idx", 3, "state").select("user_id", "idx", "state")


@query(
    "with " + SIGNAL_SQL.format(cut=CUT) + ", " + fill_sql("flag", 1, "signal", "g1") + """, r as (select *, sum(ch) over (partition by user_id order by idx) rn from (select *, coalesce((flag <> lag(flag) over (partition by user_id order by idx))::int, 1) ch from g1)),
p as (select *, row_number() over (partition by user_id, rn order by idx) pos from r), g as (select *, max((pos <= 3 and value > 90)::int) over (partition by user_id, rn) ok from p)
select user_id, idx, (flag = 1 and ok = 1)::int flag from g"""
)
def onset_gate(spark, sf_dir):
    return R.onset_gate(signal(spark, sf_dir, CUT), "flag", USER, "idx", 1, F.col("value") > 90).select("user_id", "idx", "flag")


@query(
    "with " + SIGNAL_SQL.format(cut=20.0) + ", " + fill_sql("flag", 1, "signal", "m1") + ", " + drop_sql("flag", round(FPS), "m1", "m2") + f""", o as (select *, (flag = 1 and coalesce(lag(flag) over (partition by user_id order by idx), 0) <> 1)::int o from m2)
select user_id, floor(idx / {FPS})::bigint as second, (2 * sum(flag) > {round(FPS)} or (2 * sum(flag) = {round(FPS)} and max(o) = 1))::int mark from o group by 1, 2"""
)
def second_marks(spark, sf_dir):
    return R.second_marks(signal(spark, sf_dir, 20.0), "flag", USER, "idx", "idx", FPS)


@query(
    "with " + SIGNAL_SQL.format(cut=CUT) + f", f as (select user_id, idx, (value > {CUT})::int high, (value <= 15)::int low from signal), o as (select *, (high = 1 and coalesce(lag(high) over w, 0) <> 1)::int h1, (low = 1 and coalesce(lag(low) over w, 0) <> 1)::int l1 from f window w as (partition by user_id order by idx)) "
    f"select user_id, 'high' behaviour, round(sum(high) / {FPS}, 4) as seconds, sum(h1)::bigint n_bouts from o group by 1 union all select user_id, 'low', round(sum(low) / {FPS}, 4), sum(l1)::bigint from o group by 1"
)
def behaviour_summary(spark, sf_dir):
    df = signal(spark, sf_dir, CUT).select("user_id", "idx", (F.col("value") > CUT).cast("int").alias("high"), (F.col("value") <= 15).cast("int").alias("low"))
    return T.summary(df, ["high", "low"], USER, "idx", FPS)


def _paired(spark, sf_dir):
    """The signal as one pair of animals a user: fe_A and fe_B from the value."""
    c = F.col
    df = signal(spark, sf_dir, CUT).select(F.col("user_id").cast("string").alias("session"), F.lit(0).alias("tA"), F.lit(1).alias("tB"), c("idx").alias("sidx"), "flag", (c("value") % 180).alias("fe_A"), ((c("value") * 7) % 180).alias("fe_B"))
    keys = ["session", "tA", "tB"]
    return df, T.with_initiators(R.bouts(df, "flag", keys, "sidx"), df, FPS)


_INIT = "with " + SIGNAL_SQL.format(cut=CUT) + ", " + bouts_sql("flag", "signal", "bouts") + f""",
fr as (select user_id, idx, value % 180 a, (value * 7) % 180 b from signal),
pre as (select x.user_id, bout, avg(a) a, avg(b) b from bouts x join fr f on x.user_id = f.user_id and f.idx between greatest(0, s - {max(1, round(0.3 * FPS))}) and s group by 1, 2),
post as (select x.user_id, bout, avg(a) a, avg(b) b from bouts x join fr f on x.user_id = f.user_id and f.idx between e + 1 and e + {max(1, round(0.5 * FPS))} group by 1, 2),
init as (select x.user_id::varchar session, x.bout, s, e, n, case when round(coalesce(pre.a, 90), 9) <= round(coalesce(pre.b, 90), 9) then 'A' else 'B' end initiator, case when round(coalesce(post.a, 90), 9) >= round(coalesce(post.b, 90), 9) then 'A' else 'B' end disengager
  from bouts x left join pre using (user_id, bout) left join post using (user_id, bout))"""


@query(_INIT + ' select session, bout::bigint bout, s::int as "start", e::int as "end", initiator, disengager from init')
def bout_initiators(spark, sf_dir):
    return _paired(spark, sf_dir)[1].select("session", "bout", "start", "end", "initiator", "disengager")


_MINUTE = 2.0
_LAST = 120.0


def _windowed(spark, sf_dir):
    """Bouts by windows; a second has two frames here, so that signals last some minutes: as many as each session's own
    frames, and _LAST at least."""
    frames, found = _paired(spark, sf_dir)
    found = T.with_last_second(found, frames, F.col("sidx") / _MINUTE)
    return T.windowed(found, F.col("start") / _MINUTE, F.greatest(F.lit(_LAST), "last_second"))


@query(
    _INIT + f""", k as (select *, floor(s / {_MINUTE} / 60)::int m from init),
w as (select *, 'full' scope, 0 number from k union all select *, 'minute', m from k where m < 2 union all select k.*, 'cumulative', i::int from k, range(1, 3) r(i) where m < 2 and i > m),
l as (select *, lag(initiator) over (partition by session, scope, number order by s, bout) prev from w)
select session, scope, number, count(*) n_bouts, round(sum((initiator = 'A')::int) / count(*), 4) "EI", round(sum((initiator = 'A' and coalesce(prev = 'B', false))::int) / count(*), 4) "RI", round(sum(((e - s + 1) / {FPS} <= 0.3 and initiator <> 'A' and disengager = 'A')::int) / count(*), 4) "RTI" from l group by 1, 2, 3"""
)
def bout_indices(spark, sf_dir):
    return T.indices(_windowed(spark, sf_dir), ["session", "scope", "number"], FPS, 0.3)


@query(
    _INIT + f", ft as (select user_id::varchar session, idx, value v from signal) select i.session, bout::bigint bout, n, initiator, round(avg(v), 4) mean_value, round(quantile_cont(v, 0.95), 4) p95_value, count(*) frames from init i join ft on ft.session = i.session and ft.idx between s and e where n >= 3 group by 1, 2, 3, 4"
)
def bout_feature_table(spark, sf_dir):
    df, found = _paired(spark, sf_dir)
    values = signal(spark, sf_dir, CUT).select(F.col("user_id").cast("string").alias("session"), F.lit(0).alias("tA"), F.lit(1).alias("tB"), F.col("idx").alias("sidx"), "value")
    aggs = [F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.percentile("value", 0.95), 4).alias("p95_value"), F.count("*").alias("frames")]
    return T.feature_table(found, values, aggs).select("session", "bout", "n", "initiator", "mean_value", "p95_value", "frames")


@query(
    "with " + SIGNAL_SQL.format(cut=CUT) + ", s1 as (select user_id, idx, flag high, (value <= 15)::int low from signal), " + bouts_sql("high", "s1", "bh") + ", " + bouts_sql("low", "s1", "bl") + f""",
u as (select user_id, 0 k, 'high' behaviour, s, e from bh union all select user_id, 1, 'low', s, e from bl)
select user_id, behaviour, s / {FPS} start_s, (e + 1) / {FPS} end_s, printf('B%05d', row_number() over (partition by user_id order by k, s)) id from u"""
)
def interval_manifest(spark, sf_dir):
    df = signal(spark, sf_dir, CUT).select("user_id", F.col("idx").alias("sidx"), F.col("flag").alias("high"), (F.col("value") <= 15).cast("int").alias("low"))
    return L.intervals(df, ["high", "low"], USER, FPS)


_SCORED = [("flee", "value % 11 < 1"), ("chase", "value % 7 < 1"), ("activeAvoid", "value % 5 < 1"), ("follow", "value % 3 < 1"), ("statProx", "value % 2 < 1"), ("ho", "value > 95")]


@query(
    "with " + SIGNAL_SQL.format(cut=CUT) + " select user_id, idx, case when value > 95 then 10.0 when value % 11 < 1 then -10.0 when value % 7 < 1 then 8.0 when value % 5 < 1 then -7.0 when value % 3 < 1 then 5.0 when value % 2 < 1 then 2.0 else 0.5 end::double score from signal"
)
def social_scores(spark, sf_dir):
    flags = {n: F.expr(f"cast({c} as int)") for n, c in _SCORED}
    # at equal strength the order of precedence decides; here the head is asked first
    score = F.when(flags["ho"] == 1, 10.0).otherwise(L.social_score({k: v for k, v in flags.items() if k != "ho"}, F.lit(0.5)))
    return signal(spark, sf_dir, CUT).select("user_id", "idx", score.alias("score"))


@query(
    "with " + SIGNAL_SQL.format(cut=CUT) + ", " + fill_sql("flag", round(0.3 * FPS * 1.1), "signal", "l1") + ", " + drop_sql("flag", round(FPS * 0.9), "l1", "l2") + f" select user_id, sum((flag >= 1)::int) / {FPS} as seconds from l2 group by 1"
)
def legacy_filtered_seconds(spark, sf_dir):
    df = signal(spark, sf_dir, CUT).withColumnRenamed("idx", "sidx")
    return L.total_seconds(L.filtered(df, ["flag"], USER, FPS), "flag", USER, FPS)


@query(
    "with " + SIGNAL_SQL.format(cut=CUT) + ", n as (select user_id, idx, row_number() over (partition by user_id order by idx) - 1 i from signal where flag = 1) select user_id, (i // 2)::bigint clip, min(idx)::int as \"start\", max(idx)::int as \"end\" from n group by 1, 2 having count(*) = 2"
)
def legacy_alternate_frames(spark, sf_dir):
    return L.alternate_frames(signal(spark, sf_dir, CUT).withColumnRenamed("idx", "sidx"), "flag", USER)


@query(
    "with " + SIGNAL_SQL.format(cut=CUT) + f", w as (select *, value - coalesce(lag(value, 5) over w, value) lagged, stddev_pop(value) over (partition by user_id order by idx rows between 5 preceding and 1 preceding) sd, case when idx < 20 then 0 else flag end gated, (max((value > 90)::int) over (partition by user_id order by idx rows between current row and 5 following) > 0)::int soon from signal window w as (partition by user_id order by idx)) "
    "select user_id, idx, round(lagged, 4) + 0.0 lagged, round(sd, 3) sd, gated, soon from w"
)
def legacy_windows(spark, sf_dir):
    from pyspark.sql import Window

    from ..operators import windows as W

    df, w, c = signal(spark, sf_dir, CUT).withColumn("sidx", F.col("idx")), Window.partitionBy("user_id").orderBy("idx"), F.col
    return df.select("user_id", "idx", (F.round(L.lagged(c("value"), w, 5), 4) + 0.0).alias("lagged"), F.round(L.trailing_std(c("value"), w, 5), 3).alias("sd"), L.gate(c("flag"), FPS, 2.0).alias("gated"), W.soon(c("value") > 90, w, 5).cast("int").alias("soon"))
