"""What is around bouts: initiator and disengager, indices, minute and cumulative windows, features of each bout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import feature_class
from . import runs as R
from .bins import aggregates, suffixes

KEYS = ("session", "tA", "tB")
#: Frames in a bucket of the interval join.
BUCKET = 256


def interval_join(spans: DataFrame, frames: DataFrame, keys: Sequence[str], start: str, end: str, at: str = "sidx", bucket: int = BUCKET) -> DataFrame:
    """spans with every frame of the same keys in [start, end].

    Both sides are bucketed by time, so the join is on equal keys and never compares all spans with all frames; a span
    is in as many buckets as it is long, a frame in one.
    """
    spread = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return spread.join(frames.withColumn("_bucket", F.floor(F.col(at) / bucket)), [*keys, "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def _attributed(bouts: DataFrame, spans: DataFrame, frames: DataFrame, angle_a: str, angle_b: str) -> DataFrame:
    """bouts with initiator and disengager by the mean angles in the frames of their spans (keys, bout, _s, _e, _side: 0
    before, 1 after). No frames count as 90 degrees each; A at a tie."""
    f = frames.select(*KEYS, "sidx", F.col(angle_a).alias("_a"), F.col(angle_b).alias("_b"))
    side = lambda c, k: F.avg(F.when(F.col("_side") == k, F.col(c)))
    means = interval_join(spans, f, KEYS, "_s", "_e").groupBy(*KEYS, "bout").agg(side("_a", 0).alias("a0"), side("_b", 0).alias("b0"), side("_a", 1).alias("a1"), side("_b", 1).alias("b1"))
    # rounded, so that ties don't hang on the order in which a mean was summed
    value = lambda c: F.round(F.coalesce(F.col(c), F.lit(90.0)), 9)
    joined = bouts.join(means, [*KEYS, "bout"], "left")
    return joined.withColumns({"initiator": F.when(value("a0") <= value("b0"), "A").otherwise("B"), "disengager": F.when(value("a1") >= value("b1"), "A").otherwise("B")}).drop("a0", "b0", "a1", "b1")


def with_initiators(bouts: DataFrame, frames: DataFrame, fps: float, before_s: float = 0.3, after_s: float = 0.5, angle_a: str = "fe_A", angle_b: str = "fe_B") -> DataFrame:
    """bouts with initiator and disengager ('A' or 'B'): who faced the other more closely in the frames up to the onset,
    and who faced away more in the frames after the end."""
    pre, post = max(1, round(before_s * fps)), max(1, round(after_s * fps))
    base = bouts.select(*KEYS, "bout", "start", "end")
    spans = base.select(*KEYS, "bout", F.greatest(F.lit(0), F.col("start") - pre).alias("_s"), F.col("start").alias("_e"), F.lit(0).alias("_side")).union(
        base.select(*KEYS, "bout", F.col("end") + 1, F.col("end") + post, F.lit(1))
    )
    return _attributed(bouts, spans, frames, angle_a, angle_b)


def flagged_bins(frames: DataFrame, flag: str, seconds: Column, fps: float, bin_s: float) -> DataFrame:
    """keys, place (from 0, over bins that have frames), bin, first and last sidx, {flag}: set in more than half of the
    frames that a bin has, or should have."""
    expected = max(1, round(fps * bin_s))
    per = frames.groupBy(*KEYS, F.floor(seconds / bin_s).cast("int").alias("bin")).agg(F.sum(flag).alias("_n"), F.count("*").alias("_all"), F.min("sidx").alias("first"), F.max("sidx").alias("last"))
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("bin")) - 1
    return per.select(*KEYS, place.alias("place"), "bin", "first", "last", (F.col("_n") / F.greatest(F.lit(expected), F.col("_all")) > 0.5).cast("int").alias(flag))


def binned_bouts(frames: DataFrame, flag: str, seconds: Column, fps: float, bin_s: float = 0.25, before: int = 2, after: int = 3, angle_a: str = "fe_A", angle_b: str = "fe_B") -> DataFrame:
    """Bouts of bins with initiator and disengager: bout, start, end (places of bins), start_s, and last_s of the pair.

    Angles are averaged over all frames from the first to the last of the bins: those up to `before` ahead of the onset
    with its own, and up to `after` behind the end; a bout at the very end takes its own last two.
    """
    bins = flagged_bins(frames, flag, seconds, fps, bin_s)
    found = R.bouts(bins, flag, KEYS, "place")
    ends = bins.groupBy(*KEYS).agg(F.max("place").alias("_last"), F.max("bin").alias("_bin"))
    found = found.join(ends, list(KEYS))
    at_end = F.col("end") == F.col("_last")
    near = found.select(*KEYS, "bout", F.greatest(F.lit(0), F.col("start") - before).alias("_s"), F.col("start").alias("_e"), F.lit(0).alias("_side")).union(
        found.select(*KEYS, "bout", F.when(at_end, F.greatest(F.lit(0), F.col("end") - 1)).otherwise(F.col("end") + 1), F.when(at_end, F.col("end")).otherwise(F.least(F.col("_last"), F.col("end") + after)), F.lit(1))
    )
    spans = interval_join(near, bins.select(*KEYS, "place", "first", "last"), KEYS, "_s", "_e", "place").groupBy(*KEYS, "bout", "_side").agg(F.min("first").alias("_s"), F.max("last").alias("_e"))
    start = bins.select(*KEYS, F.col("place").alias("start"), (F.col("bin") * bin_s).alias("start_s"))
    named = _attributed(found, spans, frames, angle_a, angle_b).join(start, [*KEYS, "start"])
    return named.withColumn("last_s", F.col("_bin") * bin_s).drop("_last", "_bin")


def binned_indices(frames: DataFrame, flag: str, seconds: Column, fps: float, bin_s: float = 0.25, short_s: float = 3.0) -> DataFrame:
    """keys, scope, number and the indices of bouts of bins, of the windows that have any: every minute begun by the last
    bin's start, all minutes so far, and the whole."""
    found = binned_bouts(frames, flag, seconds, fps, bin_s)
    minutes = (F.floor(F.col("last_s") / 60) + 1) * 60
    return indices(windowed(found, F.col("start_s"), minutes), [*KEYS, "scope", "number"], 1 / bin_s, short_s)


def indices(bouts: DataFrame, keys: Sequence[str], fps: float, short_s: float = 3.0) -> DataFrame:
    """keys, n_bouts and for A: EI (share initiated), RI (share initiated by A after one by B), RTI (share of bouts of up
    to short_s that B initiated and A left). Alternation is between bouts of the same group; null without bouts."""
    w = Window.partitionBy(*keys).orderBy("start", "bout")
    rows = bouts.withColumn("_prev", F.lag("initiator").over(w))
    share = lambda c: F.round(F.sum(c.cast("int")) / F.count(F.lit(1)), 4)
    mine, was = F.col("initiator") == "A", F.coalesce(F.col("_prev") == "B", F.lit(False))
    short = (F.col("end") - F.col("start") + 1) / fps <= short_s
    return rows.groupBy(*keys).agg(F.count("*").alias("n_bouts"), share(mine).alias("EI"), share(mine & was).alias("RI"), share(short & ~mine & (F.col("disengager") == "A")).alias("RTI"))


def with_last_second(table: DataFrame, frames: DataFrame, seconds: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """table with last_second: the highest `seconds` of the frames of the same keys; null without frames."""
    return table.join(frames.groupBy(*keys).agg(F.max(seconds).cast("double").alias("last_second")), list(keys), "left")


def _minutes(last_second: float | Column) -> Column:
    """Minutes begun until then, one at least."""
    last = last_second if isinstance(last_second, Column) else F.lit(float(last_second))
    return F.greatest(F.lit(1), F.ceil(last / 60).cast("int"))


def windowed(bouts: DataFrame, seconds: Column, last_second: float | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each bout once for its minute, for every cumulative window that holds it, and for the whole session.

    scope 'minute' or 'cumulative' with number i (0-based minute, minutes so far), or 'full'. last_second says how long
    the session is: with_last_second takes it from each session's frames. A bout at the very end of a last whole minute
    is in 'full' only.
    """
    n = _minutes(last_second)
    minute = F.floor(seconds / 60).cast("int")
    rows = bouts.withColumn("_m", minute)
    kinds = F.when(
        F.col("_m") < n,
        F.concat(
            F.array(F.struct(F.lit("full").alias("scope"), F.lit(0).alias("number")), F.struct(F.lit("minute").alias("scope"), F.col("_m").alias("number"))),
            F.transform(F.sequence(F.col("_m") + 1, n), lambda i: F.struct(F.lit("cumulative").alias("scope"), i.alias("number"))),
        ),
    ).otherwise(F.array(F.struct(F.lit("full").alias("scope"), F.lit(0).alias("number"))))
    return rows.withColumn("_k", F.explode(kinds)).select(*bouts.columns, F.col("_k.scope").alias("scope"), F.col("_k.number").alias("number"))


def spine(pairs: DataFrame, last_second: float | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """All windows of all pairs, so that those without bouts are kept by a left join."""
    kind = lambda s: lambda i: F.struct(F.lit(s).alias("scope"), i.alias("number"))
    minutes = F.sequence(F.lit(1), F.col("_n"))
    windows = F.concat(F.array(kind("full")(F.lit(0))), F.transform(minutes, lambda i: kind("minute")(i - 1)), F.transform(minutes, kind("cumulative")))
    return pairs.select(*keys, _minutes(last_second).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("_n")).withColumn("_k", F.explode(windows)).select(*keys, F.col("_k.scope").alias("scope"), F.col("_k.number").alias("number"))


def with_video_time(bouts: DataFrame, frame_map: DataFrame, fps: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """bouts with `vframe`, the first video frame that shows the bout's first data row, and `onset_s`, when that is.

    frame_map: session, vframe, sidx. A data row can be shown by several video frames, or by none: such bouts go.
    """
    first = frame_map.groupBy("session", F.col("sidx").alias("start")).agg(F.min("vframe").alias("vframe"))
    return bouts.join(first, ["session", "start"]).withColumn("onset_s", F.col("vframe") / fps).select(*bouts.columns, "vframe", "onset_s")


def active(frames: DataFrame, kinds: dict[str, DataFrame], keys: Sequence[str] = KEYS, order: str = "sidx") -> DataFrame:
    """keys, order of every frame with the bout that it is in: kind, start and end, of the first kind that has one; null
    outside of bouts. kinds: name to bouts (keys, start, end), in order of precedence."""
    every = None
    for rank, (kind, bouts) in enumerate(kinds.items()):
        part = bouts.select(*keys, "start", "end", F.lit(rank).alias("_rank"), F.lit(kind).alias("kind"))
        every = part if every is None else every.unionByName(part)
    where = frames.select(*keys, order)
    inside = interval_join(every, where, keys, "start", "end").groupBy(*keys, order).agg(F.min_by(F.struct("kind", "start", "end"), "_rank").alias("_b"))
    return where.join(inside, [*keys, order], "left").select(*keys, order, "_b.kind", "_b.start", "_b.end")


def summary(df: DataFrame, flags: Sequence[str], keys: Sequence[str], order: str, fps: float) -> DataFrame:
    """keys, behaviour, seconds, n_bouts of each flag: run starts are counted, so no bout table is built."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = df.withColumns({f"_{f}": ((F.col(f) == 1) & (F.coalesce(F.lag(f).over(w), F.lit(0)) != 1)).cast("int") for f in flags})
    sums = starts.groupBy(*keys).agg(*[F.sum(f).alias(f) for f in flags], *[F.sum(f"_{f}").alias(f"_{f}") for f in flags])
    rows = F.array(*[F.struct(F.lit(f).alias("behaviour"), F.round(F.col(f) / fps, 4).alias("seconds"), F.col(f"_{f}").alias("n_bouts")) for f in flags])
    return sums.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def engagement(df: DataFrame, fps: float, keys: Sequence[str] = KEYS, order: str = "sidx") -> DataFrame:
    """keys, engagement_s, n_engagement_bouts, mean onset speeds of A and B (px a frame), ED_index (engaged over
    disengaged frames; null without the latter). df: Engaged, Disengaged, EngageOnsetSpeed_A and _B."""
    w = Window.partitionBy(*keys).orderBy(order)
    onset = ((F.col("Engaged") == 1) & (F.coalesce(F.lag("Engaged").over(w), F.lit(0)) != 1)).cast("int")
    sums = df.withColumn("_o", onset).groupBy(*keys).agg(F.sum("Engaged").alias("e"), F.sum("Disengaged").alias("d"), F.sum("_o").alias("o"), *[F.round(F.avg(f"EngageOnsetSpeed_{s}"), 3).alias(s) for s in "AB"])
    return sums.select(
        *keys, F.round(F.col("e") / fps, 2).alias("engagement_s"), F.col("o").alias("n_engagement_bouts"), F.col("A").alias("mean_engage_onset_spd_A"), F.col("B").alias("mean_engage_onset_spd_B"),
        F.round(F.col("e") / F.when(F.col("d") > 0, F.col("d")), 3).alias("ED_index"),
    )


def feature_table(bouts: DataFrame, frames: DataFrame, aggregates: Sequence[Column], keys: Sequence[str] = KEYS, least: int = 3) -> DataFrame:
    """One row a bout of at least that many frames, with aggregates of its frames' features."""
    long = bouts.where(F.col("n") >= least)
    columns = [c for c in bouts.columns]
    return interval_join(long, frames, keys, "start", "end").groupBy(*columns).agg(*aggregates)


def _bout_frames(frames: DataFrame, flags: Sequence[str], by_role: dict[str, str], of_pair: dict[str, str], keys: Sequence[str], order: str) -> DataFrame:
    """keys, order, behaviour (without direction), direction, bout and features as _v_{name}: a row a frame and flag that
    is set. by_role: A_{column} and B_{column} as actor_{name} and target_{name}; A acts unless the flag ends in _BtoA.

    Frames are numbered for all flags over one window and taken once for each flag that is set, so bouts and frames
    aren't joined.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    starts = frames.withColumns({f"_s_{f}": ((F.col(f) == 1) & (F.coalesce(F.lag(f).over(w), F.lit(0)) != 1)).cast("int") for f in flags})
    numbered = starts.withColumns({f"_b_{f}": F.sum(f"_s_{f}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for f in flags})
    plain = lambda f: f.removesuffix("_AtoB").removesuffix("_BtoA")
    each = F.array(*[F.when(F.col(f) == 1, F.struct(F.lit(plain(f)).alias("behaviour"), F.lit(f.rpartition("_")[2] if plain(f) != f else "").alias("direction"), F.col(f"_b_{f}").alias("bout"))) for f in flags])
    long = numbered.withColumn("_e", F.explode(F.filter(each, lambda e: e.isNotNull())))
    turned = F.col("_e.direction") == "BtoA"
    values = {f"{role}_{n}": F.when(turned, F.col(f"{b}_{f}")).otherwise(F.col(f"{a}_{f}")) for n, f in by_role.items() for role, a, b in (("actor", "A", "B"), ("target", "B", "A"))} | {n: F.col(f) for n, f in of_pair.items()}
    return long.select(*keys, order, "_e.*", *[v.alias(f"_v_{n}") for n, v in values.items()])


def _per_bout(rows: DataFrame, stats: Sequence[Column], fps: float, least: int, keys: Sequence[str], order: str, out: Sequence[Column]) -> DataFrame:
    per = rows.groupBy(*keys, "behaviour", "direction", "bout").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), *stats).where(F.col("n") >= least)
    group = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return per.select(*keys, "behaviour", "direction", "bout", "start", "end", F.round(F.col("n") / fps, 4).alias("duration_s"), group.alias("group"), *out)


def behaviour_table(frames: DataFrame, flags: Sequence[str], by_role: Sequence[str], of_pair: Sequence[str], fps: float, least: int = 3, keys: Sequence[str] = KEYS, order: str = "sidx") -> DataFrame:
    """One row a bout of at least `least` frames of any of the flags, with the features of its frames.

    keys, behaviour (without direction), direction, bout, start, end, duration_s, group (of the pair), and for every
    feature its median, 95th percentile and mean: actor_{f} and target_{f} of A_{f} and B_{f} (A acts unless the flag ends
    in _BtoA), and those of the pair.
    """
    rows = _bout_frames(frames, flags, {f: f for f in by_role}, {f: f for f in of_pair}, keys, order)
    names = [*[f"{r}_{f}" for f in by_role for r in ("actor", "target")], *of_pair]
    stats = [F.percentile(f"_v_{n}", F.array(F.lit(0.5), F.lit(0.95))).alias(f"_p_{n}") for n in names] + [F.avg(f"_v_{n}").alias(f"{n}_mean") for n in names]
    out = [c.alias(n) for f in names for n, c in ((f"{f}_p50", F.col(f"_p_{f}")[0]), (f"{f}_p95", F.col(f"_p_{f}")[1]), (f"{f}_mean", F.col(f"{f}_mean")))]
    return _per_bout(rows, stats, fps, least, keys, order, out)


def class_features(by_role: Sequence[str], of_pair: Sequence[str]) -> list[str]:
    """Names of the features that class_table makes, in order."""
    names = [(f"{r}_{n}", feature_class(n)) for n in by_role for r in ("actor", "target")] + [(n, feature_class(n)) for n in of_pair]
    return [f"{n}{suffix}" for n, kind in names for suffix in suffixes(kind)]


def class_table(frames: DataFrame, flags: Sequence[str], by_role: dict[str, str], of_pair: dict[str, str], fps: float, least: int = 3, keys: Sequence[str] = KEYS, order: str = "sidx") -> DataFrame:
    """As behaviour_table, with what each feature's class asks for: circular means of angles, median and 95th percentile
    of speeds and accelerations (of jerk their sizes), mean and median of distances, shares of flags, means of positions,
    shapes and others, nothing of categories.

    by_role and of_pair: feature name to column. The class goes by the name, as of bins. Values that are missing or not
    finite take no part, but flags' shares are of all frames. All classes and both roles are worked out in one pass.
    """
    rows = _bout_frames(frames, flags, by_role, of_pair, keys, order)
    kinds = {f"{r}_{n}": feature_class(n) for n in by_role for r in ("actor", "target")} | {n: feature_class(n) for n in of_pair}
    finite = {f"_v_{n}": F.when(~F.isnan(f"_v_{n}") & (F.abs(f"_v_{n}") < float("inf")), F.col(f"_v_{n}")) for n, kind in kinds.items() if kind not in ("categorical", "binary")}
    stats = [a for n, kind in kinds.items() for a in aggregates(f"_v_{n}", kind)]
    out = [F.col(f"_v_{n}{s}").alias(f"{n}{s}") for n, kind in kinds.items() for s in suffixes(kind)]
    return _per_bout(rows.withColumns(finite), stats, fps, least, keys, order, out)


def by_role(frames: DataFrame, features: Sequence[str], actor: str) -> DataFrame:
    """actor_{f} and target_{f} instead of A_{f} and B_{f}: `actor` is a column of 'A' or 'B'."""
    out = {}
    for f in features:
        a, b = F.col(f"A_{f}"), F.col(f"B_{f}")
        out[f"actor_{f}"], out[f"target_{f}"] = F.when(F.col(actor) == "A", a).otherwise(b), F.when(F.col(actor) == "A", b).otherwise(a)
    return frames.withColumns(out)
