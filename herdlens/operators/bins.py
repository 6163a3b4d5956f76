"""Time bins: aggregates by feature class, behaviour proportions, one-second roll-up, ten-second matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.angles import circular_mean, circular_mean_360
from ..functions.names import feature_class


def bin_index(vframe: Column, fps: float, seconds: float) -> Column:
    """Two divisions, as bins of frames that aren't whole ones need both roundings."""
    return F.floor(vframe / fps / seconds).cast("int")


def aggregates(name: str, kind: str | None = None) -> list[Column]:
    """What a bin keeps of a feature, by its class."""
    c, kind = F.col(name), kind or feature_class(name)
    half = lambda v: F.percentile(v, 0.5)
    if kind == "binary":
        return [(F.sum(F.coalesce(c, F.lit(0))) / F.count(F.lit(1))).alias(f"{name}_prop")]
    if kind == "categorical":
        return []
    if kind == "distance":
        return [F.avg(c).alias(f"{name}_mean"), half(c).alias(f"{name}_median")]
    if kind == "angular":
        return [circular_mean(c).alias(f"{name}_cmean")]
    if kind in ("velocity", "acceleration"):
        return [half(c).alias(f"{name}_p50"), F.percentile(c, 0.95).alias(f"{name}_p95")]
    if kind == "jerk":  # the sign says nothing
        return [F.abs(half(c)).alias(f"{name}_p50"), F.abs(F.percentile(c, 0.95)).alias(f"{name}_p95")]
    return [F.avg(c).alias(f"{name}_mean")]


def suffixes(kind: str) -> tuple[str, ...]:
    """Of the columns that aggregates makes for a class."""
    two = {"distance": ("_mean", "_median"), "velocity": ("_p50", "_p95"), "acceleration": ("_p50", "_p95"), "jerk": ("_p50", "_p95")}
    return two.get(kind) or {"binary": ("_prop",), "categorical": (), "angular": ("_cmean",)}.get(kind, ("_mean",))


def cov_corr(a: Column, b: Column) -> tuple[Column, Column]:
    """Sample covariance and correlation of a bin; no correlation if one doesn't vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    size = F.stddev_samp(x) * F.stddev_samp(y)
    return F.covar_samp(x, y), F.try_divide(F.covar_samp(x, y), F.when(size > 0, size))


def binned(df: DataFrame, keys: Sequence[str], features: Sequence[str], vframe: str, fps: float, seconds: float = 0.25, flags: Sequence[str] = ()) -> DataFrame:
    """keys, bin and each feature's aggregates. Flags are proportions of at least the bin's nominal frames."""
    nominal = round(fps * seconds)
    share = lambda f: (F.sum(F.coalesce(F.col(f), F.lit(0))) / F.greatest(F.lit(nominal), F.count(F.lit(1)))).alias(f"{f}_prop")
    aggs = [a for f in features for a in aggregates(f)] + [share(f) for f in flags]
    return df.groupBy(*keys, bin_index(F.col(vframe), fps, seconds).alias("bin")).agg(*aggs)


def rolled_up(bins: DataFrame, keys: Sequence[str], seconds: float = 0.25, into: float = 1.0) -> DataFrame:
    """Means of bins' values in larger bins (angles circular); proportions are left out. Not the same as binning frames anew."""
    per = into / seconds
    if abs(per - round(per)) > 1e-9:
        raise ValueError(f"{seconds} s doesn't divide {into} s")
    columns = [c for c in bins.columns if c not in {*keys, "bin"} and not c.endswith("_prop")]
    aggs = [(circular_mean(F.col(c)) if c.endswith("_cmean") else F.avg(c)).alias(c) for c in columns]
    return bins.groupBy(*keys, F.floor(F.col("bin") / round(per)).cast("int").alias("bin")).agg(*aggs)


def engaged_bins(bins: DataFrame, prop: str = "Engaged_prop") -> DataFrame:
    return bins.withColumn("engaged", F.when(F.col(prop) > 0.5, 1).otherwise(0))


def with_empty(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each bin from 0 to the last one of its keys, empty ones null."""
    last = bins.groupBy(*keys).agg(F.max("bin").alias("_last"))
    every = last.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("bin"))
    return every.join(bins, [*keys, "bin"], "left")


def feature_matrix(df: DataFrame, seconds: Column, metrics: dict[str, str], session: str = "session", track: str = "track", width: float = 10.0) -> DataFrame:
    """session, track, bin, metric, value, norm: ten-second means of metrics, empty bins kept.

    metrics: column -> 'range' (min to max over the session's animals), 'p95' (over the largest 95th percentile),
    'abs' (as range, of absolute values), 'angle' (circular, share of the circle) or 'plain'.
    """
    agg = {m: circular_mean_360(F.col(m)) if k == "angle" else F.avg(F.abs(F.col(m)) if k == "abs" else F.col(m)) for m, k in metrics.items()}
    bins = with_empty(df.groupBy(session, track, F.floor(seconds / width).cast("int").alias("bin")).agg(*[a.alias(m) for m, a in agg.items()]), [session, track])
    long = bins.select(session, track, "bin", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("r")).select(session, track, "bin", "r.*")
    bounds = long.groupBy(session, "metric").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    p95 = long.groupBy(session, track, "metric").agg(F.percentile("value", 0.95).alias("p")).groupBy(session, "metric").agg(F.max("p").alias("_p95"))
    long = long.join(bounds, [session, "metric"]).join(p95, [session, "metric"])
    kind = F.element_at(F.create_map(*[F.lit(x) for mk in metrics.items() for x in mk]), F.col("metric"))
    v = F.col("value")
    norm = F.when(kind == "angle", v / 360.0).when(kind == "p95", G.norm_p95(v, F.col("_p95"))).when(kind == "plain", G.clip01(v)).otherwise(G.norm_range(v, F.col("_lo"), F.col("_hi")))
    return long.select(session, track, "bin", "metric", "value", norm.alias("norm"))


def synchrony_matrix(pairs: DataFrame, seconds: Column, metrics: dict[str, str], width: float = 10.0, keys: Sequence[str] = ("session", "tA", "tB")) -> DataFrame:
    """keys, bin, metric, value, norm: as feature_matrix for pairs; 'corr' maps -1..1 to 0..1, 'far' turns distance to closeness."""
    agg = {m: F.avg(m) for m in metrics}
    bins = with_empty(pairs.groupBy(*keys, F.floor(seconds / width).cast("int").alias("bin")).agg(*[a.alias(m) for m, a in agg.items()]), list(keys))
    long = bins.select(*keys, "bin", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("r")).select(*keys, "bin", "r.*")
    w = long.groupBy(keys[0], "metric").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    kind = F.element_at(F.create_map(*[F.lit(x) for mk in metrics.items() for x in mk]), F.col("metric"))
    v, ranged = F.col("value"), G.norm_range(F.col("value"), F.col("_lo"), F.col("_hi"))
    norm = F.when(kind == "corr", G.norm_correlation(v)).when(kind == "far", 1 - ranged).otherwise(ranged)
    return long.join(w, [keys[0], "metric"]).select(*keys, "bin", "metric", "value", norm.alias("norm"))


def distance_curve(df: DataFrame, keys: Sequence[str], distance_cm: str, value: str) -> DataFrame:
    """keys, cm, n, mean: mean of a feature over frames with distance up to 1, 2, ... cm.

    Sums of each centimetre, then running sums: no frame meets more than one threshold.
    """
    known = df.where(F.col(distance_cm).isNotNull() & F.col(value).isNotNull())
    per = known.groupBy(*keys, F.greatest(F.lit(1), F.ceil(distance_cm)).cast("int").alias("cm")).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    last = known.groupBy(*keys).agg(F.floor(F.max(distance_cm)).cast("int").alias("_last"))
    every = last.where("_last >= 1").select(*keys, F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("cm"))
    rows = Window.partitionBy(*keys).orderBy("cm")
    out = every.join(per, [*keys, "cm"], "left").withColumns({"s": F.sum("s").over(rows), "n": F.coalesce(F.sum("n").over(rows), F.lit(0))})
    return out.select(*keys, "cm", F.col("n").cast("long").alias("n"), (F.col("s") / F.when(F.col("n") > 0, F.col("n"))).alias("mean"))


def downsample(df: DataFrame, keys: Sequence[str], order: str, most: int = 5000) -> DataFrame:
    """Up to `most` evenly spaced rows of each series, the first and last included."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    # row i is the rounded place of k if k is the nearest whole number to i's share
    k = F.round(F.col("_i") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.bround(k * (F.col("_n") - 1) / (most - 1)) == F.col("_i")
    return df.where((F.col("_n") <= most) | hit).drop("_i", "_n")
