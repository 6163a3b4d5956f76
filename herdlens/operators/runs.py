"""Runs of flags and labels: gaps and islands, bouts, state hold, onset gates.

`keys` name the series, `order` its frames; flags are integer columns (null counts as 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def run_ids(df: DataFrame, value: str, keys: Sequence[str], order: str, name: str = "run") -> DataFrame:
    """A number for each run of equal values, from 1 in each series; nulls are equal."""
    w = _w(keys, order)
    new = F.lag(F.lit(1)).over(w).isNull() | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn(f"_{name}", new.cast("int")).withColumn(name, F.sum(f"_{name}").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(f"_{name}")


def fill_gaps(df: DataFrame, flag: str, keys: Sequence[str], order: str, most: int, out: str | None = None) -> DataFrame:
    """Sets zeros of runs up to `most` frames between ones."""
    w = _w(keys, order)
    one = F.when(F.col(flag) == 1, F.row_number().over(w))
    df = df.withColumn("_one", one)
    before, after = F.last("_one", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_one", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    filled = F.when(F.coalesce(F.col(flag), F.lit(0)) == 1, 1).when(after - before - 1 <= most, 1).otherwise(0)
    return df.withColumn(out or flag, filled.cast("int")).drop("_one")


def drop_short(df: DataFrame, flag: str, keys: Sequence[str], order: str, least: int, out: str | None = None) -> DataFrame:
    """Clears runs of ones shorter than `least`."""
    df = run_ids(df, flag, keys, order, "_r")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_r"))
    return df.withColumn(out or flag, F.when((F.col(flag) == 1) & (size >= least), 1).otherwise(0).cast("int")).drop("_r")


def bouts(df: DataFrame, flag: str, keys: Sequence[str], order: str) -> DataFrame:
    """keys, bout (from 1), start, end (inclusive), n: one row for each run of ones."""
    w = _w(keys, order)
    start = (F.coalesce(F.col(flag), F.lit(0)) == 1) & (F.coalesce(F.lag(flag).over(w), F.lit(0)) != 1)
    numbered = df.withColumn("_s", start.cast("int")).withColumn("bout", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where(F.col(flag) == 1).groupBy(*keys, "bout").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))


def detect_bouts(df: DataFrame, flag: str, keys: Sequence[str], order: str, fps: float, gap_s: float = 0.25, least_s: float = 0.8) -> DataFrame:
    """Bouts of a flag with short gaps bridged and short runs left out. Spans are rounded to even on the driver."""
    gap, least = max(1, round(gap_s * fps)), max(1, round(least_s * fps))
    bridged = fill_gaps(df, flag, keys, order, gap, "_b")
    return bouts(drop_short(bridged, "_b", keys, order, least), "_b", keys, order)


def bout_stats(found: DataFrame, keys: Sequence[str], fps: float) -> DataFrame:
    return found.groupBy(*keys).agg(F.count("*").alias("n_bouts"), (F.sum("n") / fps).alias("total_s"), (F.avg("n") / fps).alias("mean_s"))


def state_hold(df: DataFrame, label: str, keys: Sequence[str], order: str, least: int, out: str | None = None) -> DataFrame:
    """Runs shorter than `least` take the last long run's label, or the next one's; unchanged if there is no long run."""
    w = _w(keys, order)
    df = run_ids(df, label, keys, order, "_r").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_r")))
    df = df.withColumn("_c", F.when(F.col("_n") >= least, F.col(label)))
    held = F.coalesce(F.last("_c", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_c", True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col(label))
    return df.withColumn(out or label, held).drop("_r", "_n", "_c")


def onset_gate(df: DataFrame, flag: str, keys: Sequence[str], order: str, gap: int, passes: Column, first: int = 3, out: str | None = None) -> DataFrame:
    """Bridges gaps, then clears each bout in whose first frames `passes` never holds."""
    name = out or flag
    df = run_ids(fill_gaps(df, flag, keys, order, gap, name), name, keys, order, "_r")
    place = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(order))
    df = df.withColumn("_p", ((place <= first) & F.coalesce(passes, F.lit(False))).cast("int"))
    gated = F.max("_p").over(Window.partitionBy(*keys, "_r"))
    return df.withColumn(name, F.when((F.col(name) == 1) & (gated == 1), 1).otherwise(0)).drop("_r", "_p")


def gates(df: DataFrame, flags: dict[str, tuple[Column, int, Column | None]], keys: Sequence[str], order: str, first: int = 3) -> DataFrame:
    """Many flags at once: name -> (raw condition, gap to bridge, what must hold in a bout's first frames, if anything).

    As fill_gaps and onset_gate, but every step is over the one window of the series, so all flags share its sort. A
    bout's first frames are at most `first` rows away from any frame that still needs to know of them.
    """
    w = _w(keys, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    c, columns = F.col, [*df.columns]
    df = df.withColumns({"_n": F.row_number().over(w), **{n: F.coalesce(raw, F.lit(False)).cast("int") for n, (raw, _, _) in flags.items()}})
    df = df.withColumns({f"_1_{n}": F.when(c(n) == 1, c("_n")) for n in flags})
    df = df.withColumns({n: F.when(c(n) == 1, 1).when(F.first(f"_1_{n}", True).over(ahead) - F.last(f"_1_{n}", True).over(back) - 1 <= gap, 1).otherwise(0) for n, (_, gap, _) in flags.items()})
    gated = {n: passes for n, (_, _, passes) in flags.items() if passes is not None}
    if gated:
        df = df.withColumns({f"_s_{n}": F.when((c(n) == 1) & (F.coalesce(F.lag(n).over(w), F.lit(0)) != 1), c("_n")) for n in gated})
        df = df.withColumns({f"_b_{n}": F.last(f"_s_{n}", True).over(back) for n in gated})
        df = df.withColumns({f"_p_{n}": F.when((c(n) == 1) & (c("_n") - c(f"_b_{n}") < first) & F.coalesce(passes, F.lit(False)), c(f"_b_{n}")) for n, passes in gated.items()})
        seen = {}
        for n in gated:
            hit = F.coalesce(F.last(f"_p_{n}", True).over(back) == c(f"_b_{n}"), F.lit(False))
            for k in range(1, first):
                hit = hit | F.coalesce(F.lead(f"_p_{n}", k).over(w) == c(f"_b_{n}"), F.lit(False))
            seen[n] = F.when((c(n) == 1) & hit, 1).otherwise(0)
        df = df.withColumns(seen)
    return df.select(*[x for x in columns if x not in flags], *flags)


def onsets(flag: Column, w) -> Column:
    """Whether a run of ones begins here."""
    return (flag == 1) & (F.coalesce(F.lag(flag).over(w), F.lit(0)) != 1)


def masked(flag: Column, value: Column) -> Column:
    return F.when(flag == 1, value)


def second_marks(df: DataFrame, near: str, keys: Sequence[str], order: str, time: str, fps: float) -> DataFrame:
    """keys, second, mark: whether a bout (0.1 s gaps bridged, 1 s at least) fills most of a second or, at a tie, begins in it."""
    df = fill_gaps(df, near, keys, order, max(1, round(0.1 * fps)), "_f")
    df = drop_short(df, "_f", keys, order, max(1, round(fps)))
    df = df.withColumn("_o", onsets(F.col("_f"), _w(keys, order)).cast("int"))
    per = df.groupBy(*keys, F.floor(F.col(time) / fps).alias("second")).agg(F.sum("_f").alias("n"), F.max("_o").alias("o"))
    full = round(fps)
    return per.select(*keys, "second", F.when((2 * F.col("n") > full) | ((2 * F.col("n") == full) & (F.col("o") == 1)), 1).otherwise(0).alias("mark"))
