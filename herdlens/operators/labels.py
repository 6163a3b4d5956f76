"""Animals by name: labels of rows about an animal or a pair, and wide tables with labels as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Animals' names: of all sessions alike, in order of track, or a table (session, track, name).
Names = Sequence[str] | DataFrame


def _name(names: Sequence[str], track: Column) -> Column:
    """Of a track; t{track} if there are fewer names."""
    known = F.get(F.array(*[F.lit(n) for n in names]), track) if names else F.lit(None).cast("string")
    return F.coalesce(known, F.concat(F.lit("t"), track.cast("string")))


def _with_names(df: DataFrame, names: Names, tracks: dict[str, str]) -> DataFrame:
    """df with a column of the name for each track column."""
    if not isinstance(names, DataFrame):
        return df.withColumns({new: _name(names, F.col(t)) for t, new in tracks.items()})
    for t, new in tracks.items():  # the table has a row an animal: Spark broadcasts it if it is small
        one = names.groupBy("session", F.col("track").alias(t)).agg(F.min("name").alias(new))
        df = df.join(one, ["session", t], "left").withColumn(new, F.coalesce(new, F.concat(F.lit("t"), F.col(t).cast("string"))))
    return df


def labelled(df: DataFrame, names: Names) -> DataFrame:
    """df with `animal` where it has a track, and `pair` ("A vs B") where it has two (tA, tB); else df itself."""
    columns = df.columns
    if "track" in columns:
        df = _with_names(df, names, {"track": "animal"})
        return df.select(*[c for k in columns for c in ([k, "animal"] if k == "track" else [k]) if not (c == "animal" and k == "animal")])
    if "tA" in columns and "tB" in columns:
        df = _with_names(df, names, {"tA": "_nA", "tB": "_nB"}).withColumn("pair", F.concat_ws(" vs ", "_nA", "_nB"))
        return df.select(*[c for k in columns for c in ([k, "pair"] if k == "tB" else [k]) if not (c == "pair" and k == "pair")])
    return df


def wide(df: DataFrame, keys: Sequence[str], subjects: dict[str, Column], values: Sequence[str]) -> DataFrame:
    """One row for each of the keys with columns {subject}/{value}. subjects: label to the condition of its rows; they are
    given, so no pass is needed to find them and it is one aggregate."""
    return df.groupBy(*keys).agg(*[F.max(F.when(condition, F.col(v))).alias(f"{label}/{v}") for label, condition in subjects.items() for v in values])


def pair_subjects(tracks: Sequence[int], names: Sequence[str] = ()) -> dict[str, Column]:
    """{A}_vs_{B} of all pairs of tracks."""
    label = lambda t: names[t] if t < len(names) else f"t{t}"
    return {f"{label(a)}_vs_{label(b)}": (F.col("tA") == a) & (F.col("tB") == b) for i, a in enumerate(tracks) for b in tracks[i + 1 :]}


def animal_subjects(tracks: Sequence[int], names: Sequence[str] = ()) -> dict[str, Column]:
    return {(names[t] if t < len(names) else f"t{t}"): F.col("track") == t for t in tracks}
