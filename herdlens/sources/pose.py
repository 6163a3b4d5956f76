"""Pose data as long tables: one row a frame, animal and node.

Long tables are read from Parquet or CSV; dense recordings by the data source in hdf5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "session string, sidx int, vframe int, track int, node int, x double, y double"


def read_long(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A long table with NaN as null; without vframe the row number is the video frame."""
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    df = reader.format(format).load(path)
    if "vframe" not in df.columns:
        df = df.withColumn("vframe", F.col("sidx"))
    typed = [c.split() for c in SCHEMA.split(", ")]
    out = df.select(*[F.col(n).cast(t).alias(n) for n, t in typed])
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("x", "y")})


def frame_map(pose: DataFrame) -> DataFrame:
    """session, vframe, sidx."""
    return pose.groupBy("session", "sidx").agg(F.min("vframe").alias("vframe")).select("session", "vframe", "sidx")
