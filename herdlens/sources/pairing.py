"""Finding the tracking file of each video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, dir, stem of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower(name).endswith(s)
    return files.where(wanted).select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))


def match(videos: DataFrame, files: DataFrame) -> DataFrame:
    """videos (stem, dir) with matched_id: the best file (stem, dir, id) whose stem begins with the video's, any case.

    Same folder first, then equal stems, then the shortest. A file stands for each of its stem's prefixes, so the join is
    on equal strings: names that begin alike don't meet in one task.
    """
    v = videos.select("stem", "dir", F.lower("stem").alias("_k"))
    f = files.select(F.col("stem").alias("_stem"), F.col("dir").alias("_dir"), F.col("id").alias("matched_id"), F.lower("stem").alias("_low"))
    f = f.withColumn("_k", F.explode(F.transform(F.sequence(F.lit(0), F.length("_low")), lambda n: F.substring("_low", F.lit(1), n))))
    found = v.join(f, "_k")
    rank = F.row_number().over(Window.partitionBy("stem", "dir").orderBy(F.desc(F.col("_dir") == F.col("dir")), F.desc(F.col("_low") == F.col("_k")), F.length("_stem"), "_stem", "matched_id"))
    best = found.withColumn("_r", rank).where("_r = 1").select("stem", "dir", "matched_id")
    return videos.join(best, ["stem", "dir"], "left")
