"""Intermediate tables in the folder that the driver and all executors share.

A session's tables are in one folder of its own, which goes when the driver's process ends or clean() is called; tables
whose readers are all stored themselves can go before, by discard().
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. In local mode without it (tests), a temporary folder; on a cluster, an error."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="herdlens-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


_cleaned: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/herdlens/{context.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_clean_at_exit, spark, folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends here and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for these tables. Only for tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def clean(spark: SparkSession) -> None:
    """Deletes all tables of this session. What was made from them can't be read any more."""
    _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _clean_at_exit(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, folder)
