"""Event-time windows over a stream of (key, ts, value): the same definitions serve batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def tumbling(df: DataFrame, key: str, width: str, late: str = LATE) -> DataFrame:
    """key, start, n, mean: bins of event time. Rows later than the watermark allows are left out."""
    w = F.window("ts", width)
    return df.withWatermark("ts", late).groupBy(key, w).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(key, F.col("window.start").alias("start"), "n", "mean")


def sliding(df: DataFrame, key: str, width: str, slide: str, late: str = LATE) -> DataFrame:
    """As tumbling, with windows that overlap: a rolling mean at every `slide`."""
    w = F.window("ts", width, slide)
    return df.withWatermark("ts", late).groupBy(key, w).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(key, F.col("window.start").alias("start"), "n", "mean")


def bouts(df: DataFrame, key: str, active: Column, gap: str, late: str = LATE) -> DataFrame:
    """key, start, end, n: sessions of active rows that are less than `gap` apart."""
    w = F.session_window("ts", gap)
    return df.where(active).withWatermark("ts", late).groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def tally(df: DataFrame, key: str, active: Column, fps: float) -> DataFrame:
    """key, seconds: running time of active rows; the state is one number a key, kept in the JVM. For update mode."""
    return df.groupBy(key).agg((F.sum(F.coalesce(active, F.lit(False)).cast("int")) / fps).alias("seconds"))


def drained(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source has now, and reads what it wrote. With 'update', later rows of a key are in later batches (`batch`)."""
    from ..storage import fresh_path

    out, marks = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    run = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
