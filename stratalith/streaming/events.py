"""Event streams: watermarked windows, sessions and a running step function; the same plan runs in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    d = df.withColumn("_t", F.col(ts).cast("timestamp"))
    return d.withWatermark("_t", late) if df.isStreaming else d


def windowed(df: DataFrame, ts: str, value: str, size: str, slide: str | None = None, by: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, sum, min and max of tumbling (or sliding) windows."""
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    g = _timed(df, ts, late).groupBy(w.alias("w"), *([by] if by else [])).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *([by] if by else []), "n", "total", "lo", "hi")


def sessions(df: DataFrame, ts: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    g = _timed(df, ts, late).groupBy(F.session_window("_t", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def drain(df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over all there is and return what it gave."""
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
