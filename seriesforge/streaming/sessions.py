"""Structured Streaming forms: gap sessions with a watermark, additive histograms, and latest-wins tables."""

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def session_counts(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """key, start, stop, n of gap sessions; rows later than the watermark are left out. Works on streams and on tables.

    Spark drops late rows by the watermark that held before the previous batch's rows were seen, so a late row may
    still be counted in the one batch after the watermark passed it.
    """
    zoned = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = zoned.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def tumbling_counts(events: DataFrame, key: str, ts: str, width: str, late: str) -> DataFrame:
    zoned = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return zoned.groupBy(key, F.window("_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def append_histogram(stream: DataFrame, key: str, x: str, width: float, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch writes its own partial histogram under its checkpoint's name and its number: a replayed batch replaces itself, and a
    stream that starts anew with another checkpoint adds to what is there."""
    own = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(key, F.floor(F.col(x) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        part.write.mode("overwrite").parquet(f"{path}/batch={own}-{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_histogram(spark, key: str, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(key, "bin").agg(F.sum("n").alias("n"))
