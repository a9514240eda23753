"""Streaming operators, run over the events table as a finished stream."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from seriesforge.plans.base import query
from seriesforge.sources.tables import read_table, shared_dir
from seriesforge.streaming import sessions as X


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 7200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS block FROM g)
            SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, block, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1, 2""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = X.session_counts(read_table(spark, sf_dir, "events"), "user_id", "ts", "2 hours", "1 day")
    return out.groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))


@query("""SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2""")
def streamed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream into additive parts, then their sum."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    work = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # A file source reads a folder; the glob makes one of a single file too.
    stream = spark.readStream.schema(schema).parquet(f"{path}*")
    X.append_histogram(stream, "event_type", "value", 10.0, f"{work}/parts", f"{work}/log").awaitTermination()
    return X.read_histogram(spark, "event_type", f"{work}/parts")
