"""How a query is registered: a function of (spark, sf_dir) with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    day = F.unix_date(F.col(ts).cast("date")).cast("long") * 86_400_000_000
    return day + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("long")


def seconds(ts: str) -> Column:
    return micros(ts) / 1e6


def timed(events: DataFrame) -> DataFrame:
    """events with t in seconds."""
    return events.withColumn("t", seconds("ts"))
