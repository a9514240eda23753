"""What the operators of this subpackage share."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only in local mode, as in tests, and only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="seriesforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Writes the rows to a table of its own in the shared folder and reads them back: lineage ends there, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {"compression": "zstd"})).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_join(rows: DataFrame, found: DataFrame, on: list[str], count: str, by: list[str], pieces: int = 2000, least: int = 1000) -> DataFrame:
    """rows joined with found, which has one row for each key and in `count` how many of the rows have that key.

    A key with more than a `pieces`-th of all rows is dealt over several tasks by a hash of the columns `by`, and its row of
    found goes to each of them. There are fewer than `pieces` such keys whatever the data, so that list alone is broadcast.
    found is read twice: pass a stored table.
    """
    per = max(least, int(found.agg(F.sum(count)).first()[0] or 0) // pieces)
    hot = F.broadcast(found.where(F.col(count) > per).select(*on, F.ceil(F.col(count) / per).cast("long").alias("_g")))
    dealt = rows.join(hot, on, "left").withColumn("_s", F.when(F.col("_g").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*by), F.col("_g")))).drop("_g")
    copies = found.join(hot, on, "left").withColumn("_s", F.explode(F.when(F.col("_g").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)))).drop("_g", count)
    return dealt.join(copies, [*on, "_s"]).drop("_s")


def with_marks(docs: DataFrame, marks: DataFrame, key: str, mark: str) -> DataFrame:
    """docs with the column `mark` of marks (one row for each `key`) by doc_id. Rows with a null doc_id have none; they stay where they are,
    as an outer join would send them all to one task."""
    known = docs.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col(key), "left").drop(key)
    return known.unionByName(docs.where("doc_id IS NULL").withColumn(mark, F.lit(None).cast(marks.schema[mark].dataType)))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
