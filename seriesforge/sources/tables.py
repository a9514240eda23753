"""Reading the driver's tables by any path that Spark can open, keeping tables, and cutting lineage in the shared folder."""

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
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


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder: lineage ends there. Unlike a checkpoint's, its size is known to the planner; that of a
    checkpoint is the estimate of the plan before it, which multiplies from round to round of a loop."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys are equal; the right side's keys are not in the result."""
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_k_{k}"]) for k in keys])
    return left.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


class TableSet:
    """Derived tables in a folder: rebuilt as a whole, swapped in by a rename, with names that may never be replaced.

    A table is a folder `name/version-<id>`, and a file `name/CURRENT-<id>` says which version counts, so a reader sees the old
    rows or the new ones and a rebuild that dies leaves the old ones. Versions before the current one are deleted after the swap.
    """

    def __init__(self, spark: SparkSession, path: str, protected: tuple[str, ...] = ()):
        self.spark, self.path, self.protected = spark, path.rstrip("/"), protected

    def _files(self):
        jvm = self.spark._jvm
        path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path().getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _marks(self, name: str) -> list:
        files, path = self._files()
        return sorted(files.globStatus(path(name, "CURRENT-*")) or [], key=lambda x: (x.getModificationTime(), x.getPath().getName()))

    def names(self) -> list[str]:
        files, path = self._files()
        return sorted({x.getPath().getParent().getName() for x in files.globStatus(path("*", "CURRENT-*")) or []})

    def swap(self, name: str, rows: DataFrame) -> None:
        """Replaces a table; creates it if there is none."""
        if name in self.protected:
            raise ValueError(f"{name} is protected")
        files, path = self._files()
        version, before = uuid.uuid4().hex, self._marks(name)
        rows.write.parquet(f"{self.path}/{name}/version-{version}")
        files.create(path(name, f"CURRENT-{version}"), False).close()
        for mark in before:
            old = mark.getPath().getName()[len("CURRENT-") :]
            files.delete(mark.getPath(), False)
            files.delete(path(name, f"version-{old}"), True)

    def create(self, name: str, rows: DataFrame, replace: bool = False) -> None:
        """A snapshot: refuses to overwrite unless told to."""
        if self._marks(name) and not replace:
            raise ValueError(f"{name} is there already")
        self.swap(name, rows)

    def read(self, name: str) -> DataFrame:
        marks = self._marks(name)
        if not marks:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{name}/version-{marks[-1].getPath().getName()[len('CURRENT-') :]}")

    def delete(self, name: str, where: str) -> None:
        """DELETE: rows for which the condition is true go; those for which it is NULL stay."""
        self.swap(name, self.read(name).where(~F.coalesce(F.expr(where), F.lit(False))))

    def update(self, name: str, where: str, values: dict[str, str]) -> None:
        rows = self.read(name)
        self.swap(name, rows.withColumns({k: F.when(F.expr(where), F.expr(v)).otherwise(F.col(k)).cast(rows.schema[k].dataType) for k, v in values.items()}))

    def add_column(self, name: str, column: str, kind: str, value: str = "NULL") -> None:
        self.swap(name, self.read(name).withColumn(column, F.expr(value).cast(kind)))

    def rename(self, name: str, to: str) -> None:
        self.create(to, self.read(name))
        files, path = self._files()
        files.delete(path(name), True)

    def carry(self, other: "TableSet", owned: list[str]) -> list[str]:
        """Copies the tables of another set that this stage does not own and does not have; gives their names."""
        missing = [n for n in other.names() if n not in owned and n not in self.names()]
        for n in missing:
            self.swap(n, other.read(n))
        return missing
