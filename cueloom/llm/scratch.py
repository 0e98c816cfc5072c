"""Written intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
again: a lost executor costs a re-read, never a recomputation of the chain. The
shuffle files of the query that wrote a table go when the table is whole.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode without that setting, a new temporary folder.

    On a cluster without the setting this raises ValueError, as a machine-local
    folder would not be seen by the other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: With it, Spark deletes a query's shuffle files as soon as the query has ended.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that run inside leave no shuffle files; the session's own setting comes back afterwards."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


class Scratch:
    """Tables of one run of one operator, each written once under a name of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/cueloom-{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.last: dict[str, str] = {}

    def cut(self, df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
        """Writes ``df`` and returns the table read back."""
        self.count += 1
        path = f"{self.path}/{self.count:03d}-{tag}"
        with shuffles_freed(self.spark):
            df.write.option("compression", compression).parquet(path)
        self.last[tag] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, path: str | None) -> None:
        """Deletes a table of this run that no later plan reads."""
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets the driver forget the plans and generated classes of the queries that have ended; a long chain of queries keeps several hundred MB of them."""
        gc.collect()
        self.spark._jvm.System.gc()
