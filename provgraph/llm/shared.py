"""The folder that driver and executors share, and tables written there to cut lineage.

A table staged here survives the loss of any executor: later reads go to its files, never to an
executor's own disk. The folder is the session's ``spark.checkpoint.dir``; only where a session has
none (tests on one machine) is a local one made.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset, and all runs in one process, a fresh local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset; executors need a folder that all share")
        found = "file://" + tempfile.mkdtemp(prefix="provgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Whether Spark deletes shuffle files as soon as the query that wrote them is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Names and writes the staged tables of one operator call.

    ``put`` writes and rereads a table; ``drop`` deletes one that nothing reads any more. What is
    still there when the driver ends goes then, since a returned DataFrame may read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # a written table needs none of the shuffles that led to it
        try:
            df.write.option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))
        self.release()

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of jobs that are over.

        It does so only once the driver has collected its garbage, which on a large job may be long
        after the files are of any use.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _end(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            remove(self.spark, self.root)
