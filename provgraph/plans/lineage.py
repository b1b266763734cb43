"""Cutting lineage in iterative plans."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes shuffle files as soon as the query that wrote them is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where ``spark.checkpoint.dir`` is unset, and all runs in one process (tests), a local one is made."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset; executors need a folder that all share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="provgraph-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and written to the session's checkpoint folder, from which later steps read."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Cuts:
    """Tables of one call in the session's checkpoint folder, compressed, where ``cut`` would take much disk.

    A written table leaves no shuffle files; ``drop`` deletes tables that nothing reads any more, and what
    is still there when the driver ends goes then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{_folder(spark).rstrip('/')}/cuts-{uuid.uuid4().hex}", {}
        self.tables: dict[str, str] = {}
        atexit.register(self._end)

    def put(self, df: DataFrame, by: str | None = None, parts: int = 0) -> DataFrame:
        """``by``: in so many buckets by that column (``df`` should be dealt out by it), which join without a shuffle."""
        path, before = f"{self.root}/{len(self.paths)}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            to = df.write.option("compression", "zstd")
            if by:
                name = f"cut_{uuid.uuid4().hex}"
                to.bucketBy(parts, by).option("path", path).saveAsTable(name, format="parquet")
                self.tables[path] = name
            else:
                to.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.table(name) if by else self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._remove(self.paths[id(table)][0])
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _remove(self, path: str) -> None:
        for at in [x for x in self.tables if x == path or path == self.root]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(at)}")
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _end(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._remove(self.root)
