"""Tables written to the folder that driver and executors share: lineage ends there, and a later plan reads them back in order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets one of its own; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="colblocks-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor never recomputes what stands before them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/colblocks-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(folder)
        store.deleteOnExit(folder)  # lazy results read these tables as long as the session lives

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that no later step reads."""
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
