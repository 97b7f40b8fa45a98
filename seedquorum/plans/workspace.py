"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table, never by localCheckpoint: a lost executor costs a task, not the run.
The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a temporary one is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from seedquorum.plans.shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; set to a new temporary one if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="seedquorum-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Written tables of one call. ``write`` returns the table as read back and removes an earlier one of that name; ``drop``
    removes one; all go when Python ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        ship(spark)
        self.root = f"{shared_dir(spark)}/seedquorum/{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path, before = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}", self.paths.get(name)
        df.write.option("compression", compression).parquet(path)
        self.paths[name] = path
        if before:
            self._remove(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        if jvm is None or self.spark.sparkContext._jsc is None:
            return
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)

    def drop(self, name: str) -> None:
        if path := self.paths.pop(name, None):
            self._remove(path)

    def close(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # the JVM may be gone at exit; the folder is then the cluster's to clean
            pass
