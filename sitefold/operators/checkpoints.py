"""Reliable checkpoints, and further tables, in the folder that the session names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application. One is made only for local sessions that name none."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="sitefold-")
        context.setCheckpointDir(base)
    return context._jsc.sc().getCheckpointDir().get()


def fresh(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing uses yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed and kept where all executors can read it."""
    folder(frame.sparkSession)
    return frame.checkpoint()


class Tables:
    """Tables of one operator call, written below the checkpoint folder and read again: unlike a checkpoint, one is computed
    in a single job, and what it is partitioned by prunes its files. They are removed when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, fresh(spark, name)
        atexit.register(_remove, spark, self.root)

    def write(self, frame: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before; the folder is then left to its owner
        pass
