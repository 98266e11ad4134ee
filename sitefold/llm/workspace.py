"""Tables that an operator writes between its steps, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a new temporary one where it is unset (local runs only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sitefold-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(_remove, spark, folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    except Exception:  # the session may have ended before; the folder is then left to its owner
        pass


class Workspace:
    """Written tables of one operator call. ``write`` cuts lineage: a lost executor costs a file read, not a recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/sitefold-{label}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.root)

    def write(self, frame: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")


def bound_arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Keep Arrow batches small enough for long texts: at most so many rows and about so many bytes each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def spread_join(left: DataFrame, counted: DataFrame, by: Column, parts: int = 4096) -> DataFrame:
    """``left`` joined with ``counted (key, n, ...)``, which has one row for each key and says how many rows of ``left`` have it.

    A key with more than one of ``parts`` shares of these rows is dealt out over as many tasks as it has shares, by the hash
    ``by``. There can be no more than ``parts`` such keys, so they are broadcast.
    """
    share = max(1, (counted.agg(F.sum("n")).first()[0] or 0) // parts)
    hot = F.broadcast(counted.where(F.col("n") > share).select("key", F.expr(f"cast(ceil(n / {share}D) AS int)").alias("tasks")))
    dealt = left.join(hot, "key", "left").withColumn("task", F.pmod(by, F.coalesce("tasks", F.lit(1))).cast("int")).drop("tasks")
    copies = counted.withColumn("task", F.explode(F.expr(f"sequence(0, CASE WHEN n > {share} THEN cast(ceil(n / {share}D) AS int) ELSE 1 END - 1)"))).drop("n")
    return dealt.join(copies, ["key", "task"]).drop("task")
