"""Connected components of an edge table, by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.workspace import Workspace

#: Edges whose labels one task writes, at least.
FILE_EDGES = 100_000


def connected_components(edges: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its smallest node.

    A round takes the smallest label among a node and its neighbours, then follows that label once more, so distances
    halve each time. Only partial minima and equi-joins are used: a node with a great many links is no bottleneck.
    Labels are written each round; the driver sees just the number of changes.
    """
    both = space.write(
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .where("src <> dst")
        .distinct(),
        f"{name}-edges",
    )
    labels = space.write(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).select(F.col("src").alias("node"), "label"), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = (
            both.join(labels, both.dst == labels.node)
            .groupBy("src").agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, labels.node == near.src, "left").select(
            "node", "label", F.least("label", F.coalesce("near", "label")).alias("low")
        )
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        after = space.write(
            hooked.join(up, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("label"), (F.least("low", F.coalesce("jump", "low")) < F.col("label")).alias("changed")),
            f"{name}-{k}",
        )
        done = after.where("changed").limit(1).count() == 0
        space.drop(f"{name}-{k - 1}")
        labels = after.select("node", "label")
        if done:
            space.drop(f"{name}-edges")
            return labels.withColumnRenamed("label", "component")


def linked_components(edges: DataFrame, n_edges: int, space: Workspace, name: str) -> DataFrame:
    """``(node, component)`` like ``connected_components``, for edges that cost little to read again.

    Nothing but the labels is written, and no round is spent on finding that nothing changes: whether an edge still joins
    two labels is looked up before. The first table follows the smallest neighbours once already, since most components of
    near copies are stars around a few heads. Labels are two numbers a node, so a task writes those of about FILE_EDGES
    edges at least, where all cores have work, rather than a file for each partition of a shuffle.
    """
    edges = edges.where("a <> b")
    both = edges.toDF("src", "dst").unionByName(edges.toDF("dst", "src"))
    files = max(space.spark.sparkContext.defaultParallelism, n_edges // FILE_EDGES)

    def jumped(lows: DataFrame, before: DataFrame, k: int) -> DataFrame:
        """Labels ``low``, each followed once more by those from before."""
        after = lows.join(before.toDF("low", "jump"), "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("label"))
        return space.write(after.coalesce(files), f"{name}-{k}")

    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")).withColumnRenamed("src", "node")
    labels = jumped(least, least, k := 0)
    while edges.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la <> lb").limit(1).count():
        near = both.join(labels.toDF("dst", "near"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("near").alias("near"))
        labels = jumped(labels.join(near, "node").select("node", F.least("label", "near").alias("low")), labels, k := k + 1)
        space.drop(f"{name}-{k - 1}")
    return labels.withColumnRenamed("label", "component")
