"""Joins whose hot keys are measured first and dealt out over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task takes, and the most keys that can have more: beyond it, the share grows with the rows.
SHARE = 50_000
HOT = 4096


def share_of(total: int, share: int = SHARE) -> int:
    return max(share, total // HOT)


def parts_of(n: str, share: int) -> str:
    """SQL: over how many tasks ``n`` rows are dealt."""
    return f"CAST(greatest(1, ceil({n} / {share}D)) AS int)"


def dealt_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None, share: int, by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key.

    ``counts (key, n)`` says how many rows a key has. A key with more than ``share`` of them is dealt out over as many tasks as it
    has shares, by the hash ``by``, and its row of the table is copied for each. Such keys are at most all rows divided by
    ``share``, so they are broadcast. Without counts no key is hot.
    """
    if counts is None:
        return rows.join(table, key, how)
    hot = F.broadcast(counts.where(F.col("n") > share).select(key, F.expr(parts_of("n", share)).alias("tasks")))
    left = rows.join(hot, key, "left").withColumn("task", F.pmod(by, F.coalesce("tasks", F.lit(1))).cast("int")).drop("tasks")
    right = table.join(hot, key, "left").withColumn("task", F.explode(F.expr("sequence(0, coalesce(tasks, 1) - 1)"))).drop("tasks")
    return left.join(right, [key, "task"], how).drop("task")
