"""An extension of our own: findings kept current while fetch records stream in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.operators.findings import run_rules
from sitefold.operators.rules import FAMILIES, canonical_presence, redirect_resolution, robots_effective, sitemap_indexability
from sitefold.operators.state import Site, derive, with_defaults

#: Families that look at one row only, so a batch of changed rows is enough for them.
ROW_FAMILIES = (sitemap_indexability, canonical_presence, robots_effective, redirect_resolution)


def latest_states(changes: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A stream of state rows with ``seen_at`` and ``url_key``; late repeats within the watermark are dropped."""
    return changes.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["url_key", "seen_at"])


def row_findings(states: DataFrame) -> DataFrame:
    """Findings of the families that need no other row."""
    return run_rules(Site(derive(with_defaults(states))), ROW_FAMILIES)


def evaluate_batches(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, watermark: str = "1 hour"):
    """Starts a query that gives each batch's row findings, with the batch number, to ``sink``."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(row_findings(batch.drop("seen_at")).withColumn("epoch", F.lit(epoch)), epoch)

    return latest_states(changes, watermark).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def other_families() -> tuple:
    """Families that need the whole table; run them on a schedule."""
    return tuple(f for f in FAMILIES if f not in ROW_FAMILIES)
