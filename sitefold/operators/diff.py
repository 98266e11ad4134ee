"""Comparison of two sites: lost, gained and changed URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.operators.state import Site


def lost(baseline: Site, candidate: Site) -> DataFrame:
    return baseline.state.select("url_key").join(candidate.state.select("url_key"), "url_key", "left_anti")


def gained(baseline: Site, candidate: Site) -> DataFrame:
    return lost(candidate, baseline)


def changes(baseline: Site, candidate: Site) -> DataFrame:
    """``(url_key, seq, kind, from_value, to_value)`` for URLs of both sites, one row per kind of change, in a fixed order.

    Statuses, headings, hreflang, sources and reachability are not compared. Comparisons are null-safe.
    """
    columns = ["effective_canonical", "is_indexable", "effective_robots", "word_count"]
    side = lambda s, p: s.state.select("url_key", *[F.col(c).alias(p + c) for c in columns], F.size("internal_links_out").alias(p + "links"))
    both = side(baseline, "b_").join(side(candidate, "c_"), "url_key")
    kinds = (("canonical_changed", "effective_canonical", True), ("index_changed", "is_indexable", True), ("robots_changed", "effective_robots", False), ("word_count_changed", "word_count", True), ("link_count_changed", "links", True))
    rows = []
    for seq, (kind, column, shown) in enumerate(kinds):
        values = f"cast(b_{column} AS string), cast(c_{column} AS string)" if shown else "cast(NULL AS string), cast(NULL AS string)"
        rows.append(f"CASE WHEN NOT (b_{column} <=> c_{column}) THEN struct({seq} AS seq, '{kind}' AS kind, {values}) END")
    found = both.selectExpr("url_key", f"explode(array_compact(array({','.join(rows)}))) AS x")
    return found.selectExpr("url_key", "x.seq AS seq", "x.kind AS kind", "x.col3 AS from_value", "x.col4 AS to_value")


def counts(baseline: Site, candidate: Site) -> DataFrame:
    """One row: indexable URLs of both sites, their difference, and numbers of lost, gained and changed URLs."""
    keys = lambda s, n: s.state.select("url_key", F.col("is_indexable").alias(n), F.lit(True).alias("has_" + n))
    both = keys(baseline, "b").join(keys(candidate, "c"), "url_key", "full_outer")
    changed = changes(baseline, candidate).select(F.countDistinct("url_key").alias("changed"))
    one = both.agg(
        F.count_if("b").alias("indexable_baseline"), F.count_if("c").alias("indexable_candidate"), (F.count_if("c") - F.count_if("b")).alias("delta"),
        F.count_if(F.col("has_c").isNull()).alias("lost"), F.count_if(F.col("has_b").isNull()).alias("gained"),
    )
    return one.join(F.broadcast(changed))


def check_same_base(baseline: Site, candidate: Site) -> None:
    if baseline.base_url.rstrip("/") != candidate.base_url.rstrip("/"):
        raise ValueError(f"baseline is of {baseline.base_url}, candidate of {candidate.base_url}")
