"""The URL-state table: one row per URL key, folded from discovery facts, and its derived columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions.robots import merge
from sitefold.operators.spread import share_of
from sitefold.schemas import ROBOTS, URL_STATE

#: Kinds of references, and SQL of the entries that a row has of each; what an entry lacks is null.
_ENTRY = "named_struct('kind', '{0}', 'pos', {1}, 'lang', {2}, 'target_url', {3})"
REFERENCES = {
    "canonical": f"CASE WHEN effective_canonical IS NOT NULL THEN array({_ENTRY.format('canonical', '0', 'cast(NULL AS string)', 'effective_canonical')}) ELSE array() END",
    "hreflang": f"transform(hreflang, (e, i) -> {_ENTRY.format('hreflang', 'i', 'e.lang', 'e.url')})",
    "link": f"transform(internal_links_out, (u, i) -> {_ENTRY.format('link', 'i', 'cast(NULL AS string)', 'u')})",
}


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


@dataclass
class Site:
    """A point-in-time table of URL states with its header."""

    state: DataFrame
    base_url: str = ""
    public_origin: str | None = None
    scanned_at: str | None = None
    _counts: tuple[DataFrame | None, int] | None = field(default=None, init=False, repr=False, compare=False)

    def cached(self) -> Site:
        """The same site with its states kept, for plans that read them many times."""
        return replace(self, state=self.state.persist())

    def references(self, kinds: tuple[str, ...] = tuple(REFERENCES)) -> DataFrame:
        """One row for each reference of a row to another one: ``(src_key, src_url, kind, pos, lang, target_url, target_key)``."""
        rows = self.state.selectExpr("url_key AS src_key", "url AS src_url", f"inline(concat({', '.join(REFERENCES[k] for k in kinds)}))")
        return rows.withColumn("target_key", F.regexp_replace("target_url", r"(?s)#.*$", ""))

    def reference_counts(self) -> tuple[DataFrame | None, int]:
        """``(target_key, n)`` of all references, and how many of one key a task takes. No counts where no key can have more, or
        where states are not cached, so that counting would compute them anew."""
        if not self.state.is_cached:
            return None, share_of(0)
        if self._counts is None:
            total = self.state.agg(F.sum(F.expr("size(hreflang) + size(internal_links_out) + 1L"))).head()[0] or 0
            share = share_of(total)
            self._counts = (self.references().groupBy("target_key").agg(F.count(F.lit(1)).alias("n")) if total > share else None), share
        return self._counts

    def links(self) -> DataFrame:
        return self.references(("link",)).select("src_key", "src_url", "pos", F.col("target_url").alias("link_url"), F.col("target_key").alias("link_key"))

    def hreflang(self) -> DataFrame:
        return self.references(("hreflang",)).select("src_key", "src_url", "pos", "lang", "target_url", "target_key")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Adds the columns of a URL state that ``rows`` lacks, and fills lists and flags that are null."""
    robots = ROBOTS.simpleString()
    fill = {
        "sources": "cast(array() AS array<string>)", "redirect_chain": "cast(array() AS array<string>)", "internal_links_out": "cast(array() AS array<string>)",
        "hreflang": "cast(array() AS array<struct<lang:string,url:string>>)", "robots_txt_status": "'NoRule'", "found_in_sitemap": "false", "is_indexable": "false", "is_reachable": "false",
    }
    out = []
    for field in URL_STATE:
        kind = robots if field.dataType == ROBOTS else field.dataType.simpleString()
        value = f"`{field.name}`" if field.name in rows.columns else f"cast(NULL AS {kind})"
        value = f"coalesce({value}, {fill[field.name]})" if field.name in fill else value
        out.append(f"cast({value} AS {kind}) AS {field.name}")
    return rows.selectExpr("url_key", *out)


def derive(state: DataFrame) -> DataFrame:
    """Effective canonical, effective robots and indexability.

    A page is indexable if nothing says noindex, robots.txt doesn't block it, it returned 200 and its canonical is absent
    or its own ``url`` (not its key: a url with a fragment never equals a canonical).
    """
    effective = (
        f"CASE WHEN html_meta_robots IS NULL AND http_x_robots_tag IS NULL THEN {_empty()}"
        f" WHEN html_meta_robots IS NULL THEN http_x_robots_tag WHEN http_x_robots_tag IS NULL THEN html_meta_robots ELSE {merge('html_meta_robots', 'http_x_robots_tag')} END"
    )
    named = state.withColumn("effective_canonical", F.coalesce("html_canonical", "http_canonical")).withColumn("effective_robots", F.expr(effective))
    indexable = "NOT coalesce(effective_robots.noindex, false) AND robots_txt_status <> 'Blocked' AND coalesce(http_status = 200, false) AND coalesce(effective_canonical = url, true)"
    return named.withColumn("is_indexable", F.expr(indexable))


def _empty() -> str:
    return "named_struct(" + ",".join(f"'{f.name}', cast(NULL AS {f.dataType.simpleString()})" for f in ROBOTS) + ")"


def fold_sources(facts: DataFrame) -> DataFrame:
    """``(url_key, url, sources)`` from discovery facts ``(url_key, url, source, prio)``: the first writer's url, and sources
    in the order in which they first came."""
    firsts = facts.groupBy("url_key", "source").agg(F.min("prio").alias("prio"), F.min_by("url", "prio").alias("url"))
    return firsts.groupBy("url_key").agg(
        F.min_by("url", "prio").alias("url"), F.expr("transform(array_sort(collect_list(struct(prio, source))), x -> x.source)").alias("sources")
    )


def statistics(state: DataFrame) -> DataFrame:
    """One row of counters."""
    return state.agg(
        F.count(F.lit(1)).alias("total_urls"), F.count_if("is_indexable").alias("indexable_urls"), (F.count(F.lit(1)) - F.count_if("is_indexable")).alias("non_indexable_urls"),
        F.count_if(F.col("is_indexable") & ~F.col("is_reachable")).alias("orphan_urls"), F.count_if("found_in_sitemap").alias("sitemap_urls"),
        F.count_if(F.array_contains("sources", "InternalLink")).alias("internal_link_urls"), F.count_if(F.col("redirect_target").isNotNull()).alias("redirect_urls"),
        F.count_if(F.coalesce(F.col("http_status") >= 400, F.lit(False))).alias("broken_urls"),
    )


def static_not_found(state: DataFrame, base_origin: str) -> DataFrame:
    """404 for same-origin URLs that a sitemap, link or canonical names and no file gave; only for static directories."""
    named = F.col("found_in_sitemap") | F.array_contains("sources", "InternalLink") | F.array_contains("sources", "Canonical")
    missing = F.col("http_status").isNull() & (F.regexp_extract("url", r"^(https?://[^/?#]*)", 1) == base_origin) & named
    return state.withColumn("http_status", F.when(missing, 404).otherwise(F.col("http_status")))
