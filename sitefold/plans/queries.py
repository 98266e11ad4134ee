"""Named queries over the driver's tables; rules and comparisons run on the synthetic site."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions.globs import glob_regex
from sitefold.functions.robots import directive_sql, merge, pattern_regex, specificity
from sitefold.functions.urls import origin, path_and_query, remap_origin, resolve_url, route_url, url_key
from sitefold.operators import diff, findings, rules
from sitefold.operators.reach import reachable_keys, with_reachability
from sitefold.operators.state import fold_sources, statistics
from sitefold.plans import cases, synthetic
from sitefold.schemas import EVIDENCE, ROBOTS
from sitefold.sources import robots_txt, sitemap
from sitefold.sources.crawl import follow, http_canonical, pages_state, replay
from sitefold.sources.html import page_signals
from sitefold.sources.policy import LIMITS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SHOWN = ("rule_id", "severity", "url", *EVIDENCE)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rows(spark: SparkSession, rows: tuple, columns: str) -> DataFrame:
    """Literal rows as a plan, without Python serialisation."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    return spark.sql(f"SELECT * FROM VALUES {','.join('(' + ','.join(map(quote, r)) + ')' for r in rows)} AS t({columns})")


# Rules, one query each.

_RULES = {
    "sitemap_indexability": ("CC-SITEMAP-INDEXABILITY-001", "CC-SITEMAP-INDEXABILITY-002", "CC-SITEMAP-INDEXABILITY-003", "CC-SITEMAP-INDEXABILITY-004"),
    "sitemap_coverage": ("CC-SITEMAP-COVERAGE-001",),
    "canonical_consistency": ("CC-CANONICAL-CONSISTENCY-001", "CC-CANONICAL-CONSISTENCY-003", "CC-CANONICAL-CONSISTENCY-004"),
    "canonical_presence": ("CC-CANONICAL-PRESENCE-001",),
    "canonical_resolution": ("CC-CANONICAL-RESOLUTION-001", "CC-CANONICAL-RESOLUTION-002"),
    "robots_effective": ("CC-ROBOTS-EFFECTIVE-001",),
    "hreflang_reciprocal": ("CC-HREFLANG-RECIPROCAL-001", "CC-HREFLANG-RECIPROCAL-002"),
    "hreflang_canonical": ("CC-HREFLANG-CANONICAL-001",),
    "hreflang_indexability": ("CC-HREFLANG-INDEXABILITY-001",),
    "link_target": ("CC-LINK-TARGET-001", "CC-LINK-TARGET-002", "CC-LINK-TARGET-003", "CC-LINK-TARGET-004"),
    "redirect_resolution": ("CC-REDIRECT-RESOLUTION-001",),
    "orphan": ("CC-ORPHAN-001",),
}


def rule_query_name(rule: str) -> str:
    return "rule_" + rule.removeprefix("CC-").lower().replace("-", "_")


def _rule_query(family: str, rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        site = synthetic.site(spark, sf_dir, reach=family == "orphan")
        # links are counted before they are joined, so that hub pages can be dealt out
        return getattr(rules, family)(site.cached() if family == "link_target" else site).where(F.col("rule_id") == rule).select(*_SHOWN)

    return run


for _family, _ids in _RULES.items():
    for _id in _ids:
        QUERIES[rule_query_name(_id)] = _rule_query(_family, _id)


def _sites(spark: SparkSession, sf_dir: str):
    return synthetic.baseline(spark, sf_dir), synthetic.candidate(spark, sf_dir)


@query
def rule_diff_loss_pages(spark, sf_dir):
    lost = rules.diff_loss(*_sites(spark, sf_dir), LIMITS).where("url <> '(site-wide)'")
    return lost.select("rule_id", "severity", "url", "declared", "observed")


@query
def rule_diff_loss_site(spark, sf_dir):
    found = rules.diff_loss(*_sites(spark, sf_dir), LIMITS | {"indexable": -100.0}).where("url = '(site-wide)'")
    return found.select("rule_id", "severity", "url", "declared", "observed")


@query
def diff_loss_percent(spark, sf_dir):
    return rules.loss_rows(*_sites(spark, sf_dir)).select("url_key", "what", "was", "now", "loss_pct")


# State, reachability and comparisons.


@query
def state_derived(spark, sf_dir):
    s = synthetic.site(spark, sf_dir).state
    return s.select("url_key", "effective_canonical", F.coalesce("effective_robots.noindex", F.lit(False)).alias("noindex"), "is_indexable", "robots_txt_status", F.size("internal_links_out").cast("long").alias("n_links"))


@query
def state_statistics(spark, sf_dir):
    return statistics(synthetic.site(spark, sf_dir, reach=True).state)


@query
def state_sources_fold(spark, sf_dir):
    base = synthetic.site(spark, sf_dir)
    fact = lambda rows, url, source, prio: rows.select(F.regexp_replace(url, "#.*$", "").alias("url_key"), F.col(url).alias("url"), F.lit(source).alias("source"), F.lit(prio).alias("prio"))
    facts = fact(base.state.where("found_in_sitemap"), "url", "Sitemap", 0).unionByName(fact(base.hreflang(), "target_url", "Hreflang", 2)).unionByName(fact(base.links(), "link_url", "InternalLink", 1))
    return fold_sources(facts).select("url_key", "url", F.array_join("sources", ",").alias("sources"))


@query
def reach_urls(spark, sf_dir):
    return reachable_keys(synthetic.site(spark, sf_dir).state, synthetic.HOME).select("url_key")


@query
def diff_lost(spark, sf_dir):
    return diff.lost(*_sites(spark, sf_dir))


@query
def diff_gained(spark, sf_dir):
    return diff.gained(*_sites(spark, sf_dir))


@query
def diff_changed_long(spark, sf_dir):
    return diff.changes(*_sites(spark, sf_dir))


@query
def diff_counts(spark, sf_dir):
    return diff.counts(*_sites(spark, sf_dir))


# Findings as a whole.


def _all(spark: SparkSession, sf_dir: str, exclusions: list[dict] | None = None) -> DataFrame:
    return findings.run_rules(synthetic.site(spark, sf_dir, reach=True).cached(), exclusions=exclusions)


@query
def findings_all_sorted(spark, sf_dir):
    return findings.in_report_order(_all(spark, sf_dir)).select(*_SHOWN, "rule_ord", "src_key", "pos", "seq")


@query
def findings_messages(spark, sf_dir):
    return _all(spark, sf_dir).select("rule_id", "url", "message")


@query
def findings_keys(spark, sf_dir):
    return findings.with_subject(_all(spark, sf_dir)).select("rule_id", "url", "severity", "subject", "rule_ord", "pos", "seq")


@query
def findings_by_severity(spark, sf_dir):
    return findings.by_severity(_all(spark, sf_dir))


@query
def findings_by_rule(spark, sf_dir):
    return findings.by_rule(_all(spark, sf_dir))


@query
def findings_excluded(spark, sf_dir):
    return _all(spark, sf_dir, list(cases.EXCLUSIONS)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query
def findings_catalog_join(spark, sf_dir):
    joined = findings.with_catalog(_all(spark, sf_dir))
    return joined.groupBy("rule_id", "default_severity", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def findings_new_only(spark, sf_dir):
    """Findings of the candidate, of all families, and whether the baseline lacks them."""
    old, now = (replace(s, state=with_reachability(s.state.persist(), synthetic.HOME)).cached() for s in _sites(spark, sf_dir))
    marked = findings.against_baseline(now, old)
    return marked.groupBy("rule_id", "is_new").agg(F.count(F.lit(1)).alias("n"))


# Robots, URLs, globs, sitemaps.


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the tables of a folder."""
    return synthetic.named(spark, sf_dir, text)


@query
def robots_directive_parse(spark, sf_dir):
    """Directives of parts."""
    rows = _sql(spark, sf_dir, f"SELECT p_partkey, {cases.directive('p_partkey')} AS value FROM part")
    return rows.selectExpr("p_partkey", "value", f"{directive_sql('value')} AS d").selectExpr("p_partkey", "value", *[f"cast(d.{c} AS string) AS {c}" for c in ROBOTS.names])


@query
def robots_directive_merge(spark, sf_dir):
    parsed = _sql(spark, sf_dir, cases.PAIRED).selectExpr("p_partkey", "value_a", "value_b", f"{directive_sql('value_a')} AS a", f"{directive_sql('value_b')} AS b")
    return parsed.selectExpr("p_partkey", "value_a", "value_b", f"{merge('a', 'b')} AS m").selectExpr("p_partkey", "value_a", "value_b", *[f"cast(m.{c} AS string) AS {c}" for c in ("noindex", "nofollow", "max_snippet", "max_image_preview")])


@query
def robots_txt_match(spark, sf_dir):
    """The part pages against a few rules, as a table of rules."""
    table = _rows(spark, tuple((p, pattern_regex(p), specificity(p), a) for p, a in cases.ROBOTS_RULES), "pattern, regex, specificity, allowed")
    pages = synthetic.site(spark, sf_dir).state.select("url", path_and_query(F.col("url")).alias("path"))
    return robots_txt.match_rules(pages, table)


@query
def robots_txt_status(spark, sf_dir):
    """The same by one expression."""
    robots = robots_txt.RobotsTxt(rules=list(cases.ROBOTS_RULES))
    return synthetic.site(spark, sf_dir).state.select("url", robots_txt.status_column(path_and_query(F.col("url")), robots).alias("status"))


@query
def robots_group_select(spark, sf_dir):
    """The group of a file that holds for each of many user agents."""
    body = "\n".join(f"User-agent: {a}\nDisallow: /{a}\n" for a in cases.AGENTS)
    return _sql(spark, sf_dir, cases.AGENT_ROWS).select("p_partkey", "user_agent", robots_txt.parsed(F.lit(body), F.lit("https://a.test/"), "user_agent")["agent"].alias("agent"))


@query
def page_url_keys(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    u = F.col("url")
    return pages.select("page_id", url_key(u).alias("url_key"), origin(u).alias("origin"), path_and_query(u).alias("path_query"))


@query
def url_origin_remap(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", remap_origin(F.col("url"), cases.CRAWL_ORIGIN, cases.PUBLIC_ORIGIN).alias("url"))


@query
def route_from_path(spark, sf_dir):
    """URLs of files whose paths are made of parts."""
    return _sql(spark, sf_dir, cases.FILE_ROUTES).select("p_partkey", "path", route_url("https://example.test")("path").alias("url"))


@query
def url_resolve(spark, sf_dir):
    """References of all kinds against the URLs of pages."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "url AS base", f"{cases.REFERENCE} AS reference")
    return rows.select("page_id", "base", "reference", resolve_url("base", "reference").alias("url"))


@query
def url_resolve_cases(spark, sf_dir):
    """The same for hrefs of pages as they stand, against their page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hrefs = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("pos", "href"))
    return hrefs.select("page_id", "pos", "href", resolve_url("url", "href").alias("target"))


@query
def glob_match(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", path_and_query(F.col("url")).alias("path"))
    return pages.select("page_id", *[F.col("path").rlike(glob_regex(g)).alias(f"g{k}") for k, g in enumerate(cases.GLOBS)])


def _sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, body)`` of sitemaps of part pages: urlsets, some with a prefix, and indexes."""
    items = _sql(spark, sf_dir, cases.SITEMAP_ITEMS)
    tag = lambda name: f"concat('<', p, '{name}>', {{}}, '</', p, '{name}>')"
    optional = lambda name, value: f"CASE WHEN {name} IS NOT NULL THEN {tag(name).format(value)} ELSE '' END"
    inner = f"concat({tag('loc').format(chr(39) + ' ' + chr(39) + ' || replace(loc, ' + chr(39) + '&' + chr(39) + ', ' + chr(39) + '&amp;' + chr(39) + ')')}, CASE WHEN n % 4 = 3 THEN '' ELSE concat({optional('lastmod', 'lastmod')}, {optional('priority', 'cast(priority AS string)')}) END)"
    marked = items.selectExpr("n", "k", "CASE WHEN n % 4 = 2 THEN 's:' ELSE '' END AS p", "loc", "lastmod", "priority").selectExpr("n", "p", "k", f"{inner} AS x")
    item = "CASE WHEN n % 4 = 3 THEN 'sitemap' ELSE 'url' END"
    listed = marked.selectExpr("n", "p", "k", f"concat('<', p, {item}, '>', x, '</', p, {item}, '>') AS x").groupBy("n", "p").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(k, x))), e -> e.x)"), "").alias("x"))
    space = "' xmlns', CASE WHEN p = 's:' THEN ':s' ELSE '' END, '=\"http://www.sitemaps.org/schemas/sitemap/0.9\"'"
    root = "CASE WHEN n % 4 = 3 THEN 'sitemapindex' ELSE 'urlset' END"
    return listed.selectExpr("concat('m', n, '.xml') AS path", f"concat('<', p, {root}, {space}, '>', x, '</', p, {root}, '>') AS body", f"{root} AS kind")


@query
def sitemap_locs(spark, sf_dir):
    return sitemap.locations(_sitemaps(spark, sf_dir)).select("path", "root", "loc")


@query
def sitemap_entries(spark, sf_dir):
    return sitemap.entries(_sitemaps(spark, sf_dir).where("kind = 'urlset'"))


# HTML of the pages table.


@query
def pages_signals(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", page_signals("html", "url").alias("s"))
    return pages.select("page_id", "s.canonical", F.size("s.internal_links").alias("n_links"), "s.word_count", "s.heading_count")


@query
def pages_heading_count(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", page_signals("html", "url")["heading_count"].alias("heading_count"))


@query
def pages_links(spark, sf_dir):
    """Raw link targets by a regular expression, which the engine runs without Python."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("pos", "href"))


@query
def pages_link_degree(spark, sf_dir):
    return pages_links(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("href").alias("n_distinct"))


# Redirects.


@query
def redirect_chain_replay(spark, sf_dir):
    """Part pages fetched by replay: redirects followed hop by hop."""
    state = synthetic.site(spark, sf_dir).state.where("http_status IS NOT NULL")
    location = F.expr("CASE WHEN redirect_target IS NOT NULL THEN array(named_struct('name', 'location', 'value', redirect_target)) ELSE cast(array() AS array<struct<name:string,value:string>>) END")
    recorded = state.select(F.col("url").alias("request_url"), F.col("http_status").alias("status"), location.alias("headers"), F.lit(None).cast("string").alias("body"))
    done = follow(state.where("redirect_target IS NOT NULL").select("url"), replay(recorded), "https://site.test", "https://site.test")
    return done.select("request_url", "initial_status", F.coalesce("status", F.lit(0)).alias("status"), F.array_join("chain", " ").alias("chain"), "final_url")


@query
def redirect_rows(spark, sf_dir):
    """What becomes of the rows of redirects that leave the origin, come back, have an unusual status or a fragment, or are too many."""
    empty = "cast(array() AS array<struct<name:string,value:string>>)"
    headers = F.expr(f"CASE WHEN location IS NULL THEN {empty} ELSE array(named_struct('name', 'Location', 'value', location)) END")
    recorded = _rows(spark, cases.RESPONSES, "request_url, status, location").select("request_url", F.col("status").cast("int"), headers.alias("headers"), F.lit(None).cast("string").alias("body"))
    done = follow(_rows(spark, tuple((u,) for u in cases.REQUESTS), "url"), replay(recorded), "https://a.test", "https://a.test")
    moved, own = pages_state(done, "https://a.test", "https://a.test")
    first = moved.select("url_key", F.lit("moved").alias("kind"), "http_status", F.array_join("redirect_chain", " ").alias("chain"), "redirect_target")
    return first.unionByName(own.select("url_key", F.lit("fetched").alias("kind"), "http_status", F.expr("CAST(redirected AS string)").alias("chain"), F.col("url").alias("redirect_target")))


@query
def header_canonical(spark, sf_dir):
    """The canonical of Link headers made of parts; a bar in a value separates headers."""
    listed = _sql(spark, sf_dir, cases.LINK_VALUES).withColumn("headers", F.expr("transform(split(value, '[|]'), v -> named_struct('name', 'Link', 'value', v))"))
    return listed.select("p_partkey", "value", F.expr(f"nullif({http_canonical()}, '')").alias("target"))
