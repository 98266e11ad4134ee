"""Named queries of sources, sinks and the crawl; ``queries`` holds those of rules, comparisons and functions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sitefold.functions.redirects import last_hop
from sitefold.functions.robots import directive_sql, merge_all
from sitefold.functions.urls import origin_or_null
from sitefold.operators import findings, rules
from sitefold.operators.checkpoints import cut, fresh
from sitefold.operators.reach import reachable_keys
from sitefold.operators.state import statistics
from sitefold.plans import cases, synthetic
from sitefold.plans.queries import _SHOWN, QUERIES, _all, _rows, _sitemaps, _sql, query
from sitefold.schemas import STATISTICS
from sitefold.sinks import documents, reports
from sitefold.sources import policy, robots_txt, sitemap, snapshot
from sitefold.sources.crawl import Options, crawl, replay, sitemap_urls
from sitefold.sources.html import page_signals
from sitefold.sources.static_site import build_state, file_kind, scan_directory
from sitefold.streaming import fetches

#: ``QUERIES`` holds the queries of both modules.
__all__ = ["QUERIES"]
_STATE = ("url_key", "url", "http_status", "effective_canonical", "is_indexable", "word_count", "heading_count")


# Sources.


@query
def file_kinds(spark, sf_dir):
    """What a static scan takes files for; names are made of part keys."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(f"{cases.FILE_NAMES} AS relative")
    return parts.select("relative", file_kind(F.element_at(F.split("relative", "/"), -1), F.col("relative")).alias("kind"))


@query
def static_files(spark, sf_dir):
    """A scan of suppliers' files, which tasks write: names that start with a dot or an underscore, folders for each page, links to no file."""
    path = fresh(spark, "static")

    def save(rows):
        for row in rows:
            _write(f"{path}/{row.path}", row.body)

    _sql(spark, sf_dir, cases.SUPPLIER_FILES).foreachPartition(save)
    state = scan_directory(spark, path, "https://a.test").state
    return state.select("url_key", "http_status", "robots_txt_status", "found_in_sitemap", "is_reachable", F.array_join(F.array_sort("sources"), ",").alias("sources"), "word_count")


def _write(path: str, body: str) -> None:
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(name), recursive=True)
        with system.open_output_stream(name) as f:
            f.write(body.encode())
    else:
        path = path.removeprefix("file://").removeprefix("file:")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(body)


@query
def html_signals(spark, sf_dir):
    """Signals of pages made of parts, lists as text."""
    read = _sql(spark, sf_dir, cases.PAGE_HTML).select("p_partkey", page_signals("html", F.lit("https://a.test/d/p")).alias("s"))
    lang = F.array_join(F.expr("transform(s.hreflang, e -> concat(e.lang, '=', e.url))"), " ")
    return read.select("p_partkey", "s.canonical", F.array_join("s.meta_robots", "|").alias("robots"), lang.alias("lang"), F.array_join("s.internal_links", " ").alias("links"), "s.word_count", "s.heading_count")


@query
def html_broken(spark, sf_dir):
    """Signals of parts' pages in broken markup: open elements, misnested formatting, text in tables, raw text."""
    read = _sql(spark, sf_dir, cases.BROKEN_HTML).select("p_partkey", page_signals("html", F.lit("https://a.test/d/p")).alias("s"))
    return read.select("p_partkey", F.array_join("s.internal_links", " ").alias("links"), "s.word_count", "s.heading_count")


@query
def robots_txt_parse(spark, sf_dir):
    """robots.txt files of suppliers: the group that holds for an agent, its rules in order, its delay and the file's sitemaps."""
    read = _sql(spark, sf_dir, cases.SUPPLIER_ROBOTS).withColumn("r", robots_txt.parsed("body", F.lit("https://a.test/"), "user_agent"))
    rules = F.array_join(F.expr("transform(r.rules, x -> concat(CASE WHEN x.allowed THEN '+' ELSE '-' END, x.pattern))"), " ")
    return read.select("s_suppkey", "user_agent", "r.agent", rules.alias("rules"), "r.delay", F.array_join("r.sitemaps", " ").alias("sitemaps"))


@query
def robots_tags_merge(spark, sf_dir):
    """Directives of a list of headers, merged in order."""
    merged = _sql(spark, sf_dir, cases.PAIRED).select("p_partkey", "value_a", "value_b", merge_all(f"array({directive_sql('value_a')}, {directive_sql('value_b')})").alias("m"))
    return merged.select("p_partkey", "value_a", "value_b", *[F.col(f"m.{c}").cast("string").alias(c) for c in ("noindex", "nofollow", "max_snippet", "max_image_preview")])


@query
def sitemap_page_urls(spark, sf_dir):
    return sitemap.page_urls(_sitemaps(spark, sf_dir))


@query
def redirect_last_hop(spark, sf_dir):
    state = synthetic.site(spark, sf_dir).state.where("size(redirect_chain) > 0")
    return state.select("url_key", last_hop(F.col("redirect_chain")).alias("last"), F.size("redirect_chain").cast("long").alias("n"))


@query
def static_states(spark, sf_dir):
    """URL states of the pages table as static files, every third page in a sitemap, counted by what is known of them.

    Of pages with one key the last by url holds, of equal urls the first by page_id, as for SQL that reads the table in order."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    order = F.struct("url", (-F.col("page_id")).alias("back"))
    state = build_state(pages, pages.where("page_id % 3 = 0").select("url"), None, cases.CRAWL_ORIGIN, order)
    kinds = state.select("http_status", "found_in_sitemap", "is_indexable", F.array_join(F.array_sort("sources"), ",").alias("sources"), F.size("internal_links_out").cast("long").alias("n_links"))
    return kinds.groupBy("http_status", "found_in_sitemap", "is_indexable", "sources").agg(F.count(F.lit(1)).alias("n"), F.sum("n_links").alias("n_links"))


@query
def crawl_replay(spark, sf_dir):
    """A crawl of the synthetic site as recorded HTML: waves, robots.txt, redirects and canonicals that lead to further pages."""
    state = synthetic.site(spark, sf_dir).state
    ahead = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.expr("array(p_partkey + 1, p_partkey + 2)")).alias("k")).distinct()
    missing = ahead.selectExpr("concat('https://site.test/p/', k) AS request_url").join(state.selectExpr("url AS request_url"), "request_url", "left_anti")
    html = "concat('<head>', coalesce(concat('<link rel=canonical href=\"', html_canonical, '\">'), ''), '</head><body>', array_join(transform(internal_links_out, l -> concat('<a href=\"', l, '\">x</a>')), ''))"
    headers = "array_compact(array(named_struct('name', 'Content-Type', 'value', 'text/html'), CASE WHEN redirect_target IS NOT NULL THEN named_struct('name', 'Location', 'value', redirect_target) END))"
    pages = state.selectExpr("url AS request_url", "coalesce(http_status, 503) AS status", f"{headers} AS headers", f"CASE WHEN http_status = 200 THEN {html} END AS body")
    empty = "cast(array() AS array<struct<name:string,value:string>>) AS headers"
    files = _rows(spark, (("https://site.test/robots.txt", 200, cases.CRAWL_ROBOTS),), "request_url, status, body").selectExpr("request_url", "status", empty, "body")
    recorded = cut(pages.unionByName(files).unionByName(missing.selectExpr("request_url", "404 AS status", empty, "cast(NULL AS string) AS body")))
    done = crawl(Options(synthetic.HOME, max_pages=recorded.count()), replay(recorded), spark)
    return done.state.select("url_key", "http_status", "robots_txt_status", F.size("internal_links_out").cast("long").alias("n_links"))


@query
def live_sitemap_urls(spark, sf_dir):
    """Page URLs of sitemaps as a crawl finds them: robots.txt names an index, its files are fetched as one wave. An index within
    the index is not followed."""
    files = _sitemaps(spark, sf_dir)
    listed = files.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>https://a.test/"), "path", F.lit("</loc></sitemap>")))), "").alias("x"))
    index = listed.select(F.lit("https://a.test/index.xml").alias("request_url"), F.concat(F.lit("<sitemapindex>"), "x", F.lit("</sitemapindex>")).alias("body"))
    bodies = files.select(F.concat(F.lit("https://a.test/"), "path").alias("request_url"), "body").unionByName(index)
    recorded = bodies.selectExpr("request_url", "200 AS status", "cast(array() AS array<struct<name:string,value:string>>) AS headers", "body")
    return sitemap_urls(spark, replay(cut(recorded)), "https://a.test", robots_txt.RobotsTxt(sitemaps=["https://a.test/index.xml"]))


# Sinks: what is written and read again.


@query
def snapshot_table(spark, sf_dir):
    path = fresh(spark, "snapshot")
    snapshot.write_table(synthetic.site(spark, sf_dir), path)
    return snapshot.read_table(spark, path).state.select(*_STATE)


@query
def snapshot_json(spark, sf_dir):
    """A snapshot as one JSON document, written and read by tasks."""
    path = fresh(spark, "snapshot")
    documents.snapshot_json(synthetic.site(spark, sf_dir).cached(), "2024-01-01T00:00:00Z").write(path)
    return snapshot.read_json(spark, path).state.select(*_STATE)


@query
def snapshot_statistics(spark, sf_dir):
    """The header's counters, which a reader compares with the states."""
    path = fresh(spark, "snapshot")
    snapshot.write_table(synthetic.site(spark, sf_dir, reach=True), path)
    return statistics(snapshot.read_table(spark, path).state).select(*STATISTICS)


@query
def findings_written(spark, sf_dir):
    """All findings as JSON lines in report order."""
    path, found = fresh(spark, "findings"), _all(spark, sf_dir)
    reports.write_findings(found, path)
    return spark.read.schema(found.schema).json(path).select(*_SHOWN)


def _few(spark, sf_dir):
    site = synthetic.site(spark, sf_dir).cached()
    return findings.run_rules(site, (rules.sitemap_indexability, rules.canonical_presence, rules.canonical_resolution))


def _elements(spark, path: str, kind: str):
    """The elements of a written document's array, parsed by tasks."""
    lines = spark.read.text(path).where("value LIKE ' {%' OR value LIKE ',{%'")
    return lines.select(F.from_json(F.substring("value", 2, 2147483647), kind, {"mode": "FAILFAST"}).alias("x")).select("x.*")


@query
def report_json(spark, sf_dir):
    """Findings of three families, read from the JSON report that tasks wrote."""
    path = fresh(spark, "report")
    documents.findings_json("scan", _few(spark, sf_dir)).write(path)
    texts = ", ".join(f"{e}: string" for e in ("declared", "observed", "canonical", "detail"))
    items = _elements(spark, path, f"rule_id string, severity string, url string, message string, evidence struct<{texts}>")
    return items.select("rule_id", "severity", "url", "evidence.*")


@query
def report_sarif(spark, sf_dir):
    """The same, read from the SARIF report that tasks wrote."""
    path = fresh(spark, "report")
    documents.findings_sarif(_few(spark, sf_dir)).write(path)
    kind = "ruleId string, level string, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>>>>, partialFingerprints map<string, string>"
    results = _elements(spark, path, kind)
    key = F.from_json(F.map_values("partialFingerprints")[0], "array<string>")
    return results.select(F.col("ruleId").alias("rule_id"), "level", F.col("locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("url"), key[3].alias("subject"))


def _counted(spark, path: str, like: tuple[str, ...]):
    """Lines of a written report that begin as given, and how often each stands there."""
    lines = spark.read.text(path).where(" OR ".join(f"value LIKE '{x}%'" for x in like))
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query
def report_markdown(spark, sf_dir):
    """The Markdown report that tasks wrote: its lines of rules, URLs and evidence."""
    path, site = fresh(spark, "report"), synthetic.site(spark, sf_dir).cached()
    documents.findings_markdown(_few(spark, sf_dir), site).write(path)
    return _counted(spark, path, ("| `", "### ", "**http", "- **"))


@query
def report_text(spark, sf_dir):
    """The report for a terminal that tasks wrote: its lines of rules, URLs and evidence, and the last."""
    path, site = fresh(spark, "report"), synthetic.site(spark, sf_dir).cached()
    documents.findings_text(_few(spark, sf_dir), site).write(path)
    return _counted(spark, path, ("CC-", "  URL:", "  Declared:", "  Observed:", "  Canonical:", "_% findings: "))


# Gates, settings, streams and further families.


@query
def public_origins(spark, sf_dir):
    """Texts made of page URLs as public origins; what is none is null."""
    start = "regexp_extract(url, '^https?://[^/?#]*', 0)"
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", f"{cases.ORIGIN_TEXT.format(start)} AS text")
    return rows.select("page_id", "text", origin_or_null("text").alias("origin"))


@query
def policy_limits(spark, sf_dir):
    """The limits of small policies: those that a file names, and the others as they are; null where it is refused."""
    rows = []
    for name, text, *_ in cases.POLICIES:
        try:
            p = policy.parse(text)
            rows.append((name, " ".join(p.fail_on), *(p.limits[k] for k in ("indexable", "links", "words", "headings"))))
        except ValueError:
            rows.append((name, None, None, None, None, None))
    return spark.createDataFrame(rows, "name string, fail_on string, indexable double, links double, words double, headings double")


@query
def reach_depths(spark, sf_dir):
    """How many hops away the pages are that can be reached: numbers by depth."""
    found = reachable_keys(synthetic.site(spark, sf_dir).state, synthetic.HOME)
    return found.groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query
def stream_findings(spark, sf_dir):
    """Findings of a stream of states: two files of states and a repeat of one of them."""
    rows, path = synthetic.site(spark, sf_dir).state.withColumn("seen_at", F.lit("2024-01-01").cast("timestamp")), fresh(spark, "stream")
    halves = [rows.where("word_count IS NULL"), rows.where("word_count IS NOT NULL"), rows.where("word_count IS NULL")]
    for half in halves:
        half.write.mode("append").parquet(f"{path}/in")
    out = f"{path}/out"
    states = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    running = fetches.evaluate_batches(states, lambda found, epoch: found.select(*_SHOWN).write.mode("append").parquet(out), f"{path}/state")
    running.processAllAvailable()
    running.stop()
    return spark.read.schema(findings.run_rules(synthetic.site(spark, sf_dir), (rules.canonical_presence,)).select(*_SHOWN).schema).parquet(out)


@query
def findings_gate(spark, sf_dir):
    """Whether a run with warnings only, and one with errors, fails by each severity."""
    site, rows = synthetic.site(spark, sf_dir).cached(), []
    for family in (rules.canonical_presence, rules.canonical_resolution):
        found = findings.run_rules(site, (family,))
        old = findings.mark_new(found, found)
        rows += [(family.__name__, s, findings.gate(found, [s]), findings.gate(old, [s], only_new=True)) for s in ("error", "warning", "info")]
    return spark.createDataFrame(rows, "family string, fail_on string, fails boolean, fails_if_new boolean")


@query
def findings_own_family(spark, sf_dir):
    """A rule of the user's own beside one of the catalogue."""

    def thin_page(site):
        cols = {"rule_id": "'OWN-1'", "severity": "'info'", "url": "url", "message": "'Few words.'", "declared": "cast(NULL AS string)", "observed": "cast(word_count AS string)", "canonical": "cast(NULL AS string)", "detail": "cast(NULL AS string)", "rule_ord": "99", "src_key": "url_key", "pos": "0", "seq": "0"}
        return site.state.where("word_count < 50").selectExpr(*[f"{v} AS {k}" for k, v in cols.items()])

    return findings.run_rules(synthetic.site(spark, sf_dir), (rules.canonical_presence, thin_page)).select(*_SHOWN)
