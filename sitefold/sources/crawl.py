"""A live crawl, wave by wave, over whatever fetches pages: a table of recorded responses or HTTP."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions.robots import directive_sql, merge_all
from sitefold.functions.urls import join_url, origin, path_and_query, remap_origin, resolve, resolve_url, url_key
from sitefold.operators.checkpoints import Tables, cut
from sitefold.operators.reach import with_reachability
from sitefold.operators.spread import dealt_join, share_of
from sitefold.operators.state import Site, derive, fold_sources, utc_now, with_defaults
from sitefold.schemas import FETCHES, ROBOTS
from sitefold.sources import robots_txt, sitemap
from sitefold.sources.html import page_signals, signals_with_alias, with_meta_robots

#: Redirects that are followed; pages that are fetched by default. Fixed values.
HOPS = 10
MAX_PAGES = 500
#: ``(url)`` to rows of FETCHES: one response each, redirects not followed.
Fetcher = Callable[[DataFrame], DataFrame]


@dataclass
class Options:
    entry: str
    public_origin: str | None = None
    max_pages: int = MAX_PAGES
    user_agent: str = "sitefold/0.1"
    concurrency: int = 8
    crawl_delay: float | None = None
    headers: dict[str, str] = field(default_factory=dict)


def parse_headers(texts: list[str]) -> dict[str, str]:
    """``NAME: VALUE`` options; a name is needed and the user agent has its own option."""
    out = {}
    for text in texts:
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header must be NAME: VALUE: {text}")
        if name.strip().lower() == "user-agent":
            raise ValueError("use the user agent option instead of a header")
        out[name.strip()] = value.strip()
    return out


class Replay:
    """Responses recorded in a table of FETCHES, one for each URL. A URL that it lacks is a failed fetch."""

    def __init__(self, fetches: DataFrame):
        self.fetches = fetches
        self._ways: dict[tuple[str, str], DataFrame] = {}

    def __call__(self, urls: DataFrame) -> DataFrame:
        return urls.withColumnRenamed("url", "request_url").join(self.fetches, "request_url", "left")

    def ways(self, crawl_origin: str, base_origin: str) -> DataFrame:
        """``(bare, first_status, hops)``: the next HOPS redirects, or fewer, of each recorded one. Made once for all waves.

        Pointer doubling: a round appends to each way the way of the page where it ends, so that four rounds make up to
        sixteen hops. A way ends where the next page is off the origin or no redirect; one in a circle goes round.
        """
        if (crawl_origin, base_origin) not in self._ways:
            tables = Tables(self.fetches.sparkSession, "redirects")
            moved = self.fetches.where("status BETWEEN 300 AND 399").select(F.col("request_url").alias("bare"), F.col("status").alias("first_status"), F.expr(f"try_element_at({header('location')}, 1)").alias("location"))
            to = join_url("bare", F.col("location"))
            to = remap_origin(to, base_origin, crawl_origin) if base_origin != crawl_origin else to
            steps = moved.where("location IS NOT NULL").withColumn("to", to).where("to IS NOT NULL")
            ends = F.when(origin(F.col("to")) == crawl_origin, F.regexp_replace("to", r"(?s)#.*$", ""))
            way = tables.write(steps.select("bare", "first_status", F.array("to").alias("hops"), ends.alias("end")), "ways-0")
            for k in range(1, (HOPS - 1).bit_length() + 1):
                total = way.where("end IS NOT NULL").count()
                share = share_of(total)
                counts = way.where("end IS NOT NULL").groupBy("end").agg(F.count(F.lit(1)).alias("n")) if total > share else None
                after = way.select(F.col("bare").alias("end"), F.col("hops").alias("more"), F.col("end").alias("then"))
                longer = dealt_join(way, after, "end", counts, share, F.xxhash64("bare"), "left")
                hops = F.slice(F.concat("hops", F.coalesce("more", F.array().cast("array<string>"))), 1, HOPS)
                way = tables.write(longer.select("bare", "first_status", hops.alias("hops"), F.when(F.size(hops) < HOPS, F.col("then")).alias("end")), f"ways-{k}")
            self._ways[crawl_origin, base_origin] = way.drop("end")
        return self._ways[crawl_origin, base_origin]

    def followed(self, urls: DataFrame, crawl_origin: str, base_origin: str) -> DataFrame:
        """What ``follow`` gives: the way of each URL up to where it repeats itself, and the response at its end."""
        asked = urls.select(F.col("url").alias("request_url"), F.regexp_replace("url", r"(?s)#.*$", "").alias("bare"))
        met = asked.join(self.ways(crawl_origin, base_origin), "bare", "left").withColumn("all", F.concat(F.array("request_url"), F.coalesce("hops", F.array().cast("array<string>"))))
        again = "array_position(transform(all, (x, i) -> array_contains(slice(all, 1, i), x)), true)"
        chain = met.withColumn("again", F.expr(again)).withColumn("chain", F.expr("CASE WHEN again > 0 THEN slice(all, 1, cast(again AS int)) ELSE all END"))
        out = (F.col("again") > 0) | ((F.size("chain") > 1) & (origin(F.element_at("chain", -1)) != crawl_origin))
        final = F.when(out, F.try_element_at("chain", F.lit(-2))).otherwise(F.element_at("chain", -1))
        ended = cut(chain.select("request_url", "first_status", "chain", final.alias("final_url")).withColumn("end", F.regexp_replace("final_url", r"(?s)#.*$", "")))
        total = ended.count()
        share = share_of(total)
        counts = ended.groupBy("end").agg(F.count(F.lit(1)).alias("n")) if total > share else None
        got = dealt_join(ended, self.fetches.withColumnRenamed("request_url", "end"), "end", counts, share, F.xxhash64("request_url"), "left")
        return got.select("request_url", F.coalesce("first_status", "status").alias("initial_status"), "status", "headers", _html_body("true").alias("body"), "chain", "final_url")


def replay(fetches: DataFrame) -> Fetcher:
    return Replay(fetches)


def over_http(options: Options, timeout: float = 30.0) -> Fetcher:
    """Real requests; custom headers go to the entry's origin only. Bodies are read for status 200."""
    home = resolve(options.entry, "/")

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *_):
            return None

    def run(batches):
        import pandas as pd

        opener = urllib.request.build_opener(Stay)
        for batch in batches:
            rows = []
            for url in batch["url"]:
                time.sleep(options.crawl_delay or 0)
                headers = {"User-Agent": options.user_agent} | (options.headers if url.startswith(home) else {})
                try:
                    with opener.open(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                        body = r.read().decode("utf-8", "replace") if r.status == 200 else None
                        rows.append((url, r.status, [{"name": k, "value": v} for k, v in r.headers.items()], body))
                except urllib.error.HTTPError as e:
                    rows.append((url, e.code, [{"name": k, "value": v} for k, v in e.headers.items()], None))
                except (OSError, http.client.HTTPException):
                    rows.append((url, None, None, None))
            yield pd.DataFrame(rows, columns=FETCHES.names)

    # one worker if there is a delay; the crawl sets it from robots.txt before the first page
    return lambda urls: urls.repartition(1 if options.crawl_delay else options.concurrency).mapInPandas(run, FETCHES)


def header(name: str) -> str:
    return f"transform(filter(headers, h -> lower(h.name) = '{name}'), h -> h.value)"


def is_html(content_type: str) -> str:
    return f"lower(trim(split_part({content_type}, ';', 1))) IN ('text/html', 'application/xhtml+xml')"


def _html_body(when: str):
    return F.expr(f"CASE WHEN {when} AND status = 200 AND {is_html(f'try_element_at({header("content-type")}, 1)')} THEN body END")


def follow(urls: DataFrame, fetch: Fetcher, crawl_origin: str, base_origin: str) -> DataFrame:
    """``(request_url, initial_status, status, headers, body, chain, final_url)``: up to HOPS redirects, a round of fetches a hop;
    of recorded responses the ways of all redirects are doubled instead (``Replay.ways``).

    Any status from 300 to 399 with a location is followed. A hop off the origin is kept in the chain and ends it, and so does a
    hop that repeats a URL; neither is fetched. ``final_url`` is the last URL that was, and ``status``, ``headers`` and ``body``
    are its response. Bodies stay only for HTML of status 200.
    """
    if isinstance(fetch, Replay):
        return fetch.followed(urls, crawl_origin, base_origin)
    state = urls.select(F.col("url").alias("request_url"), F.col("url").alias("at"), F.array("url").alias("chain"), F.lit(None).cast("int").alias("initial_status"))
    done = None
    for hop in range(HOPS + 1):
        state = state.withColumn("bare", F.regexp_replace("at", r"(?s)#.*$", ""))
        got = cut(fetch(state.select(F.col("bare").alias("url")).distinct()).withColumnRenamed("request_url", "bare"))
        met = state.join(got, "bare", "left").withColumn("initial_status", F.coalesce("initial_status", "status"))
        location = F.when(F.col("status").between(300, 399) & F.lit(hop < HOPS), F.expr(f"try_element_at({header('location')}, 1)"))
        met = met.withColumn("next", join_url("at", location))
        met = met.withColumn("next", remap_origin(F.col("next"), base_origin, crawl_origin) if base_origin != crawl_origin else F.col("next"))
        ends = F.col("next").isNull() | F.array_contains("chain", F.col("next")) | (origin(F.col("next")) != crawl_origin)
        chain = F.when(F.col("next").isNotNull(), F.concat("chain", F.array("next"))).otherwise(F.col("chain"))
        met = cut(met.withColumn("ends", ends).withColumn("chain", chain))
        part = met.where("ends")
        done = part if done is None else done.unionByName(part)
        state = met.where("NOT ends").select("request_url", F.col("next").alias("at"), "chain", "initial_status")
        if hop == HOPS or state.isEmpty():
            break
    body = _html_body("next IS NULL")
    return done.select("request_url", "initial_status", "status", "headers", body.alias("body"), "chain", F.col("at").alias("final_url"))


def http_canonical() -> str:
    """SQL: the target of the first part with rel canonical of a ``Link`` header, of the last header that has one; it is
    resolved later. Headers are cut at commas, and either quotes may be around a rel."""
    value = "trim(BOTH '\\'\"' FROM trim(substring(x, instr(x, '=') + 1)))"
    rel = f"exists(slice(split(p, ';'), 2, size(split(p, ';'))), x -> lower(trim(split_part(x, '=', 1))) = 'rel' AND array_contains(split(lower({value}), '\\\\s+'), 'canonical'))"
    first = f"try_element_at(filter(split(v, ','), p -> {rel} AND p RLIKE '<[^>]*>'), 1)"
    return f"regexp_extract(try_element_at(filter(transform({header('link')}, v -> {first}), p -> p IS NOT NULL), -1), '<([^>]*)>', 1)"


def pages_state(fetched: DataFrame, crawl_origin: str, base_origin: str) -> tuple[DataFrame, DataFrame]:
    """Own columns of fetched pages: the requested row gets the first status and the chain, the row of the URL that was
    fetched last gets its status, headers and signals. Of several requests that end at a URL the last in order counts."""
    public = lambda c: remap_origin(c, crawl_origin, base_origin)
    named = fetched.withColumn("request", public(F.col("request_url"))).withColumn("final", public(F.col("final_url"))).withColumn("chain", F.transform("chain", public))
    moved = named.where("size(chain) > 1").select(url_key(F.col("request")).alias("url_key"), F.col("initial_status").alias("http_status"), F.col("chain").alias("redirect_chain"), F.element_at("chain", -1).alias("redirect_target"))
    ended = named.groupBy("final").agg(F.max_by(F.struct("status", "headers", "body", "request"), "request").alias("x"), F.min(F.struct((F.size("chain") > 1).alias("redirected"), "request")).alias("first")).select("final", "x.*", "first.redirected")
    extract = page_signals if crawl_origin == base_origin else signals_with_alias(crawl_origin)
    read = ended.withColumn("s", extract("body", "final"))
    link = resolve_url("final", F.expr(f"nullif({http_canonical()}, '')"))
    link = public(link) if crawl_origin != base_origin else link
    own = read.select(
        url_key(F.col("final")).alias("url_key"), F.col("final").alias("url"), "request", "redirected", F.col("status").alias("http_status"), F.col("s.canonical").alias("html_canonical"), link.alias("http_canonical"),
        F.expr(f"transform({header('x-robots-tag')}, v -> {directive_sql('v')})").alias("tags"), F.col("s.meta_robots").alias("meta"), F.col("s.hreflang").alias("hreflang"),
        F.col("s.internal_links").alias("internal_links_out"), F.col("s.word_count").alias("word_count"), F.col("s.heading_count").alias("heading_count"),
    )
    own = with_meta_robots(own, "coalesce(meta, cast(array() AS array<string>))", "html_meta_robots").withColumn("http_x_robots_tag", merge_all("coalesce(tags, cast(array() AS array<" + ROBOTS.simpleString() + ">))"))
    return moved, own.drop("tags", "meta")


def crawl(options: Options, fetch: Fetcher, spark) -> Site:
    """The site reached from an entry page, breadth first: a wave fetches the queue, its targets make the next one.

    Pages that robots.txt blocks are rows but not fetched. More pages than ``max_pages``, an entry that is blocked, isn't a
    final 200 or isn't HTML, and a fetch that fails are errors: a partial site would look like a broken one.
    """
    home = resolve(options.entry, "/").rstrip("/")
    base = (options.public_origin or home).rstrip("/")
    one = lambda url: fetch(spark.createDataFrame([(url,)], "url string")).head()
    got = one(home + "/robots.txt")
    if got is None or got["status"] is None:
        raise RuntimeError("robots.txt could not be fetched")
    robots = robots_txt.parse(got["body"] or "", home + "/", options.user_agent) if got["status"] == 200 else None
    options.crawl_delay = robots_txt.crawl_delay(options.crawl_delay, robots)
    listed = sitemap_urls(spark, fetch, home, robots)
    entry = resolve(base + "/", options.entry.removeprefix(home) or "/")
    public = F.when(F.startswith("url", F.lit(home)), F.concat(F.lit(base), F.substring("url", len(home) + 1, 2147483647))).otherwise(F.col("url"))
    seeds = listed.select(public.alias("url"), F.lit("Sitemap").alias("source"), F.lit(0).alias("wave"))
    seed = seeds.unionByName(spark.createDataFrame([(entry, "DirectScan", 1)], "url string, source string, wave int")).withColumn("url_key", url_key(F.col("url")))
    facts = [seed.select("url_key", "url", "source", F.struct("wave", F.when(F.col("wave") == 0, F.col("url")).otherwise("").alias("page"), F.lit(0).alias("n")).alias("prio"))]
    status = robots_txt.status_column(path_and_query(F.col("url")), robots)
    own_parts, moved_parts, fetched_total, wave = [], [], 0, 1
    seen = cut(seed.where(F.startswith(F.concat("url_key", F.lit("/")), F.lit(base + "/"))).groupBy("url_key").agg(F.min_by("url", "wave").alias("url")))
    queue = seen
    while True:
        queued = queue.select("url_key", "url", F.lit("DirectScan").alias("source"), F.struct(F.lit(wave).alias("wave"), F.lit("").alias("page"), F.lit(0).alias("n")).alias("prio"))
        open_ = cut(queue.where(status != "Blocked"))
        n = open_.count()
        if wave == 1 and open_.where(F.col("url_key") == entry).isEmpty():
            raise RuntimeError(f"entry URL {entry} is blocked by robots.txt")
        if not n:
            break
        if fetched_total + n > options.max_pages:
            raise RuntimeError(f"page budget of {options.max_pages} is not enough")
        fetched_total += n
        done = cut(follow(open_.select(remap_origin(F.col("url_key"), base, home).alias("url")), fetch, home, base))
        if bad := done.where("status IS NULL").select("request_url").head():
            raise RuntimeError(f"fetching discovered page {bad[0]} failed")
        if wave == 1:
            first = done.where(F.col("request_url") == F.lit(entry.replace(base, home, 1))).head()
            if first["status"] != 200 or first["body"] is None:
                raise RuntimeError(f"entry URL {entry} did not resolve to an HTML page with HTTP 200")
        moved, own = pages_state(done, home, base)
        own, moved = cut(own.withColumn("wave", F.lit(wave))), cut(moved.withColumn("wave", F.lit(wave)))
        own_parts.append(own)
        moved_parts.append(moved)
        at = lambda urls, source, k: own.select(F.explode(urls).alias("target"), F.col("request").alias("page")).select(url_key(F.col("target")).alias("url_key"), F.col("target").alias("url"), F.lit(source).alias("source"), F.struct(F.lit(wave).alias("wave"), "page", F.lit(k).alias("n")).alias("prio"))  # noqa: E731, B023
        found = at(F.array_compact(F.array(F.coalesce("html_canonical", "http_canonical"))), "Canonical", 1).unionByName(at("internal_links_out", "InternalLink", 2)).unionByName(at(F.col("hreflang.url"), "Hreflang", 3))
        ended = own.select("url_key", "url", F.expr("CASE WHEN redirected THEN 'Redirect' ELSE 'DirectScan' END").alias("source"), F.struct(F.lit(wave).alias("wave"), F.col("request").alias("page"), F.lit(0).alias("n")).alias("prio"))
        found = cut(found.unionByName(ended).unionByName(queued).where(F.startswith(F.concat("url_key", F.lit("/")), F.lit(base + "/")) | (F.col("source") != "InternalLink")))
        facts.append(found)
        facts, own_parts, moved_parts = _joined(facts), _joined(own_parts), _joined(moved_parts)
        reached = own.select("url_key", "url")
        fresh = found.where("source <> 'DirectScan'").where(F.startswith(F.concat("url_key", F.lit("/")), F.lit(base + "/"))).groupBy("url_key").agg(F.min_by("url", "prio").alias("url"))
        queue = cut(fresh.join(seen.select("url_key"), "url_key", "left_anti").join(reached.select("url_key"), "url_key", "left_anti"))
        seen = cut(seen.unionByName(reached).unionByName(queue).dropDuplicates(["url_key"]))
        wave += 1
    return _folded(facts, own_parts, moved_parts, robots, base, entry, options)


def _joined(parts: list[DataFrame], most: int = 16) -> list[DataFrame]:
    """The parts, written as one where there are many: plans stay short however many waves a site has."""
    return parts if len(parts) < most else [cut(reduce(DataFrame.unionByName, parts))]


def _last(parts: list[DataFrame], *order: str) -> DataFrame:
    """One row for each url_key: what the last wave says, and of its rows the last by ``order``."""
    rows = reduce(DataFrame.unionByName, parts)
    columns = [c for c in rows.columns if c not in ("url_key", "wave")]
    return rows.groupBy("url_key").agg(F.max_by(F.struct(*columns), F.struct("wave", *order)).alias("x")).select("url_key", "x.*")


def _folded(facts, own_parts, moved_parts, robots, base, entry, options) -> Site:
    facts = reduce(DataFrame.unionByName, facts)
    own, moved = _last(own_parts, "request").drop("url", "request", "redirected"), _last(moved_parts, "redirect_target")
    in_map = facts.where("source = 'Sitemap'").select("url_key", F.lit(True).alias("found_in_sitemap")).distinct()
    rows = fold_sources(facts).join(own, "url_key", "left").join(moved.withColumnRenamed("http_status", "moved_status"), "url_key", "left").join(in_map, "url_key", "left")
    rows = rows.withColumn("http_status", F.coalesce("moved_status", "http_status"))
    here = F.startswith(F.concat("url_key", F.lit("/")), F.lit(base + "/"))
    checked = rows.withColumn("robots_txt_status", F.when(here, robots_txt.status_column(path_and_query(F.col("url")), robots)).otherwise("NoRule"))
    state = cut(derive(with_defaults(checked)))
    return Site(with_reachability(state, entry), base + "/", options.public_origin, utc_now())


def sitemap_urls(spark, fetch: Fetcher, home: str, robots: robots_txt.RobotsTxt | None) -> DataFrame:
    """``(url)`` of the pages in the sitemaps that robots.txt declares, else in /sitemap.xml. An index is followed one level down,
    its files as one wave of fetches; URLs stay a table. A file that is declared or listed but can't be fetched is an error."""
    declared = list(robots.sitemaps) if robots else []

    def bodies(urls: DataFrame, what: str) -> DataFrame | None:
        got = cut(fetch(urls))
        bad = got.where("status IS NULL OR status <> 200").select("request_url").head()
        if bad and what:
            raise RuntimeError(f"{what} {bad[0]} could not be fetched")
        return None if bad else got.select(F.col("request_url").alias("path"), "body")

    first = bodies(spark.createDataFrame([(u,) for u in dict.fromkeys(declared or [home + "/sitemap.xml"])], "url string"), "declared sitemap" if declared else "")
    if first is None:
        return spark.createDataFrame([], "url string")
    children = sitemap.locations(first).where("root = 'sitemapindex'").select(F.col("loc").alias("url")).distinct()
    return cut(sitemap.page_urls(first.unionByName(bodies(children, "sitemap of an index"))))
