"""A site from a directory of built files."""

from __future__ import annotations

import os
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions.urls import path_and_query, resolve, route_url, url_key
from sitefold.operators.checkpoints import Tables, cut
from sitefold.operators.reach import with_reachability
from sitefold.operators.state import Site, derive, fold_sources, static_not_found, utc_now, with_defaults
from sitefold.sources import robots_txt, sitemap
from sitefold.sources.html import page_signals, with_meta_robots

BASE_URL = "https://example.test"
USER_AGENT = "sitefold/0.1"
#: Entries of a folder that are handed on at once.
_ENTRIES = 10_000


def file_kind(name: Column, relative: Column) -> Column:
    """``robots`` for the root robots.txt, then ``sitemap`` by name at any depth, then ``html``; else null."""
    is_sitemap = (name == "sitemap.xml") | name.startswith("sitemap-") | name.endswith("-sitemap.xml")
    return F.when(relative == "robots.txt", "robots").when(is_sitemap, "sitemap").when(name.rlike(r"\.html?$"), "html")


def _entries(batches):
    """What each folder holds: ``(path, relative, folder)``. Links are not followed; others than files and folders are left out."""
    import pyarrow as pa

    def found(path: str, relative: str):
        if "://" in path:
            from pyarrow import fs

            system, name = fs.FileSystem.from_uri(path)
            for x in system.get_file_info(fs.FileSelector(name)):
                if x.type in (fs.FileType.File, fs.FileType.Directory):
                    yield f"{path}/{x.base_name}", f"{relative}{x.base_name}", not x.is_file
        else:
            with os.scandir(path) as entries:
                for x in entries:
                    folder = x.is_dir(follow_symlinks=False)
                    if folder or x.is_file(follow_symlinks=False):
                        yield x.path, f"{relative}{x.name}", folder

    for batch in batches:
        for path, relative in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            entries = found(path, f"{relative}/" if relative else "")
            while rows := list(islice(entries, _ENTRIES)):
                yield pa.RecordBatch.from_pydict(dict(zip(("path", "relative", "folder"), map(list, zip(*rows, strict=True)), strict=True)))


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, relative)`` of all regular files below a directory, whatever their names.

    Folders of a level are listed by executors, each once, and what they hold is written as a table; the folders among it are the next
    level. The driver counts them and never holds a name. A missing directory has no files.
    """
    root = directory.rstrip("/") or "/"
    if "://" not in root or root.startswith("file:"):
        root = os.path.abspath(root.removeprefix("file://").removeprefix("file:"))
    tables, levels, slots = Tables(spark, "listing"), [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.createDataFrame([(root, "")], "path string, relative string") if _is_folder(root) else spark.createDataFrame([], "path string, relative string")
    n = 1
    while n:
        # of one level few tasks when its folders are few
        level = tables.write(folders.repartition(min(n, slots)).mapInArrow(_entries, "path string, relative string, folder boolean"), f"level-{len(levels)}")
        levels.append(level.where("NOT folder").select("path", "relative"))
        folders = level.where("folder").select("path", "relative")
        n = folders.count()
    return reduce(DataFrame.unionByName, levels)


def _is_folder(root: str) -> bool:
    if "://" not in root:
        return os.path.isdir(root)
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(root)
    return system.get_file_info(name).type == fs.FileType.Directory


def _read(batches):
    import pyarrow as pa

    for batch in batches:
        for path, relative, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if "://" in path:
                from pyarrow import fs

                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as f:
                    data = f.read()
            else:
                with open(path, "rb") as f:
                    data = f.read()
            try:
                body = data.decode("utf-8")
            except UnicodeDecodeError:
                raise ValueError(f"not UTF-8: {path}") from None
            yield pa.RecordBatch.from_pydict({"relative": [relative], "kind": [kind], "body": [body]})


def read_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(relative, kind, body)`` of the files that matter, decoded as UTF-8; other bytes are an error.

    Spark's own readers skip names that start with an underscore or a dot, so executors list the folders and read the files by
    their paths.
    """
    names = list_files(spark, directory).withColumn("name", F.element_at(F.split("relative", "/"), -1))
    kinds = names.withColumn("kind", file_kind(F.col("name"), F.col("relative"))).where("kind IS NOT NULL").select("path", "relative", "kind")
    return kinds.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_read, "relative string, kind string, body string")


def page_facts(pages: DataFrame) -> DataFrame:
    """Discovery facts of pages with their signals: the page itself, then canonical, hreflang and link targets."""
    target = lambda column, source, prio: pages.select(F.explode(column).alias("url"), F.col("url").alias("page")).select("url", F.lit(source).alias("source"), F.struct(F.lit(1), "page", F.lit(prio)).alias("prio"))
    own = pages.select("url", F.lit("DirectScan").alias("source"), F.struct(F.lit(1), F.col("url").alias("page"), F.lit(0)).alias("prio"))
    facts = own.unionByName(target(F.array_compact(F.array("s.canonical")), "Canonical", 1)).unionByName(target(F.col("s.hreflang.url"), "Hreflang", 2)).unionByName(target(F.col("s.internal_links"), "InternalLink", 3))
    return facts.select(url_key(F.col("url")).alias("url_key"), "url", "source", "prio")


def build_state(pages: DataFrame, listed: DataFrame, robots: robots_txt.RobotsTxt | None, base_url: str, order: Column | None = None) -> DataFrame:
    """URL states of ``pages (url, html)`` and ``listed (url)`` from sitemaps.

    Where several pages have one URL (``a.htm`` and ``a.html``), the last by ``order`` (by ``relative``, or by url if pages have no
    such column) gives the state its columns, of equal ones the last by its signals; what the others link to counts as discovered all
    the same. Signals are written once and read by all that use them, so each page is parsed once.
    """
    ranked = F.col("relative" if "relative" in pages.columns else "url") if order is None else order
    read = Tables(pages.sparkSession, "signals").write(pages.select("url", ranked.alias("rank"), page_signals("html", "url").alias("s")), "pages")
    in_map = listed.select(url_key(F.col("url")).alias("url_key"), "url", F.lit("Sitemap").alias("source"), F.struct(F.lit(0), F.col("url").alias("page"), F.lit(0)).alias("prio"))
    rows = fold_sources(in_map.unionByName(page_facts(read)))
    last = read.groupBy(url_key(F.col("url")).alias("url_key")).agg(F.max(F.struct("rank", "s"))["s"].alias("s")).select("url_key", "s.*")
    own = with_meta_robots(last, "meta_robots", "html_meta_robots")
    own = own.select("url_key", F.lit(200).alias("http_status"), F.col("canonical").alias("html_canonical"), "html_meta_robots", "hreflang", F.col("internal_links").alias("internal_links_out"), "word_count", "heading_count")
    mapped = in_map.select("url_key", F.lit(True).alias("found_in_sitemap")).distinct()
    state = with_defaults(rows.join(own, "url_key", "left").join(mapped, "url_key", "left"))
    state = state.withColumn("robots_txt_status", robots_txt.status_column(path_and_query(F.col("url")), robots))
    return derive(static_not_found(state, base_url.rstrip("/")))


def scan_directory(spark: SparkSession, directory: str, base_url: str = BASE_URL, user_agent: str = USER_AGENT) -> Site:
    """The site of a directory. Reachability starts at the base URL, so without an index page nothing is reachable."""
    base = resolve(base_url, "/")
    files = cut(read_files(spark, directory))
    found = files.where("kind = 'robots'").select("body").head()
    robots = robots_txt.parse(found[0], base, user_agent) if found else None
    pages = files.where("kind = 'html'").select("relative", route_url(base)("relative").alias("url"), F.col("body").alias("html"))
    listed = sitemap.page_urls(files.where("kind = 'sitemap'").select(F.col("relative").alias("path"), "body"))
    state = cut(build_state(pages, listed, robots, base))
    return Site(with_reachability(state, base), base, base_url, utc_now())
