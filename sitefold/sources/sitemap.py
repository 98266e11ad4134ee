"""Sitemap XML as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions.urls import resolve_url

_CHILD = "/*[local-name()=\"{root}\"]/*[local-name()=\"{item}\"]"


def locations(files: DataFrame) -> DataFrame:
    """``(path, root, loc)`` from a table of ``(path, body)``: the entries of urlsets and the children of sitemap indexes.

    Malformed XML, an unknown root and entries without a valid absolute loc are errors, as they are for a crawler that must
    not guess. Namespace prefixes don't matter; entities are decoded and white space around a loc is dropped.
    """
    root = F.expr("xpath_string(body, 'local-name(/*)')")
    read = files.select("path", root.alias("root"), *[F.expr(f"xpath(body, '{_CHILD.format(root=r, item=i)}/*[local-name()=\"loc\"]/text()')").alias(r) for r, i in (("urlset", "url"), ("sitemapindex", "sitemap"))],
                        *[F.expr(f"xpath_int(body, 'count({_CHILD.format(root=r, item=i)})')").alias(f"n_{r}") for r, i in (("urlset", "url"), ("sitemapindex", "sitemap"))])
    known = read.withColumn("root", F.when(F.col("root").isin("urlset", "sitemapindex"), F.col("root")).otherwise(F.raise_error(F.concat(F.lit("not a sitemap: "), "path"))))
    locs = F.when(F.col("root") == "urlset", F.col("urlset")).otherwise(F.col("sitemapindex"))
    n = F.when(F.col("root") == "urlset", F.col("n_urlset")).otherwise(F.col("n_sitemapindex"))
    whole = known.select("path", "root", F.when(F.size(locs) == n, locs).otherwise(F.raise_error(F.concat(F.lit("entry without loc: "), "path"))).alias("locs"))
    each = whole.select("path", "root", F.explode("locs").alias("loc")).withColumn("loc", F.trim("loc"))
    valid = F.col("loc").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^\s/]")
    return each.withColumn("loc", F.when(valid, F.col("loc")).otherwise(F.raise_error(F.concat(F.lit("invalid loc: "), "loc"))))


def page_urls(files: DataFrame) -> DataFrame:
    """The distinct normalised page URLs of urlsets; the entries of an index are other files."""
    rows = locations(files).where("root = 'urlset'")
    return rows.select(resolve_url("loc", "loc").alias("url")).where("url IS NOT NULL").distinct()


def entries(files: DataFrame) -> DataFrame:
    """``(path, loc, lastmod, changefreq, priority)`` of urlsets, all but ``priority`` (a double) as text."""
    item = "struct<loc:string,lastmod:string,changefreq:string,priority:string>"
    bare = F.regexp_replace(F.regexp_replace("body", r"(</?)[A-Za-z_][\w.\-]*:", "$1"), r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    parsed = files.select("path", F.from_xml(bare, f"struct<url:array<{item}>>", {"rowTag": "urlset", "mode": "FAILFAST"}).alias("set"))
    each = parsed.select("path", F.explode("set.url").alias("u"))
    return each.select("path", F.trim("u.loc").alias("loc"), "u.lastmod", "u.changefreq", F.expr("try_cast(u.priority AS double)").alias("priority"))
