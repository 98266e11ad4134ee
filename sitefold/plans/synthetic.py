"""A synthetic site over the driver's tables, as SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.operators.reach import with_reachability
from sitefold.operators.state import Site, derive, with_defaults

HOME = "https://site.test/"

_P = "concat('https://site.test/p/', {})"
#: Pages: part rows, then home and one hub page per supplier.
PAGES = f"""
SELECT p_partkey AS k, {_P.format('p_partkey')} AS url,
 CASE WHEN p_partkey % 41 = 0 THEN 404 WHEN p_partkey % 37 = 0 THEN 301 WHEN p_partkey % 53 = 0 THEN NULL ELSE 200 END AS http_status,
 CASE WHEN p_partkey % 37 = 0 AND p_partkey % 41 <> 0 THEN {_P.format('p_partkey + 1')} END AS redirect_target,
 CASE WHEN p_partkey % 19 IN (4, 5) THEN {_P.format('p_partkey + 1')} WHEN p_partkey % 29 = 3 THEN {_P.format('p_partkey + 1')} WHEN p_partkey % 29 = 4 THEN {_P.format('p_partkey - 1')}
  WHEN p_partkey % 13 = 0 THEN NULL ELSE {_P.format('p_partkey')} END AS html_canonical,
 CASE WHEN p_partkey % 31 = 0 THEN {_P.format('p_partkey + 2')} WHEN p_partkey % 26 = 0 THEN {_P.format('p_partkey')} END AS http_canonical,
 CASE WHEN p_partkey % 43 = 0 THEN true WHEN p_partkey % 47 = 0 THEN false END AS meta_noindex,
 CASE WHEN p_partkey % 86 = 0 THEN false WHEN p_partkey % 94 = 0 THEN true END AS http_noindex,
 p_partkey % 59 = 0 AS blocked, p_partkey % 5 <> 0 AS in_sitemap,
 CASE WHEN p_partkey % 41 = 0 OR p_partkey % 37 = 0 OR p_partkey % 53 = 0 OR p_partkey % 61 = 0 THEN NULL ELSE CAST(p_size * 10 AS bigint) END AS word_count,
 CASE WHEN p_partkey % 41 = 0 OR p_partkey % 37 = 0 OR p_partkey % 53 = 0 OR p_partkey % 61 = 0 THEN NULL ELSE CAST(1 + p_size % 7 AS bigint) END AS heading_count
FROM part
UNION ALL SELECT CAST(0 AS bigint), '{HOME}', 200, NULL, '{HOME}', NULL, NULL, NULL, false, true, CAST(120 AS bigint), CAST(3 AS bigint)
UNION ALL SELECT s_suppkey, concat('https://site.test/s/', s_suppkey), 200, NULL, concat('https://site.test/s/', s_suppkey), NULL, NULL, NULL, false, true, CAST(80 AS bigint), CAST(2 AS bigint) FROM supplier
"""
LINKS = f"""
SELECT DISTINCT src, link_url FROM (
 SELECT '{HOME}' AS src, concat('https://site.test/s/', s_suppkey) AS link_url FROM supplier WHERE s_suppkey % 7 <> 0
 UNION ALL SELECT concat('https://site.test/s/', l_suppkey), {_P.format('l_partkey')} FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 23 <> 0
 UNION ALL SELECT {_P.format('p_partkey')}, {_P.format('p_partkey + 1')} FROM part WHERE p_partkey % 10 = 1) x
"""
HREFLANG = f"""
SELECT {_P.format('p_partkey')} AS src, 0 AS pos, 'en' AS lang, {_P.format('p_partkey')} AS target FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT {_P.format('p_partkey')}, 1, 'es', {_P.format('p_partkey + 1')} FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT {_P.format('p_partkey')}, 0, 'en', {_P.format('p_partkey - 1')} FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 5 <> 0
UNION ALL SELECT {_P.format('p_partkey')}, 1, 'es', {_P.format('p_partkey')} FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 5 <> 0
UNION ALL SELECT {_P.format('p_partkey')}, 0, 'fr', {_P.format('p_partkey + 1')} FROM part WHERE p_partkey % 3 = 2 AND p_partkey % 7 = 0
"""


def named(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = [n for n in ("part", "supplier", "lineitem") if n in text]
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **tables)


def _robots(noindex: str) -> str:
    return (
        f"CASE WHEN {noindex} IS NOT NULL THEN named_struct('noindex', {noindex}, 'nofollow', cast(NULL AS boolean), 'noarchive', cast(NULL AS boolean), 'nosnippet', cast(NULL AS boolean),"
        " 'max_snippet', cast(NULL AS bigint), 'max_image_preview', cast(NULL AS string), 'max_video_preview', cast(NULL AS bigint), 'unavailable_after', cast(NULL AS string)) END"
    )


def base_state(spark: SparkSession, sf_dir: str, drop: int | None = None) -> DataFrame:
    """URL states before derivation; ``drop`` leaves out pages whose k % drop is 1."""
    pages = named(spark, sf_dir, PAGES)
    pages = pages.where(f"k % {drop} <> 1") if drop else pages
    links = named(spark, sf_dir, LINKS).groupBy("src").agg(F.array_sort(F.collect_list("link_url")).alias("internal_links_out"))
    lang = named(spark, sf_dir, HREFLANG).groupBy("src").agg(F.expr("transform(array_sort(collect_list(struct(pos, lang, target))), x -> named_struct('lang', x.lang, 'url', x.target))").alias("hreflang"))
    rows = pages.join(links.withColumnRenamed("src", "url"), "url", "left").join(lang.withColumnRenamed("src", "url"), "url", "left")
    chain = "CASE WHEN redirect_target IS NOT NULL THEN CASE WHEN k % 74 = 0 THEN array(url, redirect_target, url) ELSE array(url, redirect_target) END END"
    sources = "CASE WHEN in_sitemap THEN array('Sitemap', 'DirectScan') ELSE array('InternalLink') END"
    return rows.selectExpr(
        "k", "url AS url_key", "url", "http_status", "redirect_target", "html_canonical", "http_canonical", f"{_robots('meta_noindex')} AS html_meta_robots", f"{_robots('http_noindex')} AS http_x_robots_tag",
        "CASE WHEN blocked THEN 'Blocked' ELSE 'NoRule' END AS robots_txt_status", "in_sitemap AS found_in_sitemap", "word_count", "heading_count", "internal_links_out", "hreflang", f"{chain} AS redirect_chain", f"{sources} AS sources",
    )


def site(spark: SparkSession, sf_dir: str, reach: bool = False) -> Site:
    state = derive(with_defaults(base_state(spark, sf_dir)))
    return Site(with_reachability(state.persist(), HOME) if reach else state, HOME)


def baseline(spark: SparkSession, sf_dir: str) -> Site:
    return Site(derive(with_defaults(base_state(spark, sf_dir, 67))), HOME)


def candidate(spark: SparkSession, sf_dir: str) -> Site:
    rows = base_state(spark, sf_dir, 71)
    rows = rows.withColumn("html_canonical", F.expr("CASE WHEN k % 83 <> 1 THEN html_canonical END")).withColumn("http_canonical", F.expr("CASE WHEN k % 83 <> 1 THEN http_canonical END"))
    rows = rows.withColumn("word_count", F.expr("CASE WHEN k % 9 = 0 THEN cast(floor(word_count / 4) AS bigint) ELSE word_count END"))
    rows = rows.withColumn("heading_count", F.expr("CASE WHEN k % 8 = 0 THEN greatest(heading_count - 2, 0L) ELSE heading_count END"))
    # hubs whose number ends in 3 lose the last half of their links, so that link losses occur
    rows = rows.withColumn("internal_links_out", F.expr("CASE WHEN k % 10 = 3 AND contains(url, '/s/') THEN slice(internal_links_out, 1, cast(size(internal_links_out) div 2 AS int)) ELSE internal_links_out END"))
    return Site(derive(with_defaults(rows)), HOME)
