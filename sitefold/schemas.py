"""Explicit schemas of the core tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

ROBOTS = T.StructType(
    [T.StructField(c, T.BooleanType()) for c in ("noindex", "nofollow", "noarchive", "nosnippet")]
    + [T.StructField("max_snippet", T.LongType()), T.StructField("max_image_preview", T.StringType()), T.StructField("max_video_preview", T.LongType()), T.StructField("unavailable_after", T.StringType())]
)
HREFLANG = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("url", T.StringType())]))
URL_STATE = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("http_status", T.IntegerType()), T.StructField("redirect_target", T.StringType()),
    T.StructField("redirect_chain", T.ArrayType(T.StringType())), T.StructField("html_canonical", T.StringType()), T.StructField("http_canonical", T.StringType()), T.StructField("html_meta_robots", ROBOTS),
    T.StructField("http_x_robots_tag", ROBOTS), T.StructField("robots_txt_status", T.StringType()), T.StructField("hreflang", HREFLANG), T.StructField("internal_links_out", T.ArrayType(T.StringType())),
    T.StructField("found_in_sitemap", T.BooleanType()), T.StructField("effective_canonical", T.StringType()), T.StructField("effective_robots", ROBOTS), T.StructField("is_indexable", T.BooleanType()),
    T.StructField("is_reachable", T.BooleanType()), T.StructField("word_count", T.LongType()), T.StructField("heading_count", T.LongType()),
])
STATISTICS = ("total_urls", "indexable_urls", "non_indexable_urls", "orphan_urls", "sitemap_urls", "internal_link_urls", "redirect_urls", "broken_urls")
SNAPSHOT = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("tool", T.StringType()), T.StructField("base_url", T.StringType()), T.StructField("public_origin", T.StringType()),
    T.StructField("scanned_at", T.StringType()), T.StructField("urls", T.MapType(T.StringType(), URL_STATE)), T.StructField("statistics", T.StructType([T.StructField(c, T.LongType()) for c in STATISTICS])),
])
SIGNALS = T.StructType([
    T.StructField("canonical", T.StringType()), T.StructField("meta_robots", T.ArrayType(T.StringType())), T.StructField("hreflang", HREFLANG), T.StructField("internal_links", T.ArrayType(T.StringType())),
    T.StructField("word_count", T.LongType()), T.StructField("heading_count", T.LongType()),
])
FETCHES = T.StructType([
    T.StructField("request_url", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("headers", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("body", T.StringType()),
])
EVIDENCE = ("declared", "observed", "canonical", "detail")
ORDER = ("rule_ord", "src_key", "pos", "seq")
FINDINGS = ("rule_id", "severity", "url", "message", *EVIDENCE, *ORDER)
