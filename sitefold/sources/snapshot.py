"""Snapshots: the JSON form of a site and its validated reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.catalog import SCHEMA_VERSION, TOOL
from sitefold.operators.state import Site, statistics
from sitefold.schemas import SNAPSHOT, STATISTICS, URL_STATE

#: URLs that one JSON document takes at most.
MOST = 200_000


def to_json(site: Site) -> DataFrame:
    """One row with the snapshot as JSON text. For large sites ``write_table`` is the native form."""
    if site.state.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} URLs for one JSON document: use write_table")
    fields = [f.name for f in URL_STATE]
    urls = site.state.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("url_key", F.struct(*fields))))).alias("urls"))
    counts = statistics(site.state).select(F.struct(*STATISTICS).alias("statistics"))
    head = [F.lit(SCHEMA_VERSION).alias("version"), F.lit(TOOL).alias("tool"), F.lit(site.base_url).alias("base_url"), F.lit(site.public_origin).alias("public_origin")]
    when = F.coalesce(F.lit(site.scanned_at), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("scanned_at")
    options = {"ignoreNullFields": "false", "pretty": "true"}
    return urls.join(F.broadcast(counts)).select(F.to_json(F.struct(*head, when, "urls", "statistics"), options).alias("value"))


def from_frame(rows: DataFrame) -> Site:
    """The site of a frame with SNAPSHOT's columns and one row. Version, tool and stored statistics must be right."""
    head = rows.select("version", "tool", "base_url", "public_origin", "scanned_at", "statistics").head()
    return _checked(head, rows.select(F.explode("urls").alias("url_key", "s")).select("url_key", "s.*"))


def _checked(head: Row | None, state: DataFrame) -> Site:
    if head is None or head["version"] != SCHEMA_VERSION:
        raise ValueError(f"unsupported snapshot schema version: {head and head['version']}")
    if head["tool"] != TOOL:
        raise ValueError(f"snapshot was produced by an unsupported tool: {head['tool']}")
    computed = statistics(state).head().asDict()
    if head["statistics"] is None or {c: head["statistics"][c] for c in STATISTICS} != {c: computed[c] for c in STATISTICS}:
        raise ValueError("snapshot statistics do not match its URL states")
    return Site(state, head["base_url"], head["public_origin"], head["scanned_at"])


def read_json(spark: SparkSession, path: str) -> Site:
    """A snapshot of one JSON document; by lines where it has one for each URL, else as a whole.

    The line before the URLs is known by its text: of a folder's files Spark reads the largest first, whichever it is.
    """
    lines = spark.read.text(path)
    ends = _ends(lines)
    if any(x.startswith("{") for x in ends):
        return _by_lines(lines, ends, path)
    return from_frame(spark.read.schema(SNAPSHOT).option("multiLine", "true").option("mode", "FAILFAST").json(path))


def read_lines(spark: SparkSession, path: str) -> Site:
    """What ``documents.snapshot_json`` wrote, a file or a folder of its parts: lines are read and parsed by tasks wherever the
    files are split. The line before the URLs and the one after them are the header."""
    lines = spark.read.text(path)
    return _by_lines(lines, _ends(lines), path)


def _ends(lines: DataFrame) -> list[str]:
    """The lines before and after the URLs; a third is one too many."""
    return [r[0] for r in lines.where("value LIKE '{\"version\"%\"urls\": {' OR value LIKE '}, \"statistics\"%'").limit(3).collect()]


def _by_lines(lines: DataFrame, ends: list[str], path: str) -> Site:
    if sorted(x[:2] for x in ends) != ['{"', "},"]:
        raise ValueError(f"not a snapshot by lines: {path}")
    head, foot = sorted(ends)
    kinds = T.StructType([f for f in SNAPSHOT if f.name != "urls"])
    header = lines.sparkSession.createDataFrame([(head + foot,)], "value string").select(F.from_json("value", kinds, {"mode": "FAILFAST"}).alias("x")).select("x.*").head()
    entry = F.from_json(F.concat(F.lit("{"), F.substring("value", 2, 2147483647), F.lit("}")), T.MapType(T.StringType(), URL_STATE), {"mode": "FAILFAST"})
    urls = lines.where("value LIKE ' %' OR value LIKE ',%'").select(F.explode(entry).alias("url_key", "s"))
    return _checked(header, urls.select("url_key", "s.*"))


def write_table(site: Site, path: str) -> None:
    """The states as Parquet, with one row that has the header and statistics, for sites that one JSON document can't hold."""
    site.state.write.mode("overwrite").parquet(f"{path}/states")
    head = [F.lit(SCHEMA_VERSION).alias("version"), F.lit(TOOL).alias("tool"), F.lit(site.base_url).alias("base_url"), F.lit(site.public_origin).cast("string").alias("public_origin"), F.lit(site.scanned_at).cast("string").alias("scanned_at")]
    statistics(site.state).select(*head, F.struct(*STATISTICS).alias("statistics")).write.mode("overwrite").json(f"{path}/header", ignoreNullFields=False)


def read_table(spark: SparkSession, path: str) -> Site:
    """What ``write_table`` wrote; its header and statistics must be right, as those of the JSON form."""
    kinds = [f for f in SNAPSHOT if f.name != "urls"]
    return _checked(spark.read.schema(T.StructType(kinds)).option("mode", "FAILFAST").json(f"{path}/header").head(), spark.read.parquet(f"{path}/states"))
