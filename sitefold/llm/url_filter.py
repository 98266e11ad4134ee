"""URL verdicts: explicit rules first, then logistic regression on hashed character n-grams of host and path.

All rows are judged by DataFrame functions. The fit collects a bounded number of labelled urls.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets for n-grams of the host and as many for those of the path; lengths of n-grams.
BUCKETS = 1 << 10
GRAMS = (3, 4)
#: Positions of a path or host that are read from one piece: a place in a string is found by counting from its start.
PIECE = 512
ROUNDS = 200
RATE = 4.0
PENALTY = 1e-4
#: Distinct labelled urls that a fit uses at most (about; more are sampled by a hash of the url).
LABELLED = 10_000
#: Rules are tested one by one up to this number, beyond it by a join on host suffixes, with the same results.
INLINE_RULES = 200

#: Invented hosts and paths that show what is meant. Fixed values.
_BLOCKED_HOSTS = (
    "ads-track.test", "adserver.test", "click-ads.invalid", "banner-ads.test", "tracker-ads.invalid", "casino-win.test", "casino-spin.invalid", "win-casino.invalid", "free-bets.test", "bets-online.invalid",
    "sport-bets.invalid", "cheap-pills.test", "pills-shop.invalid", "cheap-meds.invalid", "adult-x.test", "adult-cams.invalid", "xxx-adult.test", "x-cams.invalid", "spam-links.invalid", "link-farm.test",
)
_ALLOWED_HOSTS = (
    "garden.test", "cooking.invalid", "library.test", "village.invalid", "school.test", "museum.invalid", "project.test", "weather.invalid", "thering.test", "station.invalid", "hiking.test", "atlas.invalid",
    "thistle.test", "heather.test", "northern.invalid", "another.test", "gathering.invalid", "theatre.test", "thatch.invalid", "mother-earth.test", "wetlands.invalid", "tension.test", "thread.invalid", "author.test",
)
#: Hosts of both kinds of pages: only the path tells.
_MIXED_HOSTS = ("portal.test", "daily.invalid", "mirror.test", "forum.invalid", "homepages.test", "review.invalid", "journal.test", "community.invalid", "webring.test", "bulletin.invalid")
_BLOCKED_PATHS = ("/ads/click/17", "/track/pixel.gif", "/banner/728x90.html", "/casino/free-spins", "/bets/jackpot-odds", "/pills/buy-cheap", "/adult/live-cams", "/spam/link-exchange")
_ALLOWED_PATHS = ("/about", "/guide/index.html", "/recipes/soup", "/docs/manual", "/news/2021/story", "/library/catalogue", "/events/concert", "/research/paper")
_PLAIN_PATHS = ("/", "/en/17", "/de/4021.html", "/fr/88/", "/es/9530")


def _labelled_urls() -> tuple[tuple[str, int], ...]:
    out = []
    for block, hosts, paths in ((1, _BLOCKED_HOSTS, _BLOCKED_PATHS), (0, _ALLOWED_HOSTS, _ALLOWED_PATHS)):
        for k, host in enumerate(hosts):
            for prefix in (("", "m."), ("", "blog."), ("www.", "m."))[k % 3]:
                out += [(f"https://{prefix}{host}{path}", block) for path in (*paths[k % 4 :: 4], *_PLAIN_PATHS[k % 2 :: 2])]
        for k, host in enumerate(_MIXED_HOSTS):
            out += [(f"https://{host}{path}", block) for path in paths[k % 2 :: 2]]
    return tuple(out)


#: (url, 1 to block or 0 to allow).
LABELLED_URLS = _labelled_urls()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def _grams(part: str, seed: int) -> Column:
    """Bucket numbers of the n-grams of a column, its ends marked."""
    each = [
        f"flatten(transform(transform(sequence(1, greatest(length(t) - {n - 1}, 1), {PIECE}), s -> substring(t, s, {PIECE + n - 1})), p ->"
        f" transform(sequence(1, greatest(length(p) - {n - 1}, 1)), i -> cast(pmod(xxhash64(substring(p, i, {n}), {seed}), {BUCKETS}) AS int) + {seed * BUCKETS})))"
        for n in GRAMS
    ]
    return F.expr(f"aggregate(array(concat('^', {part}, '$')), cast(array() AS array<int>), (got, t) -> array_distinct(concat({', '.join(each)})))")


def url_buckets(urls: DataFrame) -> DataFrame:
    """Adds ``host``, ``path`` and ``buckets`` to a table with ``url``."""
    parts = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return parts.withColumn("buckets", F.array_distinct(F.concat(_grams("host", 0), _grams("path", 1))))


def _margin(weights: list[float], bias: float) -> Column:
    """The sum of weights over the square root of the number of buckets."""
    table = F.array(*[F.lit(w) for w in weights]) if len(weights) <= 8 else F.expr("array(" + ",".join(f"{w:.9e}D" for w in weights) + ")")
    total = F.aggregate("buckets", F.lit(0.0), lambda n, b: n + F.element_at(table, b + 1))
    return (total / F.sqrt(F.greatest(F.size("buckets"), F.lit(1))) + F.lit(float(bias))).alias("margin")


def fit_weights(labelled: DataFrame, rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY, most: int = LABELLED) -> tuple[list[float], float]:
    """Weights of a penalised logistic regression by gradient descent; ``labelled`` has ``url`` and ``block`` (0 or 1).

    Rows with a null url or label are left out; such without a host count like any other; repeated rows weigh as many times.
    Of more than ``most`` distinct urls about so many are taken, by a hash of the url. Their buckets come to the driver in one
    job, as they are few whatever the size of the tables that are judged. Without rows all weights are 0.
    """
    known = labelled.where("url IS NOT NULL AND block IN (0, 1)").groupBy("url", "block").agg(F.count(F.lit(1)).alias("n"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = url_buckets(known).select("block", "n", "buckets").collect()
    weights, bias = np.zeros(2 * BUCKETS), 0.0
    if not rows:
        return weights.tolist(), bias
    block, times = np.array([r["block"] for r in rows], float), np.array([r["n"] for r in rows], float)
    sizes = np.array([len(r["buckets"]) for r in rows])
    row, bucket = np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.array(r["buckets"], int) for r in rows])
    scale = 1 / np.sqrt(sizes)
    for _ in range(rounds):
        margin = np.bincount(row, weights[bucket], len(rows)) * scale + bias
        error = times * (1 / (1 + np.exp(-margin)) - block) / times.sum()
        weights -= rate * (np.bincount(bucket, (error * scale)[row], 2 * BUCKETS) + penalty * weights)
        bias -= rate * error.sum()
    return weights.tolist(), float(bias)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table."""
    quoted = ",".join(f"('{url}', {block})" for url, block in LABELLED_URLS)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(url, block)")


def _rule_parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def _ruled(parts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits; ties go to the longer host."""
    ranked = sorted(rules, key=lambda x: (-len(x[0]), -len(_rule_parts(x[0])[0]), x[0]))
    if len(ranked) <= INLINE_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for text, decision in reversed(ranked):
            host, path = _rule_parts(text)
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
        return parts.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    spark = parts.sparkSession
    table = spark.createDataFrame([(k, *_rule_parts(t), t, v) for k, (t, v) in enumerate(ranked)], "place int, rule_host string, rule_path string, rule string, rule_verdict string")
    pairs = parts.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    ends = pairs.select("host", "path", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")).alias("rule_host"))
    best = ends.join(table, "rule_host").where("startswith(path, rule_path)").groupBy("host", "path").agg(F.min(F.struct("place", "rule", "rule_verdict")).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(*parts.columns, "best.rule", "best.rule_verdict")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5,
    most: int = LABELLED,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``, one row per input row. With up to INLINE_RULES rules its rows
    are not shuffled; more rules are joined with them by host and path.

    ``rules`` are ``(host/path, block or allow)``: a rule fits its host and all subdomains if the path starts with its path;
    the longest wins. Where none fits, the verdict is block if the model's score is at least ``threshold``. Null urls and
    such without ``://`` have an empty host and path, and are scored like that. Null or repeated ids are passed through;
    other columns are ignored; urls of any length are read whole, for the score and for the rules.
    """
    spark = pages.sparkSession
    weights, bias = fit_weights(labelled if labelled is not None else labelled_urls(spark), most=most)
    parts = url_buckets(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")))
    scored = _ruled(parts.withColumn("score", 1 / (1 + F.exp(-_margin(weights, bias)))), rules)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
