"""robots.txt: the rules of the group that holds for a user agent, and their evaluation over URLs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.functions.robots import pattern_regex, specificity
from sitefold.functions.urls import resolve
from sitefold.operators.checkpoints import cut
from sitefold.operators.spread import dealt_join, share_of

#: Longest crawl delay that is accepted, in seconds.
LONGEST_DELAY = 60.0
#: Lengths to which the literal starts of rules are cut where rules and paths meet.
PREFIXES = (*range(32), *range(32, 128, 8), 128, 256)


@dataclass
class RobotsTxt:
    rules: list[tuple[str, bool]] = field(default_factory=list)
    crawl_delay: float | None = None
    sitemaps: list[str] = field(default_factory=list)
    agent: str = "*"


def _entries(body: str) -> list[tuple[str, str]]:
    pairs = (line.partition("#")[0].strip().partition(":") for line in body.lstrip("﻿").splitlines())
    return [(key.strip().lower(), value.strip()) for key, colon, value in pairs if colon]


def parse(body: str, base_url: str, user_agent: str) -> RobotsTxt:
    """Runs of ``User-agent`` lines open a group, whatever follows them belongs to it; groups of one agent are joined.

    An empty agent is skipped; an empty Allow or Disallow gives no rule; a named group without rules restricts nothing.
    ``Sitemap`` lines hold for the whole file and neither open nor close a group.
    """
    entries = _entries(body)
    sitemaps = [u for u in (resolve(base_url, v) for k, v in entries if k == "sitemap") if u]
    rules: dict[str, list[tuple[str, bool]]] = {}
    delays: dict[str, float] = {}
    agents: list[str] = []
    rest = [(k, v) for k, v in entries if k != "sitemap" and not (k == "user-agent" and not v)]
    for opening, run in groupby(rest, lambda e: e[0] == "user-agent"):
        if opening:
            # entries of keys that robots don't know, before any agent, open nothing
            agents = [v.lower() for _, v in run]
            for a in agents:
                rules.setdefault(a, [])
            continue
        for key, value in run:
            if key in ("allow", "disallow") and value:
                for a in agents:
                    rules[a].append((value, key == "allow"))
            elif key == "crawl-delay":
                seconds = _seconds(value)
                if seconds is not None:
                    delays.update(dict.fromkeys(agents, seconds))
    agent = select_agent(list(rules), user_agent)
    return RobotsTxt(rules.get(agent, []), delays.get(agent), sitemaps, agent)


def _seconds(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if math.isfinite(value) and value >= 0 else None


def select_agent(agents: list[str], user_agent: str) -> str:
    """The longest agent token within the user agent, the first in order among equals; else the wildcard."""
    low = user_agent.lower()
    return min((a for a in agents if a != "*" and a in low), key=lambda a: (-len(a.encode()), a), default="*")


_RULE = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("allowed", T.BooleanType())])
_FILE = T.StructType([T.StructField("agent", T.StringType()), T.StructField("rules", T.ArrayType(_RULE)), T.StructField("delay", T.DoubleType()), T.StructField("sitemaps", T.ArrayType(T.StringType()))])


@F.pandas_udf(_FILE)
def parsed(body: pd.Series, base_url: pd.Series, user_agent: pd.Series) -> pd.DataFrame:
    """``parse`` over a table of files, for many hosts: the group that holds for each row's agent. A null body has no rules."""
    read = [parse(b or "", u, a or "") for b, u, a in zip(body, base_url, user_agent, strict=True)]
    rules = [[{"pattern": p, "allowed": x} for p, x in r.rules] for r in read]
    return pd.DataFrame({"agent": [r.agent for r in read], "rules": rules, "delay": pd.Series([r.crawl_delay for r in read], dtype="float64"), "sitemaps": [r.sitemaps for r in read]})


def status_column(path: Column, robots: RobotsTxt | None) -> Column:
    """``Allowed``, ``Blocked`` or ``NoRule`` of a path and query: the most specific rule that fits, Allow among equals.

    A file has few rules; they become one expression, tried from the most specific on, so nothing is joined.
    """
    if robots is None:
        return F.lit("NoRule")
    out = F.lit("NoRule")
    for pattern, allowed in sorted(robots.rules, key=lambda r: (specificity(r[0]), r[1])):
        out = F.when(path.rlike(pattern_regex(pattern)), "Allowed" if allowed else "Blocked").otherwise(out)
    return out


def posted(rules: DataFrame) -> DataFrame:
    """Rules with ``plain``, the whole pattern where it has no wildcard and no end mark (else null), and ``prefix``, under which
    they are found: the characters before the first wildcard, cut to the longest length of PREFIXES that they have."""
    literal = F.substring_index(F.regexp_replace("pattern", r"\$\z", ""), "*", 1)
    cuts = F.coalesce(*[F.when(F.length("literal") >= n, F.substring("literal", 1, n)) for n in reversed(PREFIXES)])
    return rules.withColumn("literal", literal).withColumns({"prefix": cuts, "plain": F.when(F.col("literal") == F.col("pattern"), F.col("literal"))}).drop("literal")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, status)`` for tables of ``(url, path)`` and of ``(pattern, regex, specificity, allowed)``.

    The set-based form of ``status_column``, for rules of any number. A rule is posted under the characters before its first
    wildcard, cut to a length of a grid; a path asks for its own first characters of those lengths that rules use. They meet
    by equal prefixes, and only such pairs are compared: by the literal where the rule has no wildcard, else by the regular
    expression. A url's best rule is a maximum of partial maxima. Pairs are counted by prefix before they are made, and prefixes
    with very many are dealt out by url. Rules that start with a wildcard are met by every path.
    """
    kept = cut(posted(rules))
    used = sorted(r[0] for r in kept.select(F.length("prefix")).distinct().collect())  # at most the lengths of the grid
    asked = urls.select("url", "path", F.explode(F.array(*[F.lit(n) for n in used]).cast("array<int>")).alias("n")).where("length(path) >= n")
    asked = asked.select("url", "path", F.expr("substring(path, 1, n)").alias("prefix"))
    pairs = asked.groupBy("prefix").agg(F.count(F.lit(1)).alias("paths")).join(kept.groupBy("prefix").agg(F.count(F.lit(1)).alias("rules")), "prefix")
    counts = cut(pairs.select("prefix", (F.col("paths") * F.col("rules")).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    share = share_of(total)
    near = dealt_join(asked, kept, "prefix", counts if total > share else None, share, F.xxhash64("url"))
    fits = near.where("CASE WHEN plain IS NOT NULL THEN startswith(path, plain) ELSE path RLIKE regex END").select("url", F.struct("specificity", "allowed").alias("best"))
    all_urls = urls.select("url", F.lit(None).cast(fits.schema["best"].dataType).alias("best"))
    met = all_urls.unionByName(fits).groupBy("url").agg(F.max("best").alias("best"))
    return met.select("url", F.expr("CASE WHEN best.specificity IS NULL THEN 'NoRule' WHEN best.allowed THEN 'Allowed' ELSE 'Blocked' END").alias("status"))


def crawl_delay(option: float | None, robots: RobotsTxt | None) -> float | None:
    """The delay between requests: the option before robots.txt; one above LONGEST_DELAY is an error."""
    delay = option if option is not None else (robots.crawl_delay if robots else None)
    if delay is not None and not 0 <= delay <= LONGEST_DELAY:
        raise ValueError(f"crawl delay of {delay} s is not within 0 to {LONGEST_DELAY:g} s")
    return delay
