"""Robots rules as a table, found by the literal starts of their patterns."""

import random

from pyspark.sql import functions as F

from sitefold.functions.robots import pattern_regex, specificity
from sitefold.sources import robots_txt
from sitefold.sources.robots_txt import RobotsTxt, match_rules, posted, status_column

RULES = "pattern string, regex string, specificity int, allowed boolean"


def table(spark, rules):
    return spark.createDataFrame([(p, pattern_regex(p), specificity(p), a) for p, a in rules], RULES)


def test_starts_of_patterns(spark):
    patterns = ["", "*", "/", "/a$", "/a$b", "/a*b$", "/abcde", "$", "/" + "x" * 400, "/é/ü"]
    got = {r["pattern"]: (r["prefix"], r["plain"]) for r in posted(table(spark, [(p, True) for p in patterns])).collect()}
    assert got == {
        "": ("", ""), "*": ("", None), "/": ("/", "/"), "/a$": ("/a", None), "/a$b": ("/a$b", "/a$b"), "/a*b$": ("/a", None), "/abcde": ("/abcde", "/abcde"), "$": ("", None),
        patterns[8]: (patterns[8][:256], patterns[8]), "/é/ü": ("/é/ü", "/é/ü"),
    }


def test_the_table_agrees_with_the_expression(spark, monkeypatch):
    """Also where every prefix is hot."""
    rng = random.Random(6)
    part = lambda: rng.choice(["a", "b", "/", "*", "$", ".", "+", "é", "ab/"])
    rules = list({"/" + "".join(part() for _ in range(rng.randrange(6))): rng.random() < 0.5 for _ in range(60)}.items()) + [("*b$", False), ("*", True)]
    paths = ["/" + "".join(part() for _ in range(rng.randrange(8))).replace("*", "c") for _ in range(300)] + ["/", "", "/a\nb", "/" + "a" * 5000]
    urls = spark.createDataFrame([(f"u{k}", p) for k, p in enumerate(paths)] + [("none", None)], "url string, path string").repartition(3)
    for some in (rules, rules[:5], []):
        want = {r[0]: r[1] for r in urls.select("url", F.coalesce(status_column(F.col("path"), RobotsTxt(rules=some)), F.lit("NoRule"))).collect()}
        assert {r["url"]: r["status"] for r in match_rules(urls, table(spark, some)).collect()} == want
        monkeypatch.setattr(robots_txt, "share_of", lambda total: 7)
    assert match_rules(urls.limit(0), table(spark, rules)).collect() == []


def test_a_hundred_thousand_rules(spark):
    """No nested loop, no pairs but those with an equal start."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = spark.range(100_000).select(F.concat(F.lit("/shop/item-"), "id").alias("pattern"), F.col("id"))
        rules = plain.select("pattern", F.concat(F.lit("(?s)^"), F.col("pattern")).alias("regex"), F.length("pattern").alias("specificity"), (F.col("id") % 2 == 0).alias("allowed"))
        urls = spark.range(0, 200_000, 50).select(F.concat(F.lit("https://a.test/shop/item-"), "id").alias("url"), F.concat(F.lit("/shop/item-"), "id").alias("path"))
        found = match_rules(urls, rules)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Broadcast" not in plan
        got = {r["url"].rpartition("-")[2]: r["status"] for r in found.collect()}
        known = {str(k) for k in range(100_000)}

        def longest(text):
            fits = [text[:n] for n in range(len(text), 0, -1) if text[:n] in known]
            return "NoRule" if not fits else "Allowed" if int(fits[0]) % 2 == 0 else "Blocked"

        assert len(got) == 4000 and got == {k: longest(k) for k in got}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
