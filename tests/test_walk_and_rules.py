"""The walk against a plain one, hot targets, one pass of all families, and findings against a baseline by what changed."""

import random
from collections import deque
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sitefold.operators import findings, rules
from sitefold.operators.reach import Walk, reachable_keys
from sitefold.operators.rules import FAMILIES
from sitefold.operators.spread import dealt_join
from sitefold.operators.state import Site, derive, with_defaults
from sitefold.schemas import URL_STATE

LINKS = "url_key string, internal_links_out array<string>, redirect_target string"


def graph(spark, outs):
    return spark.createDataFrame([(k, v, None) for k, v in outs.items()], LINKS)


def distances(outs, entry):
    found, queue = ({entry: 0} if entry in outs else {}), deque([entry])
    while queue:
        at = queue.popleft()
        for to in outs.get(at, ()):
            to = to.partition("#")[0]
            if to in outs and to not in found:
                found[to] = found[at] + 1
                queue.append(to)
    return found


def walked(spark, outs, entry="n0", **kw):
    walk = Walk()
    return {r["url_key"]: r["depth"] for r in reachable_keys(graph(spark, outs), entry, walk, **kw).collect()}, walk


def test_a_long_chain_takes_as_many_rounds_as_its_length_has_digits(spark):
    outs = {f"n{k}": [f"n{k + 1}"] for k in range(1000)}
    outs["n500"] = ["n501", "n0", "off"]  # a page within it that isn't inner
    found, walk = walked(spark, outs)
    assert found == distances(outs, "n0") and found["n999"] == 999
    assert walk.doublings <= 10 and walk.rounds <= 3 and sum(walk.read) < 2 * 1000


def test_rounds_read_the_buckets_of_their_frontier(spark):
    """A home page, hubs, pages of hubs, and a tail of pages that each know the next two and the one before."""
    outs = {"n0": [f"h{k}" for k in range(4)] + ["t0"]}
    outs |= {f"h{k}": [f"p{k}-{j}" for j in range(400)] for k in range(4)}
    outs |= {f"p{k}-{j}": ["n0", f"h{k}", f"p{k}-{(j + 1) % 400}"] for k in range(4) for j in range(400)}
    outs |= {f"t{k}": [f"t{k + 1}", f"t{k + 2}", f"t{k - 1}"] for k in range(8)}
    found, walk = walked(spark, outs, share=100)
    assert found == distances(outs, "n0")
    assert walk.edges > 6000 and walk.rounds == 6 and sum(walk.read) < 2 * walk.edges and max(walk.read[3:]) < walk.edges / 5


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_distances_are_those_of_a_plain_walk(spark, seed):
    """Chains that branch and meet, rings (one of them with the entry), self-links, fragments, dead ends and a hub."""
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(120)]
    outs = {n: [rng.choice([*names, "gone", n]) + rng.choice(["", "#x"]) for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]))] for n in names}
    outs["n7"] = names[20:90]
    outs["n0"] = ["c0", "n7"] if seed > 1 else ["r1"]
    outs |= {f"c{k}": [f"c{k + 1}"] for k in range(20)} | {"c20": ["n5", "c3"]} | {f"x{k}": [f"x{(k + 1) % 5}"] for k in range(5)}
    outs |= {"r1": ["r2"], "r2": ["n0"] if seed == 1 else ["n9"]}
    found, _ = walked(spark, outs, share=8)
    assert found == distances(outs, "n0")


def test_no_entry_and_no_rows(spark):
    assert walked(spark, {"n1": ["n2"], "n2": []})[0] == {}
    assert walked(spark, {})[0] == {}
    assert walked(spark, {"n0": ["n0"]})[0] == {"n0": 0}


def test_hot_targets_are_dealt_out(spark):
    """A key with a third of all rows: no task reads thrice the median, with adaptive plans off."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k"))
        table = spark.range(-1, 5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        joined = dealt_join(rows, table, "k", rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), 200, F.xxhash64("id"))
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sum(sizes) == 60_000 and sizes[-1] < 3 * sizes[len(sizes) // 2]
        assert joined.where("v <> 2 * k").isEmpty() and dealt_join(rows, table.where("k > 100"), "k", rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), 200, F.xxhash64("id"), "left").count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def random_site(spark, seed, changed=()):
    """A site whose pages refer to each other at random; pages in ``changed`` are drawn anew."""
    rows = []
    for k in range(60):
        rng = random.Random(f"{seed}-{k}" if k not in changed else f"other-{seed}-{k}")
        page = lambda: f"https://a.test/{rng.randrange(70)}" + rng.choice(["", "", "#f"])  # noqa: E731, B023
        status = rng.choice([200, 200, 200, 404, 301, None])
        rows.append(
            {
                "url": f"https://a.test/{k}", "url_key": f"https://a.test/{k}", "http_status": status, "redirect_target": page() if status == 301 else None, "html_canonical": rng.choice([None, f"https://a.test/{k}", page()]),
                "http_canonical": rng.choice([None, None, page()]), "robots_txt_status": rng.choice(["NoRule", "Blocked", "NoRule"]), "internal_links_out": [page() for _ in range(rng.randrange(6))],
                "hreflang": [{"lang": x, "url": rng.choice([page(), f"https://a.test/{k}"])} for x in ("en", "de")[: rng.randrange(3)]], "found_in_sitemap": rng.random() < 0.5, "word_count": rng.choice([None, 50]),
                "is_reachable": rng.random() < 0.7,
            }
        )
    kinds = {f.name: f.dataType.simpleString() for f in URL_STATE} | {"url_key": "string"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows[0])
    return Site(derive(with_defaults(spark.createDataFrame([tuple(r.values()) for r in rows], schema))), "https://a.test/").cached()


def shown(frame, *more):
    return sorted(tuple(str(r[c]) for c in ("rule_id", "severity", "url", "message", "declared", "observed", "canonical", "detail", "rule_ord", "src_key", "pos", "seq", *more)) for r in frame.collect())


def test_one_pass_gives_what_the_families_give_alone(spark):
    site = random_site(spark, 1)
    whole = findings.run_rules(site)
    assert shown(whole) == sorted(x for f in FAMILIES for x in shown(f(site))) and whole.count() > 100
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1


@pytest.mark.parametrize("changed", [(), (3,), (3, 17, 40)])
def test_findings_against_a_baseline(spark, changed):
    old, new = random_site(spark, 2), random_site(spark, 2, changed)
    new = replace(new, state=new.state.where("url_key <> 'https://a.test/9'")).cached() if changed else new
    want = shown(findings.mark_new(findings.run_rules(new), findings.run_rules(old)), "is_new")
    assert shown(findings.against_baseline(new, old), "is_new") == want
    assert shown(findings.against_baseline(new, old, only_new=True), "is_new") == [x for x in want if x[-1] == "True"]
    affected = {r[0] for r in findings.affected_keys(old, new).collect()}
    assert len(affected) < 60 and {f"https://a.test/{k}" for k in changed} <= affected and bool(affected) == bool(changed)


def test_nothing_is_evaluated_where_nothing_changed(spark, monkeypatch):
    site, asked = random_site(spark, 4), []
    monkeypatch.setattr(findings, "evaluate", lambda s, families, only=None: asked.append(only) or rules.evaluate(s, families, only))
    marked = findings.against_baseline(site, replace(site))
    assert asked == [None] and marked.where("is_new").isEmpty() and not marked.isEmpty()  # the candidate's own findings, no baseline
    asked.clear()
    assert findings.against_baseline(site, replace(site), only_new=True).isEmpty() and asked[0].isEmpty()


def test_a_first_sitemap_affects_all_rows_and_own_rules_are_compared_by_key(spark):
    def odd(site):
        made = rules.canonical_presence(site).limit(0)
        own = site.state.where("word_count = 50").selectExpr("'OWN' AS rule_id", "'info' AS severity", "url", "'m' AS message", *[f"cast(NULL AS string) AS {e}" for e in ("declared", "observed", "canonical", "detail")], "99 AS rule_ord", "url_key AS src_key", "0 AS pos", "0 AS seq")
        return made.unionByName(own)

    new = random_site(spark, 5)
    old = replace(new, state=new.state.withColumn("found_in_sitemap", F.lit(False))).cached()
    assert findings.affected_keys(old, new).count() == 60
    families, more = (*FAMILIES, odd), rules.canonical_presence(new).withColumn("rule_id", F.lit("EXTRA"))
    want = shown(findings.mark_new(findings.run_rules(new, families, extra=more), findings.run_rules(old, families)), "is_new")
    assert shown(findings.against_baseline(new, old, families, extra=more), "is_new") == want
    assert {x[-1] for x in want if x[0] == "OWN"} == {"False"} and {x[-1] for x in want if x[0] == "EXTRA"} == {"True"}
