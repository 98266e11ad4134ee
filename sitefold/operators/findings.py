"""Running rule families, ordering, keys, exclusions, gates and summaries of findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.catalog import CATALOG, SEVERITIES
from sitefold.functions.globs import glob_regex
from sitefold.functions.urls import path_and_query
from sitefold.operators.checkpoints import Tables
from sitefold.operators.rules import FAMILIES, TARGET, Family, evaluate
from sitefold.operators.spread import dealt_join
from sitefold.operators.state import Site
from sitefold.schemas import URL_STATE

KEY = ("rule_id", "url", "severity", "subject")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def in_report_order(findings: DataFrame) -> DataFrame:
    """Severity descending, rule, url; ties in the order of rules, rows, entries and emission."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "rule_id", "url", "rule_ord", "src_key", "pos", "seq")


Rules = tuple[Family | Callable[[Site], DataFrame], ...]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_rules(site: Site, families: Rules = FAMILIES, exclusions: list[dict] | None = None, extra: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """All findings of a site, those of the families in one pass. ``families`` may hold further functions of a site; ``extra``
    takes findings such as losses; ``only (url_key)`` limits the rows that the families look at."""
    own = tuple(f for f in families if isinstance(f, Family))
    parts = ([evaluate(site, own, only)] if own else []) + [f(site) for f in families if not isinstance(f, Family)] + ([extra] if extra is not None else [])
    return exclude(_union(parts), exclusions or [])


def exclude(findings: DataFrame, exclusions: list[dict]) -> DataFrame:
    """Without findings whose rule has a pattern that fits the whole url or its path and query.

    The patterns are configuration on the driver, so they become literals of one filter, not a join. The site-wide finding
    has no path and can't be excluded.
    """
    hit = F.lit(False)
    for rule in dict.fromkeys(x["rule_id"] for x in exclusions):
        fits = F.lit(False)
        for x in exclusions:
            if x["rule_id"] == rule:
                regex = glob_regex(x["url_pattern"])
                fits = fits | F.col("url").rlike(regex) | path_and_query(F.col("url")).rlike(regex)
        hit = hit | ((F.col("rule_id") == rule) & F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & fits)
    return findings.where(~hit) if exclusions else findings


def with_subject(findings: DataFrame) -> DataFrame:
    """Adds the last part of the finding key: declared, else canonical, else detail."""
    return findings.withColumn("subject", F.coalesce("declared", "canonical", "detail"))


def mark_new(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds ``is_new``: no finding of the baseline has the same key. Null subjects are equal."""
    old = with_subject(baseline).select(*[F.col(c).alias(f"b_{c}") for c in KEY]).distinct().withColumn("known", F.lit(True))
    now = with_subject(findings)
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in KEY]
    return now.join(old, same, "left").withColumn("is_new", F.col("known").isNull()).drop("subject", "known", *[f"b_{c}" for c in KEY])


def _prints(site: Site, p: str) -> DataFrame:
    """A 128-bit print of each row, and one of what rules look at in a row that others refer to."""
    hashed = lambda columns, name: [F.xxhash64(F.lit(k), *columns).alias(f"{p}{name}{k}") for k in (1, 2)]
    return site.state.select("url_key", *hashed([F.col(f.name) for f in URL_STATE], "own"), *hashed([F.expr(v) for v in TARGET.values()], "target"))


def affected_keys(baseline: Site, candidate: Site) -> DataFrame:
    """``(url_key)`` of rows whose findings can differ between two sites: all others have equal ones in both.

    A finding depends on its row, on the rows that this one refers to, and on whether any row is in a sitemap. So a row is
    affected if its print differs or is missing on one side, or if it refers to a row of which that holds. Rows that didn't change
    have the same references in both sites, so those of the candidate are enough. If a first or the last sitemap entry came
    or went, all rows are affected.
    """
    tables = Tables(candidate.state.sparkSession, "affected")
    both = _prints(baseline, "b_").join(_prints(candidate, "c_"), "url_key", "full_outer")
    differs = lambda name: F.expr(" OR ".join(f"NOT (b_{name}{k} <=> c_{name}{k})" for k in (1, 2)))
    changed = tables.write(both.where(differs("own")).select("url_key", differs("target").alias("as_target")), "changed")
    some = [s.state.where("found_in_sitemap").limit(1).count() for s in (baseline, candidate)]
    if some[0] != some[1]:
        return tables.write(baseline.state.select("url_key").unionByName(candidate.state.select("url_key")).distinct(), "all")
    counts, share = candidate.reference_counts()
    moved = changed.where("as_target").select(F.col("url_key").alias("target_key"))
    near = dealt_join(candidate.references().select("src_key", "pos", "target_key"), moved, "target_key", counts, share, F.xxhash64("src_key", "pos"), "left_semi")
    return tables.write(changed.select("url_key").unionByName(near.select(F.col("src_key").alias("url_key"))).distinct(), "keys")


def against_baseline(candidate: Site, baseline: Site, families: Rules = FAMILIES, exclusions: list[dict] | None = None, extra: DataFrame | None = None, only_new: bool = False) -> DataFrame:
    """Findings of the candidate with ``is_new``: no finding of the baseline has the same key.

    The families are evaluated in the baseline only at affected rows (``affected_keys``): where nothing changed a finding is known
    by proof. With ``only_new`` they are evaluated only there in the candidate too, and known findings are left out. A finding's key
    has its row's url, so one at an affected row can only be known from that row. Further functions among ``families`` and ``extra``
    are no data, so they run on both sites and are compared by key.
    """
    own = tuple(f for f in families if isinstance(f, Family))
    rest = tuple(f for f in families if not isinstance(f, Family))
    keys = affected_keys(baseline, candidate)
    old = ([evaluate(baseline, own, keys)] if own and not keys.isEmpty() else []) + [f(baseline) for f in rest]
    parts = []
    if own:
        found = evaluate(candidate, own, keys) if only_new else evaluate(candidate, own)
        parts.append(found.join(keys.select(F.col("url_key").alias("src_key"), F.lit(True).alias("affected")), "src_key", "left"))
    parts += [f.withColumn("affected", F.lit(True)) for f in [g(candidate) for g in rest] + ([extra] if extra is not None else [])]
    now = exclude(_union(parts), exclusions or [])
    if not old:
        marked = now.withColumn("is_new", F.coalesce("affected", F.lit(False)))
    else:
        settled = now.where("affected IS NULL").withColumn("is_new", F.lit(False))
        marked = mark_new(now.where("affected"), exclude(_union(old), exclusions or [])).unionByName(settled)
    marked = marked.drop("affected")
    return marked.where("is_new") if only_new else marked


def gate(findings: DataFrame, fail_on: list[str], only_new: bool = False) -> bool:
    """Whether a finding of one of the severities exists (of the new ones, if asked)."""
    hits = findings.where(F.col("severity").isin([s.lower() for s in fail_on or ["error"]]))
    return not (hits.where("is_new") if only_new else hits).limit(1).isEmpty()


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def by_rule(findings: DataFrame) -> DataFrame:
    """Per rule its count and the severity of its first finding in report order."""
    first = F.struct((-severity_rank(F.col("severity"))).alias("r"), "url", "rule_ord", "src_key", "pos", "seq")
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("severity", first).alias("severity"))


def with_catalog(findings: DataFrame) -> DataFrame:
    """Adds the catalogue's description and default severity; null for rules that it lacks."""
    rows = ",".join(f"('{r.id}','{r.severity}','{r.description}')" for r in CATALOG)
    table = findings.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS c(rule_id, default_severity, description)")
    return findings.join(F.broadcast(table), "rule_id", "left")
