"""Documents of any size: what tasks render is sorted and written as lines, between lines that the driver adds.

A document is a table of lines in order. Written, it is a folder of text files whose bytes in the order of their names are the
document; streamed, it passes through the driver one partition at a time. So neither the driver nor a task holds it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold import __version__
from sitefold.catalog import BY_ID, SCHEMA_VERSION, TOOL
from sitefold.operators import diff as diffs
from sitefold.operators.checkpoints import Tables
from sitefold.operators.findings import KEY, severity_rank, with_subject
from sitefold.operators.state import Site, statistics
from sitefold.schemas import EVIDENCE, ORDER, STATISTICS, URL_STATE
from sitefold.sinks import wording

LEVELS = {"error": "error", "warning": "warning", "info": "note"}
_KEPT = {"ignoreNullFields": "false"}


@dataclass
class Items:
    """Rows of ``text`` in the order of other columns: elements of a JSON array or object, or what stands by itself."""

    rows: DataFrame
    order: list
    commas: bool = True


class Document:
    """Sections in order: texts of the driver, and items of tables, which commas may set apart."""

    def __init__(self, spark: SparkSession, *sections: str | Items):
        tables, parts = Tables(spark, "document"), []
        for k, section in enumerate(sections):
            if isinstance(section, str):
                lines = spark.createDataFrame([(k, 0, section)], "section int, at long, text string")
            else:
                sorted_ = section.rows.orderBy(*section.order).select(F.monotonically_increasing_id().alias("at"), "text")
                written = tables.write(sorted_, f"section-{k}")
                text = F.col("text")
                if section.commas:
                    first = written.agg(F.coalesce(F.min("at"), F.lit(-1))).head()[0]
                    text = F.concat(F.when(F.col("at") == first, " ").otherwise(","), text)
                lines = written.select(F.lit(k).alias("section"), "at", text.alias("text"))
            parts.append(lines)
        lines = parts[0]
        for p in parts[1:]:
            lines = lines.unionByName(p)
        self.lines = lines

    def write(self, path: str) -> None:
        """A folder of text files, written by tasks."""
        self.lines.orderBy("section", "at").select("text").write.mode("overwrite").text(path)

    def stream(self) -> Iterator[str]:
        return (r["text"] for r in self.lines.orderBy("section", "at").toLocalIterator())

    def copy_to(self, out: TextIO) -> None:
        for line in self.stream():
            out.write(line + "\n")


def quoted(column: str) -> str:
    """SQL of a text as JSON, null as null."""
    return f"coalesce(substring(to_json(named_struct('x', {column})), 6, length(to_json(named_struct('x', {column}))) - 6), 'null')"


def _report_order() -> list:
    return [severity_rank(F.col("severity")).desc(), F.col("rule_id"), F.col("url"), *[F.col(c) for c in ORDER]]


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _summary(findings: DataFrame, marked: bool) -> dict:
    n = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in LEVELS], *([F.count_if("is_new").alias("new")] if marked else []), F.count(F.lit(1)).alias("total")).head()
    return {"total": n["total"], "errors": n["error"], "warnings": n["warning"], "infos": n["info"], "new": n["new"] if marked else None}


def _changed(baseline: Site, candidate: Site) -> DataFrame:
    """Changed URLs with their changes as JSON; values are booleans, numbers or texts by kind."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' WHEN kind IN ('index_changed', 'word_count_changed', 'link_count_changed') THEN {c} ELSE {quoted(c)} END"
    ends = f"concat(', \"from\": ', {value('from_value')}, ', \"to\": ', {value('to_value')})"
    each = F.expr(f"concat('{{\"kind\": \"', kind, '\"', CASE WHEN kind = 'robots_changed' THEN '' ELSE {ends} END, '}}')")
    listed = diffs.changes(baseline, candidate).groupBy("url_key").agg(F.array_sort(F.collect_list(F.struct("seq", each.alias("t")))).alias("c"))
    return listed.select("url_key", F.concat(F.lit('{"url": '), F.expr(quoted("url_key")), F.lit(', "changes": ['), F.array_join("c.t", ", "), F.lit("]}")).alias("text"))


def findings_json(command: str, findings: DataFrame, site: Site | None = None, baseline: Site | None = None) -> Document:
    """The machine-readable report; findings say whether they are new iff they have ``is_new``. With a baseline, what differs."""
    spark = findings.sparkSession
    marked = "is_new" in findings.columns
    evidence = "named_struct(" + ", ".join(f"'{e}', {e}" for e in EVIDENCE) + ")"
    parts = "'rule_id', rule_id, 'severity', severity, 'url', url, 'message', message, 'evidence', " + evidence + (", 'new', is_new" if marked else "")
    kept = Tables(spark, "findings").write(findings, "findings")
    text = kept.select("*", F.to_json(F.expr(f"named_struct({parts})"), _KEPT).alias("text"))
    head = {"version": SCHEMA_VERSION, "tool": TOOL, "tool_version": __version__, "command": command}
    sections: list[str | Items] = [json.dumps(head, indent=2, ensure_ascii=False)[:-2] + ',\n  "findings": [', Items(text, _report_order()), f'], "summary": {_json(_summary(kept, marked))}']
    if site is not None:
        about = {"base_url": site.base_url, "public_origin": site.public_origin, "scanned_at": site.scanned_at, "schema_version": SCHEMA_VERSION, "statistics": statistics(site.state).head().asDict()}
        sections.append(f', "snapshot": {_json(about)}')
    if baseline is not None and site is not None:
        n = diffs.counts(baseline, site).head()
        of = {"base_url": baseline.base_url, "scanned_at": baseline.scanned_at, "schema_version": SCHEMA_VERSION, "tool": TOOL}
        urls = {"baseline": n["indexable_baseline"], "candidate": n["indexable_candidate"], "delta": n["delta"]}
        keys = lambda rows: Items(rows.select("url_key", F.expr(quoted("url_key")).alias("text")), ["url_key"])
        sections += [f', "diff": {{"baseline": {_json(of)}, "indexable_urls": {_json(urls)}, "lost_urls": [', keys(diffs.lost(baseline, site)), '], "gained_urls": [', keys(diffs.gained(baseline, site))]
        sections += ['], "changed_urls": [', Items(_changed(baseline, site), ["url_key"]), f'], "counts": {_json({c: n[c] for c in ("lost", "gained", "changed")})}}}']
    return Document(spark, *sections, "}")


def findings_sarif(findings: DataFrame) -> Document:
    """SARIF 2.1.0: each rule once, in the order of its first finding, and a fingerprint that is the finding key.

    Only the rules, which are as many as there are rule ids, come to the driver."""
    spark = findings.sparkSession
    kept = with_subject(Tables(spark, "findings").write(findings, "findings"))
    order = F.struct((-severity_rank(F.col("severity"))).alias("r"), "rule_id", "url", *ORDER)
    rules = []
    for r in kept.groupBy("rule_id").agg(F.min(order).alias("o"), F.min_by(F.struct("message", "severity"), order).alias("f")).orderBy("o").collect():
        meta = BY_ID.get(r["rule_id"])
        level = LEVELS[meta.severity if meta else r["f"]["severity"]]
        rules.append({"id": r["rule_id"], "name": r["rule_id"], "shortDescription": {"text": meta.description if meta else r["f"]["message"]}, "defaultConfiguration": {"level": level}})
    level = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items()) + " END"
    evidence = ", ".join(f"'{e}', {e}" for e in EVIDENCE)
    result = (
        f"to_json(named_struct('ruleId', rule_id, 'level', {level}, 'message', named_struct('text', message),"
        " 'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', url)))),"
        f" 'partialFingerprints', named_struct('{TOOL}FindingKey', to_json(array({', '.join(KEY)}))), 'properties', named_struct('ruleId', rule_id, 'severity', severity, {evidence})))"
    )
    driver = {"name": TOOL, "version": __version__, "rules": rules}
    schema = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
    head = f'{{"$schema": "{schema}", "version": "2.1.0", "runs": [{{"tool": {{"driver": {_json(driver)}}}, "results": ['
    return Document(spark, head, Items(kept.select("*", F.expr(result).alias("text")), _report_order()), "]}]}")


def snapshot_json(site: Site, scanned_at: str | None = None) -> Document:
    """The snapshot as JSON, one line for each URL, in key order. ``snapshot.read_lines`` reads it in parallel."""
    head = {"version": SCHEMA_VERSION, "tool": TOOL, "base_url": site.base_url, "public_origin": site.public_origin, "scanned_at": scanned_at or site.scanned_at}
    state = F.to_json(F.struct(*[f.name for f in URL_STATE]), _KEPT)
    rows = site.state.select("url_key", F.concat(F.expr(quoted("url_key")), F.lit(": "), state).alias("text"))
    counts = statistics(site.state).select(*STATISTICS).head().asDict()
    return Document(site.state.sparkSession, _json(head)[:-1] + ', "urls": {', Items(rows, ["url_key"]), f'}}, "statistics": {_json(counts)}}}')


# Reports for readers. Of findings only what is counted by rule comes to the driver, at most a row for each rule and severity.


def _lines(rows: DataFrame, key: str, line: str) -> Items:
    return Items(rows.select(key, F.expr(line).alias("text")), [key], commas=False)


def _compared(baseline: Site, candidate: Site, titles: tuple[str, str, str], url: dict[str, str], change: str, end: str) -> list[str | Items]:
    """Sections of lost, gained and changed URLs, those that are not empty. ``url`` and ``change`` are SQL of one line each."""
    n, out = diffs.counts(baseline, candidate).head(), []
    described = f"CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in wording.CHANGES.items())} END"
    described = f"CASE WHEN kind = 'robots_changed' THEN '{wording.ROBOTS_CHANGED}' ELSE concat({described}, ': ', coalesce(from_value, 'none'), ' → ', coalesce(to_value, 'none')) END"
    for name, rows, title in (("lost", diffs.lost(baseline, candidate), titles[0]), ("gained", diffs.gained(baseline, candidate), titles[1])):
        out += [title.format(n[name]), _lines(rows, "url_key", url[name]), end] if n[name] else []
    if n["changed"]:
        each = F.struct("seq", F.expr(f"concat('{change}', {described})").alias("t"))
        listed = diffs.changes(baseline, candidate).groupBy("url_key").agg(F.array_sort(F.collect_list(each)).alias("c"))
        out += [titles[2].format(n["changed"]), _lines(listed, "url_key", f"concat_ws('\\n', {url['changed']}, array_join(c.t, '\\n'))"), end]
    return [x for x in out if x is not None]


def _evidence(line: str) -> str:
    """SQL of the lines of a finding's evidence, each with its end."""
    return ", ".join(f"CASE WHEN {e} IS NOT NULL THEN concat('{line.format(e.capitalize() + ':')}', {e}, '\\n') ELSE '' END" for e in EVIDENCE[:3])


def _by_rule(kept: DataFrame) -> list:
    """``(severity, rule_id, n)`` in report order."""
    return kept.groupBy("severity", "rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(severity_rank(F.col("severity")).desc(), "rule_id").collect()


def findings_markdown(findings: DataFrame, site: Site, baseline: Site | None = None) -> Document:
    """The report in Markdown: numbers of the site, what differs from a baseline, findings by rule, and each finding below its rule."""
    spark = findings.sparkSession
    kept = Tables(spark, "findings").write(findings, "findings")
    sections: list[str | Items] = ["\n".join(wording.markdown_head(site.base_url, site.scanned_at, statistics(site.state).head()))]
    if baseline is not None:
        n = diffs.counts(baseline, site).head()
        sections.append("\n".join(wording.markdown_compared(n["indexable_baseline"], n["indexable_candidate"])))
        url = "concat('- `', url_key, '`')"
        sections += _compared(baseline, site, tuple(f"### {t} URLs ({{}})\n" for t in ("Lost", "Gained", "Changed")), dict.fromkeys(("lost", "gained", "changed"), url), "  - ", "")
    rules: dict[str, list] = {}
    for r in _by_rule(kept):
        rules.setdefault(r["rule_id"], []).append(r)
    if not rules:
        return Document(spark, *sections, "\n".join(wording.MARKDOWN_NONE))
    count = lambda s: sum(r["n"] for g in rules.values() for r in g if r["severity"] == s)
    numbers = [(rule, g[0]["severity"], sum(r["n"] for r in g)) for rule, g in sorted(rules.items())]
    sections.append("\n".join(wording.markdown_rules(count("error"), count("warning"), numbers)))
    heads = spark.createDataFrame([(rule, f"### {rule}\n") for rule in rules], "rule_id string, text string")
    heads = heads.select("rule_id", F.lit(0).alias("rank"), F.lit("").alias("url"), *[F.lit(0).cast(kept.schema[c].dataType).alias(c) for c in ORDER], "text")
    text = F.expr(f"concat('**', url, '** — `', upper(severity), '`\\n\\n', message, '\\n\\n', {_evidence('- **{}** ')})")
    items = kept.select("rule_id", (F.lit(100) - severity_rank(F.col("severity"))).alias("rank"), "url", *ORDER, text.alias("text"))
    return Document(spark, *sections, Items(heads.unionByName(items), ["rule_id", "rank", "url", *ORDER], commas=False))


def findings_text(findings: DataFrame, site: Site | None = None, baseline: Site | None = None) -> Document:
    """The report for a terminal: numbers, what differs from a baseline, then findings in report order under headings of rules."""
    spark = findings.sparkSession
    kept, sections = Tables(spark, "findings").write(findings, "findings"), []
    if site is not None:
        sections.append("\n".join(wording.text_head(site.base_url, statistics(site.state).head())))
    if baseline is not None:
        n = diffs.counts(baseline, site).head()
        sections.append(wording.text_compared(n["indexable_baseline"], n["indexable_candidate"]))
        url = {"lost": "concat('  - ', url_key)", "gained": "concat('  + ', url_key)", "changed": "concat('  ', url_key, ':')"}
        sections += _compared(baseline, site, tuple(f"\n{t} URLs ({{}}):" for t in ("Lost", "Gained", "Changed")), url, "    ", None)
        sections.append("")
    groups = _by_rule(kept)
    total = sum(r["n"] for r in groups)
    if total and "is_new" in kept.columns:
        sections.append(wording.text_new(kept.where("is_new").count(), total))
    if not total:
        return Document(spark, *sections, wording.NOTHING)
    heads: list[list] = []
    for r in groups:  # a rule of two severities that follow one another has one heading
        if heads and heads[-1][1] == r["rule_id"]:
            heads[-1][2] += r["n"]
        else:
            heads.append([r["severity"], r["rule_id"], r["n"]])
    rank = (F.lit(100) - severity_rank(F.col("severity"))).alias("rank")
    titles = spark.createDataFrame([(s, rule, wording.text_rule(rule, s, n)) for s, rule, n in heads], "severity string, rule_id string, text string")
    titles = titles.select(rank, "rule_id", F.lit(0).alias("below"), F.lit("").alias("url"), *[F.lit(0).cast(kept.schema[c].dataType).alias(c) for c in ORDER], "text")
    text = F.expr(f"concat('{'  URL:':<13}', url, '\\n', {_evidence('  {:<11}')}, '  ', message, '\\n')")
    items = Items(titles.unionByName(kept.select(rank, "rule_id", F.lit(1).alias("below"), "url", *ORDER, text.alias("text"))), ["rank", "rule_id", "below", "url", *ORDER], commas=False)
    count = {s: sum(r["n"] for r in groups if r["severity"] == s) for s in LEVELS}
    return Document(spark, *sections, items, wording.text_end(total, count))
