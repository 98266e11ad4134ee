"""Command line: ``scan`` a directory or site, ``diff`` two snapshots. Exit code 0, 1 if the gate fails, 2 on errors."""

from __future__ import annotations

import argparse
import os
import re
import sys
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from sitefold.functions.urls import public_origin
from sitefold.operators import diff, findings
from sitefold.operators.rules import diff_loss
from sitefold.operators.state import Site
from sitefold.sinks import documents
from sitefold.sources import crawl, policy, snapshot
from sitefold.sources.static_site import BASE_URL, scan_directory


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sitefold", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    scan.add_argument("source", help="a directory of built files, or an http(s) URL")
    scan.add_argument("--public-origin")
    scan.add_argument("--snapshot", help="write the snapshot as JSON")
    scan.add_argument("--baseline", help="a snapshot to compare with")
    scan.add_argument("--fail-on-new", action="store_true", help="only findings that the baseline lacks fail the gate")
    scan.add_argument("--max-pages", type=int, default=crawl.MAX_PAGES)
    scan.add_argument("--concurrency", type=int, default=8)
    scan.add_argument("--timeout", type=float, default=30.0)
    scan.add_argument("--crawl-delay", type=float)
    scan.add_argument("--user-agent", default="sitefold/0.1")
    scan.add_argument("--header", action="append", default=[])
    two = commands.add_parser("diff")
    two.add_argument("baseline")
    two.add_argument("candidate")
    for p in (scan, two):
        p.add_argument("--policy")
        p.add_argument("--format", choices=("json", "markdown", "sarif"))
        p.add_argument("--output", help="file of the report; needs a format")
        p.add_argument("--fail-on", help="severities, separated by commas")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("sitefold").getOrCreate()
        return _scan(args, spark) if args.command == "scan" else _diff(args, spark)
    except Exception as error:  # every failure is exit code 2: a gate must not pass on what it couldn't see
        print(f"error: {error}", file=sys.stderr)
        return 2


def _severities(args, rules: policy.Policy) -> list[str]:
    return [s.strip() for s in args.fail_on.split(",")] if args.fail_on else rules.fail_on


def _report(args, command: str, found: DataFrame, site: Site, old: Site | None) -> None:
    """Reports are streamed from what tasks wrote."""
    if args.format == "json":
        made = documents.findings_json(command, found, site, old)
    elif args.format == "sarif":
        made = documents.findings_sarif(found)
    else:
        made = (documents.findings_markdown if args.format == "markdown" else documents.findings_text)(found, site, old)
    with open(args.output, "w", encoding="utf-8") if args.output else nullcontext(sys.stdout) as out:
        made.copy_to(out)


def _check_output(args) -> None:
    if args.output and not args.format:
        raise ValueError("--output needs --format")


def _scan(args, spark: SparkSession) -> int:
    if args.concurrency <= 0 or args.timeout <= 0:
        raise ValueError("concurrency and timeout must be positive")
    if args.fail_on_new and not args.baseline:
        raise ValueError("--fail-on-new needs --baseline")
    headers = crawl.parse_headers(args.header)
    rules = policy.load(args.policy) if args.policy else policy.Policy()
    old = snapshot.read_json(spark, args.baseline) if args.baseline else None
    _check_output(args)
    origin = rules.public_origin or (public_origin(args.public_origin) if args.public_origin else None)
    if re.match(r"https?://", args.source):
        options = crawl.Options(args.source, origin, args.max_pages, args.user_agent, args.concurrency, args.crawl_delay, headers)
        site = crawl.crawl(options, crawl.over_http(options, args.timeout), spark)
    elif os.path.isdir(args.source):
        site = scan_directory(spark, args.source, origin or BASE_URL, args.user_agent)
    else:
        raise ValueError(f"neither a URL nor a directory: {args.source}")
    site.state.cache()
    if old is not None:
        diff.check_same_base(old, site)
    if args.snapshot:
        with open(args.snapshot, "w", encoding="utf-8") as f:
            documents.snapshot_json(site).copy_to(f)
    if old is None:
        found = findings.run_rules(site, exclusions=rules.exclusions)
    else:
        old = old.cached()
        found = findings.against_baseline(site, old, exclusions=rules.exclusions, extra=diff_loss(old, site, rules.limits))
    found = found.cache()
    _report(args, "scan", found, site, old)
    return int(findings.gate(found, _severities(args, rules), args.fail_on_new))


def _diff(args, spark: SparkSession) -> int:
    rules = policy.load(args.policy) if args.policy else policy.Policy()
    old, new = snapshot.read_json(spark, args.baseline), snapshot.read_json(spark, args.candidate)
    diff.check_same_base(old, new)
    _check_output(args)
    found = findings.exclude(diff_loss(old, new, rules.limits), rules.exclusions).cache()
    _report(args, "diff", found, new, old)
    return int(findings.gate(found, _severities(args, rules)))


if __name__ == "__main__":
    sys.exit(main())
