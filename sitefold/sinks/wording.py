"""Words and layout of the reports for readers, used by those of lists and those that tasks render."""

from __future__ import annotations

NOTHING = "Nothing to report: all signals agree."
MARKDOWN_NONE = ("## Findings", "", NOTHING, "")
CHANGES = {"canonical_changed": "canonical", "index_changed": "indexable", "word_count_changed": "words", "link_count_changed": "links"}
ROBOTS_CHANGED = "robots directive changed"
_NUMBERS = ("Total URLs", "Indexable", "Non-indexable", "Orphaned", "In sitemap", "From links", "Redirects", "Broken (≥400)")
_SHOWN = (("Total URLs", "total_urls"), ("Indexable", "indexable_urls"), ("Non-indexable", "non_indexable_urls"), ("Orphaned", "orphan_urls"), ("In sitemap", "sitemap_urls"), ("Broken (≥400)", "broken_urls"))


def shown_time(scanned_at: str | None) -> str:
    return scanned_at.replace("T", " ").partition(".")[0].rstrip("Z") + " UTC" if scanned_at else "unknown"


def markdown_head(base_url: str, scanned_at: str | None, n) -> list[str]:
    out = ["# Site signal report", "", f"**Base URL:** {base_url}", f"**Scanned:** {shown_time(scanned_at)}", "", "## The site in numbers", "", "| What | URLs |", "|---|---|"]
    return out + [f"| {name} | {n[column]} |" for name, column in _SHOWN] + [""]


def markdown_compared(b: int, c: int) -> list[str]:
    return ["## Against the baseline", "", f"Indexable URLs: **{b} → {c}** ({c - b:+})", ""]


def markdown_rules(errors: int, warnings: int, rules: list[tuple[str, str, int]]) -> list[str]:
    out = ["## Findings by rule", "", f"**{errors} errors, {warnings} warnings** across {len(rules)} rules", "", "| Rule | Level | Findings |", "|---|---|---|"]
    return out + [f"| `{rule}` | {severity} | {n} |" for rule, severity, n in rules] + ["", "## Each finding", ""]


def text_head(base_url: str, n) -> list[str]:
    out = ["The site in numbers", "─" * 40, f"  {'Base URL:':<17}{base_url}"]
    return out + [f"  {name + ':':<17}{v}" for name, v in zip(_NUMBERS, n, strict=True)] + [""]


def text_compared(b: int, c: int) -> str:
    return f"Indexable URLs: {b} → {c}"


def text_new(new: int, total: int) -> str:
    return f"{new} of {total} findings are new against the baseline.\n"


def text_rule(rule: str, severity: str, n: int) -> str:
    return f"{rule}  {severity.upper()}  ({n} finding{'s' * (n != 1)})\n{'─' * 60}"


def text_end(total: int, by_severity: dict[str, int]) -> str:
    counts = [f"{n} {s}(s)" for s, n in by_severity.items() if n]
    return f"{'═' * 60}\n{total} finding{'s' * (total != 1)}: {' '.join(counts)}"
