"""The fixed catalogue of rules."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    severity: str
    description: str


#: Identifiers, default severities and descriptions that reports show.
CATALOG = (
    Rule("CC-SITEMAP-INDEXABILITY-001", "error", "A URL declared in a sitemap carries an effective noindex directive."),
    Rule("CC-SITEMAP-INDEXABILITY-002", "error", "A URL declared in a sitemap is blocked by robots.txt."),
    Rule("CC-SITEMAP-INDEXABILITY-003", "warning", "A URL declared in a sitemap canonicalizes to a different URL."),
    Rule("CC-SITEMAP-INDEXABILITY-004", "error", "A URL declared in a sitemap does not return HTTP 200 or was not verified."),
    Rule("CC-SITEMAP-COVERAGE-001", "warning", "An indexable page is missing from every sitemap."),
    Rule("CC-CANONICAL-CONSISTENCY-001", "error", "The HTML canonical and the HTTP Link canonical disagree."),
    Rule("CC-CANONICAL-CONSISTENCY-003", "error", "A canonical target does not return HTTP 200 or was not verified."),
    Rule("CC-CANONICAL-CONSISTENCY-004", "error", "A canonical target returns HTTP 200 but is not indexable."),
    Rule("CC-CANONICAL-PRESENCE-001", "warning", "An indexable page declares no canonical URL."),
    Rule("CC-CANONICAL-RESOLUTION-001", "error", "A canonical chain exceeds one hop."),
    Rule("CC-CANONICAL-RESOLUTION-002", "error", "A canonical cycle was detected."),
    Rule("CC-ROBOTS-EFFECTIVE-001", "warning", "Meta robots and X-Robots-Tag directives conflict."),
    Rule("CC-HREFLANG-RECIPROCAL-001", "error", "An hreflang entry is not reciprocated by its target."),
    Rule("CC-HREFLANG-RECIPROCAL-002", "error", "An hreflang cluster lacks a self-reference."),
    Rule("CC-HREFLANG-CANONICAL-001", "error", "An hreflang target canonicalizes to a different URL."),
    Rule("CC-HREFLANG-INDEXABILITY-001", "error", "An hreflang target exists but cannot be indexed."),
    Rule("CC-LINK-TARGET-001", "error", "An internal link returns a non-200 status without a redirect target."),
    Rule("CC-LINK-TARGET-002", "warning", "An internal link passes through a redirect."),
    Rule("CC-LINK-TARGET-003", "error", "An internal link target was not verified."),
    Rule("CC-LINK-TARGET-004", "warning", "An internal link target canonicalizes elsewhere."),
    Rule("CC-REDIRECT-RESOLUTION-001", "error", "A redirect chain contains a cycle."),
    Rule("CC-ORPHAN-001", "warning", "A verified indexable page is unreachable internally."),
    Rule("CC-DIFF-LOSS-INDEXABLE", "error", "Indexable URL loss exceeds the configured policy threshold."),
    Rule("CC-DIFF-LOSS-CONTENT", "warning", "Word or heading loss exceeds the configured policy threshold."),
    Rule("CC-DIFF-LOSS-LINKS", "warning", "Internal link loss exceeds the configured policy threshold."),
)
BY_ID = {r.id: r for r in CATALOG}
SEVERITIES = ("info", "warning", "error")
SITE_WIDE = "(site-wide)"
TOOL = "sitefold"
SCHEMA_VERSION = "1.0"
#: How discovery sources are shown. Fixed values.
SOURCE_NAMES = {
    "Sitemap": "sitemap", "InternalLink": "internal link", "Canonical": "canonical", "Hreflang": "hreflang", "Redirect": "redirect", "DirectScan": "direct scan", "RobotsTxt": "robots.txt",
}


def lossy_severity(text: str) -> str:
    """A severity by its name in any case; anything else is an error."""
    return text.lower() if text.lower() in SEVERITIES else "error"
