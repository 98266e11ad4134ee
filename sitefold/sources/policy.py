"""Policy files."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from sitefold.catalog import BY_ID, SEVERITIES
from sitefold.functions.urls import public_origin

#: Largest losses in percent that pass. Fixed values.
LIMITS = {"indexable": 5.0, "links": 10.0, "words": 50.0, "headings": 15.0}
_LIMIT_KEYS = {
    "max_indexable_url_loss_percent": "indexable", "max_link_loss_percent": "links", "max_word_loss_percent": "words", "max_heading_loss_percent": "headings",
}


@dataclass
class Policy:
    fail_on: list[str] = field(default_factory=lambda: ["error"])
    public_origin: str | None = None
    exclusions: list[dict] = field(default_factory=list)
    limits: dict[str, float] = field(default_factory=lambda: dict(LIMITS))


def _only(table: dict, known: set[str], where: str) -> None:
    if extra := set(table) - known:
        raise ValueError(f"unknown key in {where}: {', '.join(sorted(extra))}")


def parse(text: str) -> Policy:
    """A validated policy: known keys, known severities and rules, patterns that start with a slash or http, reasons, and
    limits of 0 to 100 percent."""
    raw = tomllib.loads(text)
    _only(raw, {"general", "exclusions", "diff"}, "policy")
    general, diff = raw.get("general", {}), raw.get("diff", {})
    _only(general, {"fail_on", "public_origin"}, "general")
    _only(diff, set(_LIMIT_KEYS), "diff")
    policy = Policy()
    if "fail_on" in general:
        policy.fail_on = [s.lower() for s in general["fail_on"]]
    if not policy.fail_on or not set(policy.fail_on) <= set(SEVERITIES):
        raise ValueError(f"fail_on needs severities of {SEVERITIES}")
    if general.get("public_origin") is not None:
        policy.public_origin = public_origin(general["public_origin"])
    for x in raw.get("exclusions", []):
        _only(x, {"rule_id", "url_pattern", "reason"}, "exclusions")
        if x.get("rule_id") not in BY_ID:
            raise ValueError(f"exclusion of an unknown rule: {x.get("rule_id")}")
        if not str(x.get("url_pattern", "")).strip().startswith(("/", "http://", "https://")):
            raise ValueError(f"exclusion pattern must start with /, http:// or https://: {x.get("url_pattern")}")
        if not str(x.get("reason", "")).strip():
            raise ValueError("an exclusion needs a reason")
        policy.exclusions.append(x)
    for key, value in diff.items():
        if not 0 <= float(value) <= 100:
            raise ValueError(f"{key} must be within 0 and 100")
        policy.limits[_LIMIT_KEYS[key]] = float(value)
    return policy


def load(path: str) -> Policy:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
