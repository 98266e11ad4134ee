"""Robots directives and robots.txt patterns as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of max-image-preview, most restrictive first; other values rank last. Fixed values.
IMAGE_PREVIEW = ("none", "standard", "large")
_BOOLS = ("noindex", "nofollow", "noarchive", "nosnippet")


def parse_directive(value: str) -> Column:
    return F.expr(directive_sql(value))


def directive_sql(value: str) -> str:
    """SQL of the directive struct of a header or meta value, given as SQL text; fields that it doesn't set are null.

    Tokens are lower-cased and split at commas. ``none`` sets noindex and nofollow; ``index``, ``follow`` and ``all`` set
    false only where nothing sets true. Of several limits the most restrictive holds, of several previews and dates the
    last. Tokens that are unknown or have no number are ignored.
    """
    tokens = f"transform(split(lower({value}), ','), t -> trim(BOTH ' \\t\\r\\n' FROM t))"

    def flag(on: tuple[str, ...], off: tuple[str, ...]) -> str:
        said = " OR ".join(f"array_contains({tokens}, '{t}')" for t in on)
        unsaid = " OR ".join(f"array_contains({tokens}, '{t}')" for t in off)
        return f"CASE WHEN {said} THEN true" + (f" WHEN {unsaid} THEN false" if off else "") + " END"

    def limit(name: str) -> str:
        numbers = f"filter(transform({tokens}, t -> CASE WHEN startswith(t, '{name}:') THEN try_cast(trim(substring(t, {len(name) + 2})) AS bigint) END), n -> n IS NOT NULL)"
        return f"aggregate({numbers}, cast(NULL AS bigint), (a, n) -> CASE WHEN a IS NULL OR a < 0 THEN n WHEN n < 0 THEN a ELSE least(a, n) END)"

    def last(name: str) -> str:
        return f"try_element_at(transform(filter({tokens}, t -> startswith(t, '{name}:')), t -> trim(substring(t, {len(name) + 2}))), -1)"

    return (
        "named_struct("
        f"'noindex', {flag(('noindex', 'none'), ('index', 'all'))}, 'nofollow', {flag(('nofollow', 'none'), ('follow', 'all'))},"
        f"'noarchive', {flag(('noarchive',), ())}, 'nosnippet', {flag(('nosnippet',), ())},"
        f"'max_snippet', {limit('max-snippet')}, 'max_image_preview', {last('max-image-preview')},"
        f"'max_video_preview', {limit('max-video-preview')}, 'unavailable_after', {last('unavailable_after')})"
    )


def is_set(robots: str) -> str:
    return " OR ".join(f"{robots}.{c} IS NOT NULL" for c in (*_BOOLS, "max_snippet", "max_image_preview", "max_video_preview", "unavailable_after"))


def merge(a: str, b: str) -> str:
    """SQL of the merge of two structs, either of which may be null: flags OR, limits the smaller with negative for
    unlimited, the more restrictive preview, the right date."""
    bools = ",".join(f"'{c}', coalesce({a}.{c} OR {b}.{c}, {a}.{c}, {b}.{c})" for c in _BOOLS)
    limit = lambda c: (
        f"CASE WHEN {a}.{c} IS NULL THEN {b}.{c} WHEN {b}.{c} IS NULL THEN {a}.{c} WHEN {a}.{c} < 0 THEN {b}.{c} WHEN {b}.{c} < 0 THEN {a}.{c} ELSE least({a}.{c}, {b}.{c}) END"
    )
    rank = lambda x: "CASE " + " ".join(f"WHEN lower({x}) = '{v}' THEN {k}" for k, v in enumerate(IMAGE_PREVIEW)) + f" ELSE {len(IMAGE_PREVIEW)} END"
    pa, pb = f"{a}.max_image_preview", f"{b}.max_image_preview"
    preview = f"CASE WHEN {pa} IS NULL THEN {pb} WHEN {pb} IS NULL THEN {pa} WHEN {rank(pb)} < {rank(pa)} THEN {pb} ELSE {pa} END"
    return (
        f"named_struct({bools}, 'max_snippet', {limit('max_snippet')}, 'max_image_preview', {preview}, 'max_video_preview', {limit('max_video_preview')},"
        f"'unavailable_after', coalesce({b}.unavailable_after, {a}.unavailable_after))"
    )


def merge_all(values: str) -> Column:
    """The merge of an array of structs in order, without the unset ones; null where none is left."""
    return F.expr(f"aggregate(filter({values}, r -> {is_set('r')}), try_element_at(filter({values}, r -> {is_set('r')}), 1), (a, b) -> {merge('a', 'b')})")


def pattern_regex(pattern: str) -> str:
    """A robots.txt path pattern as an anchored regular expression: ``*`` is any run, a final ``$`` the end."""
    end = pattern.endswith("$")
    body = pattern[:-1] if end else pattern
    return "(?s)^" + ".*".join(re.escape(x) for x in body.split("*")) + ("$" if end else "")


def specificity(pattern: str) -> int:
    """Bytes of a pattern without its stars and final dollar signs."""
    return len(pattern.rstrip("$").replace("*", "").encode())
