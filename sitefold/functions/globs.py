"""Path globs of exclusions."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str:
    """``**`` is any run and swallows one slash after it, ``*`` any run without a slash, ``?`` any one character."""
    out, k = [], 0
    while k < len(pattern):
        if pattern.startswith("**", k):
            out.append(".*")
            k += 3 if pattern.startswith("/", k + 2) else 2
        elif pattern[k] == "*":
            out.append("[^/]*")
            k += 1
        else:
            out.append("." if pattern[k] == "?" else re.escape(pattern[k]))
            k += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(pattern: str, text: str) -> bool:
    return re.match(glob_regex(pattern), text) is not None
