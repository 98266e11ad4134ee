"""Signals of HTML pages: canonical, robots, hreflang, links, words and headings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions.robots import directive_sql, merge_all
from sitefold.functions.urls import drop_fragment, resolve
from sitefold.schemas import SIGNALS
from sitefold.sources.html_tree import HEADINGS, Reader

_RAW_PREFIXES = ("#", "javascript:", "mailto:", "tel:")


def _origin(url: str) -> str:
    scheme, _, rest = url.partition("://")
    return f"{scheme}://{rest.split('/', 1)[0].split('?', 1)[0].split('#', 1)[0]}"


def signals(html: str, url: str, alias: str | None = None) -> tuple:
    """The fields of SIGNALS for one page. ``alias`` is a crawl origin whose links and canonicals count as the page's own."""
    page = Reader(html)
    having = lambda tag, *names: [a for name, a in page.elements if name == tag and all(n in a for n in names)]
    home = _origin(url)

    def own(target: str | None) -> str | None:
        return home + target[len(alias) :] if target and alias and _origin(target) == alias else target

    canonical, hreflang = None, []
    for a in having("link", "rel", "href"):
        rel = a["rel"].lower().split()
        target = own(drop_fragment(resolve(url, a["href"])))
        if target is None:
            continue
        if canonical is None and "canonical" in rel:
            canonical = target
        if "alternate" in rel and "hreflang" in a:
            hreflang.append({"lang": a["hreflang"], "url": target})
    links = set()
    for a in having("a", "href"):
        href = a["href"]
        if not href.startswith(_RAW_PREFIXES):
            target = own(drop_fragment(resolve(url, href)))
            if target and _origin(target) == home:
                links.add(target)
    robots = [a["content"] for a in having("meta", "name", "content") if a["name"].lower() == "robots"]
    return canonical, robots, hreflang, sorted(links), page.words, sum(name in HEADINGS for name, _ in page.elements)


@F.pandas_udf(SIGNALS)
def page_signals(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    """SIGNALS of each page; all null where the html is null."""
    rows = [signals(h, u) if h is not None and u is not None else (None,) * 6 for h, u in zip(html, url, strict=True)]
    return pd.DataFrame(rows, columns=SIGNALS.names)


def signals_with_alias(alias: str):
    @F.pandas_udf(SIGNALS)
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [signals(h, u, alias) if h is not None and u is not None else (None,) * 6 for h, u in zip(html, url, strict=True)]
        return pd.DataFrame(rows, columns=SIGNALS.names)

    return run


def with_meta_robots(frame: DataFrame, contents: str, name: str) -> DataFrame:
    """Adds column ``name`` with the merge of the directives in array column ``contents``; null if it knows none."""
    listed = frame.withColumn("_directives", F.expr(f"transform({contents}, c -> {directive_sql('c')})"))
    return listed.withColumn(name, merge_all("_directives")).drop("_directives")
