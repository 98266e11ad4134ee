"""Rule families: branches over rows and over references that were joined with their targets, evaluated in one pass each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.catalog import SITE_WIDE, SOURCE_NAMES
from sitefold.operators.spread import dealt_join
from sitefold.operators.state import REFERENCES, Site, statistics
from sitefold.schemas import EVIDENCE, ORDER


@dataclass(frozen=True)
class Family:
    """Rules as data: branches that look at one row (``alone``), and by kind of reference such that look at a reference of a row
    and the row that it names (``met``). ``counts`` says that it asks whether any row is in a sitemap. Called with a site, it
    gives its own findings."""

    __name__: str
    alone: tuple[str, ...] = ()
    met: tuple[tuple[str, tuple[str, ...]], ...] = ()
    counts: bool = False

    def __call__(self, site: Site) -> DataFrame:
        return evaluate(site, (self,))


def _branch(when: str, ord_: int, seq: int, rule: str, severity: str, message: str, pos: str = "0", url: str = "url", key: str = "url_key", **evidence: str) -> str:
    """SQL of one finding of a row, null where ``when`` doesn't hold; evidence that isn't named is null."""
    parts = {"rule_id": f"'{rule}'", "severity": f"'{severity}'", "url": url, "message": message} | {e: f"cast({evidence.get(e, 'NULL')} AS string)" for e in EVIDENCE}
    parts |= dict(zip(ORDER, (str(ord_), key, f"cast({pos} AS int)", str(seq)), strict=True))
    return f"CASE WHEN {when} THEN named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ") END"


def _emit(rows: DataFrame, *branches: str) -> DataFrame:
    """All findings of each row: rules that look at the same rows share one scan and one join."""
    return rows.selectExpr(f"inline(array_compact(array({', '.join(branches)})))")


def _finding(rows: DataFrame, *args, **parts) -> DataFrame:
    return _emit(rows, _branch("true", *args, **parts))


def targets(site: Site) -> DataFrame:
    """What rules look at in the row that a reference names."""
    return site.state.selectExpr("url_key AS target_key", "true AS t_found", *[f"{v} AS {k}" for k, v in TARGET.items()])


#: Columns of a target, by what they are made of.
TARGET = {
    "t_url": "url", "t_status": "http_status", "t_robots": "robots_txt_status", "t_canonical": "effective_canonical", "t_noindex": "coalesce(effective_robots.noindex, false)",
    "t_redirect": "redirect_target", "t_indexable": "is_indexable", "t_hreflang": "hreflang",
}


def evaluate(site: Site, families: tuple[Family, ...], only: DataFrame | None = None) -> DataFrame:
    """Findings of all ``families``: one pass over rows, and one join of all references that they ask for with their targets.

    ``only (url_key)`` limits the rows, and the rows whose references are looked at; targets are never limited. Where the site's
    states are cached, references are counted first, and pages that very many refer to are dealt out over several tasks.
    """
    mine = lambda rows, key: rows if only is None else rows.join(only.select(F.col("url_key").alias(key)), key, "left_semi")
    parts = []
    alone = [b for f in families for b in f.alone]
    if alone:
        rows = mine(site.state, "url_key")
        if any(f.counts for f in families):
            rows = rows.join(F.broadcast(site.state.agg(F.coalesce(F.max("found_in_sitemap"), F.lit(False)).alias("some_in_sitemap"))))
        parts.append(_emit(rows, *alone))
    met = {kind: [b for f in families for k, bs in f.met if k == kind for b in bs] for kind in REFERENCES}
    kinds = tuple(kind for kind, branches in met.items() if branches)
    if kinds:
        counts, share = site.reference_counts()
        named = dealt_join(mine(site.references(kinds), "src_key"), targets(site), "target_key", counts, share, F.xxhash64("src_key", "pos"), "left")
        branches = " ".join(f"WHEN '{kind}' THEN array_compact(array({', '.join(met[kind])}))" for kind in kinds)
        parts.append(named.selectExpr(f"inline(CASE kind {branches} END)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Evidence texts are parts of the finding key and message texts are what reports show: fixed values.

_RULE, _MARK = "CC-SITEMAP-INDEXABILITY-00", {"declared": "'sitemap.xml'"}
sitemap_indexability = Family(
    "sitemap_indexability",
    (
        _branch("found_in_sitemap AND coalesce(effective_robots.noindex, false)", 0, 0, _RULE + "1", "error", "'The sitemap declares this URL for indexing, but the effective indexing directive excludes it.'", observed="'noindex'", canonical="effective_canonical", **_MARK),
        _branch("found_in_sitemap AND robots_txt_status = 'Blocked'", 0, 1, _RULE + "2", "error", "'The sitemap declares this URL for indexing, but robots.txt disallows crawling it.'", observed="'robots.txt: disallow'", **_MARK),
        _branch("found_in_sitemap AND effective_canonical <> url", 0, 2, _RULE + "3", "warning", "'The sitemap declares this URL, but it canonicalizes to a different URL. The sitemap should contain the canonical URL.'", canonical="effective_canonical", **_MARK),
        _branch("found_in_sitemap AND robots_txt_status <> 'Blocked' AND NOT coalesce(http_status = 200, false)", 0, 3, _RULE + "4", "error", "'The sitemap declares this URL, but it did not resolve to a successful page response.'", observed="coalesce(concat('HTTP ', http_status), 'not fetched or absent from static output')", canonical="effective_canonical", **_MARK),
    ),
)

_NAMES = "map(" + ",".join(f"'{k}','{v}'" for k, v in SOURCE_NAMES.items()) + ")"
#: Nothing if no row at all is in a sitemap.
sitemap_coverage = Family(
    "sitemap_coverage",
    (
        _branch(
            "some_in_sitemap AND NOT found_in_sitemap AND is_indexable AND word_count IS NOT NULL", 1, 0, "CC-SITEMAP-COVERAGE-001", "warning", "'This URL is indexable and returns HTTP 200, but no sitemap declares it. Search engines can still find it, but the sitemap no longer describes the site.'",
            declared="'no sitemap entry'", observed="'indexable HTML page'", canonical="effective_canonical", detail=f"concat('discovered via: ', array_join(transform(sources, s -> {_NAMES}[s]), ', '))",
        ),
    ),
    counts=True,
)

_RULE, _AT = "CC-CANONICAL-CONSISTENCY-00", {"url": "src_url", "key": "src_key", "canonical": "target_url"}
canonical_consistency = Family(
    "canonical_consistency",
    (_branch("html_canonical <> http_canonical", 2, 0, _RULE + "1", "error", "'The HTML canonical and HTTP Link header canonical disagree. Use a single, consistent canonical method.'", declared="concat('HTTP Link: ', http_canonical)", observed="concat('HTML canonical: ', html_canonical)"),),
    (
        (
            "canonical",
            (
                _branch("target_url <> src_url AND t_status <> 200", 2, 1, _RULE + "3", "error", "concat('The canonical target returned HTTP ', t_status, '. Canonical targets must resolve successfully.')", observed="concat('HTTP ', t_status)", **_AT),
                _branch("target_url <> src_url AND t_found AND t_status IS NULL", 2, 2, _RULE + "3", "error", "'The canonical target was discovered but not fetched, so it could not be verified.'", observed="'no response recorded'", **_AT),
                _branch("target_url <> src_url AND t_status = 200 AND NOT t_indexable", 2, 3, _RULE + "4", "error", "'The canonical target resolves successfully but is not indexable.'", observed="'canonical target is non-indexable'", **_AT),
                _branch("target_url <> src_url AND t_found IS NULL", 2, 4, _RULE + "3", "warning", "'The canonical target was not found in the scanned site. It may be unreachable or external.'", observed="'not found in scan'", **_AT),
            ),
        ),
    ),
)

canonical_presence = Family(
    "canonical_presence",
    (
        _branch(
            "is_indexable AND html_canonical IS NULL AND http_canonical IS NULL AND word_count IS NOT NULL", 3, 0, "CC-CANONICAL-PRESENCE-001", "warning", "'This page is indexable but declares no canonical URL, so duplicate variants of the same content can compete with it.'",
            declared="'no canonical'", observed="'no rel=\"canonical\" link and no Link canonical header'", detail="'indexable page without a canonical'",
        ),
    ),
)

#: Two hops decide: back to the start is a cycle, on to a third key a chain. Longer cycles are chains for each member.
_HOP = "regexp_replace(t_canonical, '(?s)#.*$', '')"
_CHAIN = f"concat_ws(' → ', src_key, target_key, {_HOP})"
_TWO = f"target_key <> src_key AND {_HOP} <> target_key AND {_HOP}"
canonical_resolution = Family(
    "canonical_resolution",
    met=(
        (
            "canonical",
            (
                _branch(f"{_TWO} <> src_key", 4, 0, "CC-CANONICAL-RESOLUTION-001", "error", f"concat('Canonical chain exceeds depth 1: ', {_CHAIN})", url="src_key", key="src_key", canonical=_CHAIN, detail="'Chain length: 2'"),
                _branch(f"{_TWO} = src_key", 4, 1, "CC-CANONICAL-RESOLUTION-002", "error", f"concat('Canonical cycle detected: ', {_CHAIN})", url="src_key", key="src_key", canonical=_CHAIN),
            ),
        ),
    ),
)


def _conflict(k: int, name: str) -> str:
    meta, http = f"html_meta_robots.{name}", f"http_x_robots_tag.{name}"
    text = f"concat('Meta robots and X-Robots-Tag disagree on {name}. Meta robots: ', {meta}, ', X-Robots-Tag: ', {http}, '. Resolve the conflict to ensure predictable indexing behavior.')"
    return _branch(f"{meta} <> {http}", 5, k, "CC-ROBOTS-EFFECTIVE-001", "warning", text, declared=f"concat('meta robots: {name}=', {meta})", observed=f"concat('X-Robots-Tag: {name}=', {http})")


robots_effective = Family("robots_effective", (_conflict(0, "noindex"), _conflict(1, "nofollow")))

_ENTRIES = "array_join(transform({0}, e -> concat(e.lang, ' → ', e.url)), ', ')"
_ENTRY = "concat('hreflang: ', lang, ' → ', target_url)"
_SAYS = "concat('This page declares hreflang ', lang, ' → ', target_url, ', but ', target_url, {})"
_AT = {"pos": "pos", "url": "src_url", "key": "src_key", "declared": _ENTRY}
#: Whether the target is found by its url, not only by its key.
_SAME = "coalesce(t_url = target_url, false)"
_AWAY = "target_url <> src_url AND "
hreflang_reciprocal = Family(
    "hreflang_reciprocal",
    (_branch("size(hreflang) > 0 AND NOT exists(hreflang, e -> e.url = url)", 6, 0, "CC-HREFLANG-RECIPROCAL-002", "error", "'This page declares hreflang entries for other pages but does not include a self-referencing hreflang entry.'", observed=f"concat('hreflang entries: ', {_ENTRIES.format('hreflang')})"),),
    (
        (
            "hreflang",
            (
                _branch(f"{_AWAY} {_SAME} AND NOT exists(t_hreflang, e -> e.url = src_url)", 6, 1, "CC-HREFLANG-RECIPROCAL-001", "error", _SAYS.format("' does not link back with a reciprocal hreflang entry.'"), observed=f"concat('target hreflang: [', {_ENTRIES.format('t_hreflang')}, ']')", **_AT),
                _branch(f"{_AWAY} NOT {_SAME}", 6, 2, "CC-HREFLANG-RECIPROCAL-001", "error", _SAYS.format("' was not found in the scan and cannot be verified for reciprocity.'"), observed="'target not found in scan'", **_AT),
            ),
        ),
    ),
)

hreflang_canonical = Family(
    "hreflang_canonical",
    met=(("hreflang", (_branch("t_canonical <> target_url", 7, 0, "CC-HREFLANG-CANONICAL-001", "error", _SAYS.format("' canonicalizes to ', t_canonical, '. Hreflang URLs should point to the canonical version.'"), observed="concat('target canonical: ', t_canonical)", canonical="t_canonical", **_AT),)),),
)

_REASON = "CASE WHEN t_robots = 'Blocked' THEN 'robots.txt disallows crawling it' WHEN t_status <> 200 THEN concat('it returns HTTP ', t_status) WHEN t_status = 200 AND t_noindex THEN 'it is marked noindex' END"
_TEXT = f"concat('This page declares hreflang ', lang, ' → ', target_url, ', but that URL cannot be indexed because ', {_REASON}, '. Hreflang annotations are ignored when the alternate is not indexable.')"
hreflang_indexability = Family(
    "hreflang_indexability",
    met=(("hreflang", (_branch(f"{_REASON} IS NOT NULL", 8, 0, "CC-HREFLANG-INDEXABILITY-001", "error", _TEXT, observed=_REASON, canonical="t_canonical", detail="concat('hreflang target returned HTTP ', t_status)", **_AT),)),),
)

_RULE, _AT = "CC-LINK-TARGET-00", {"pos": "pos", "url": "src_url", "key": "src_key"}
link_target = Family(
    "link_target",
    met=(
        (
            "link",
            (
                _branch("t_status <> 200 AND t_redirect IS NULL", 9, 0, _RULE + "1", "error", "concat('Internal link target ', target_url, ' returned HTTP ', t_status, ' without a usable redirect target.')", observed="concat('HTTP ', t_status)", detail="concat('link target: ', target_url)", **_AT),
                _branch("t_found AND t_status IS NULL", 9, 1, _RULE + "3", "error", "concat('Internal link target ', target_url, ' was not fetched, so its resolution could not be verified.')", declared="target_url", observed="'no response recorded'", **_AT),
                _branch("t_redirect IS NOT NULL", 9, 2, _RULE + "2", "warning", "concat('Internal link targets ', target_url, ' which redirects to ', t_redirect, '. Link directly to the canonical URL.')", declared="target_url", observed="concat('redirect → ', t_redirect)", canonical="t_canonical", **_AT),
                _branch("t_canonical <> target_url", 9, 3, _RULE + "4", "warning", "concat('Internal link targets ', target_url, ', but that page canonicalizes to ', t_canonical, '.')", declared="target_url", observed="'link target canonicalizes elsewhere'", canonical="t_canonical", **_AT),
            ),
        ),
    ),
)

_CHAIN = "array_join(redirect_chain, ' → ')"
redirect_resolution = Family("redirect_resolution", (_branch("size(redirect_chain) <> size(array_distinct(redirect_chain))", 10, 0, "CC-REDIRECT-RESOLUTION-001", "error", f"concat('Redirect cycle detected: ', {_CHAIN})", observed=_CHAIN),))

orphan = Family(
    "orphan",
    (
        _branch(
            "is_indexable AND http_status = 200 AND NOT is_reachable", 11, 0, "CC-ORPHAN-001", "warning", "'This URL is indexable, but it is not reachable via internal links from the scan entry point.'",
            declared="CASE WHEN found_in_sitemap THEN 'sitemap.xml' ELSE 'scanned page' END", observed="'not reachable via internal links'", canonical="effective_canonical",
        ),
    ),
)


#: Families in the order in which a run evaluates them.
FAMILIES: tuple[Family, ...] = (
    sitemap_indexability, sitemap_coverage, canonical_consistency, canonical_presence, canonical_resolution, robots_effective,
    hreflang_reciprocal, hreflang_canonical, hreflang_indexability, link_target, redirect_resolution, orphan,
)


def loss_rows(baseline: Site, candidate: Site) -> DataFrame:
    """``(url_key, what, was, now, loss_pct)`` for pages of both sites; the loss is (was - now) / was * 100 in doubles."""
    columns = ["word_count AS words", "heading_count AS headings", "cast(size(internal_links_out) AS bigint) AS links"]
    both = baseline.state.selectExpr("url_key", *columns).join(candidate.state.selectExpr("url_key", *[c.replace(" AS ", " AS c_") if "cast" not in c else "cast(size(internal_links_out) AS bigint) AS c_links" for c in columns]), "url_key")
    long = both.selectExpr("url_key", "stack(3, 'words', words, c_words, 'headings', headings, c_headings, 'links', links, c_links) AS (what, was, now)").where("was > 0 AND now IS NOT NULL")
    return long.withColumn("loss_pct", F.expr("(cast(was AS double) - cast(now AS double)) / cast(was AS double) * 100D"))


def diff_loss(baseline: Site, candidate: Site, limits: dict[str, float]) -> DataFrame:
    """Losses beyond the limits ``indexable``, ``words``, ``headings`` and ``links``, in percent."""
    shown = lambda x: "concat(format_string('%.1f', {0}), '% loss')".format(x)
    counts = statistics(baseline.state).selectExpr("indexable_urls AS was").join(statistics(candidate.state).selectExpr("indexable_urls AS now")).where("was > 0")
    counts = counts.withColumn("loss_pct", F.expr("(cast(was AS double) - cast(now AS double)) / cast(was AS double) * 100D")).where(F.col("loss_pct") > float(limits["indexable"]))
    text = f"concat('Indexable URL count decreased by ', format_string('%.1f', loss_pct), '% (baseline: ', was, ', candidate: ', now, ', threshold: {limits['indexable']:g}%). This may indicate a deployment error.')"
    parts = [_finding(counts, 12, 0, "CC-DIFF-LOSS-INDEXABLE", "error", text, url=f"'{SITE_WIDE}'", key="''", declared="concat('baseline indexable: ', was)", observed="concat('candidate indexable: ', now)", detail=shown("loss_pct"))]
    lost = baseline.state.where("is_indexable").join(candidate.state.select("url_key"), "url_key", "left_anti")
    parts.append(_finding(lost, 12, 1, "CC-DIFF-LOSS-INDEXABLE", "error", "'An indexable URL from the baseline is missing in the candidate.'", url="url_key", declared="'present in baseline'", observed="'missing in candidate'"))
    branches = []
    for seq, (what, noun, rule) in enumerate((("words", "Word", "CONTENT"), ("headings", "Heading", "CONTENT"), ("links", "Internal link", "LINKS"))):
        text = f"concat('{noun} count decreased by ', format_string('%.1f', loss_pct), '% (baseline: ', was, ', candidate: ', now, ').')"
        over = f"what = '{what}' AND loss_pct > {float(limits[what])!r}D"
        branches.append(_branch(over, 12, 2 + seq, f"CC-DIFF-LOSS-{rule}", "warning", text, url="url_key", declared=f"concat('baseline {what}: ', was)", observed=f"concat('candidate {what}: ', now)", detail=shown("loss_pct")))
    return parts[0].unionByName(parts[1]).unionByName(_emit(loss_rows(baseline, candidate), *branches))
