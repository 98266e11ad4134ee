"""The queries as DuckDB SQL, written apart from the DataFrame code; only the synthetic site's definition is shared."""

from __future__ import annotations

import re

from sitefold.plans import cases
from sitefold.plans.synthetic import HOME, HREFLANG, LINKS, PAGES

_SITE = f"""
pages0 AS ({PAGES}), links0 AS ({LINKS}), lang0 AS ({HREFLANG}),
st AS (SELECT k, url, http_status, redirect_target, html_canonical, http_canonical, coalesce(html_canonical, http_canonical) AS canonical, meta_noindex, http_noindex,
 coalesce(meta_noindex OR http_noindex, meta_noindex, http_noindex, false) AS noindex, blocked, in_sitemap, word_count, heading_count FROM pages0),
state AS (SELECT *, (NOT noindex AND NOT blocked AND coalesce(http_status = 200, false) AND coalesce(canonical = url, true)) AS indexable FROM st),
links AS (SELECT src, link_url, row_number() OVER (PARTITION BY src ORDER BY link_url) - 1 AS pos FROM links0 WHERE src IN (SELECT url FROM state)),
lang AS (SELECT * FROM lang0 WHERE src IN (SELECT url FROM state))"""
_REACH = f"""
edge AS (SELECT l.src, l.link_url AS dst FROM links l WHERE link_url IN (SELECT url FROM state) UNION SELECT url, redirect_target FROM state WHERE redirect_target IN (SELECT url FROM state)),
reach AS (SELECT url FROM state WHERE url = '{HOME}' UNION SELECT e.dst FROM edge e JOIN reach r ON e.src = r.url)"""


def _reach_of(prefix: str, state: str, links: str) -> str:
    """The same walk over other tables, under other names."""
    text = _REACH
    for name, new in (("edge", f"{prefix}_edge"), ("reach", f"{prefix}_reach"), ("state", state), ("links", links)):
        text = re.sub(rf"\b{name}\b", new, text)
    return text


def _with(body: str, reach: bool = False) -> str:
    return f"WITH RECURSIVE {_SITE}{',' + _REACH if reach else ''} {body}"


def _rule(rule: str, severity: str, source: str, url: str = "url", declared: str = "NULL", observed: str = "NULL", canonical: str = "NULL", detail: str = "NULL", at: tuple = (0, 0), key: str = "", pos: str = "0") -> str:
    """One branch of a rule; ``at`` is the place of its family and of the branch in it."""
    texts = ", ".join(f"CAST({v} AS varchar) AS {k}" for k, v in (("declared", declared), ("observed", observed), ("canonical", canonical), ("detail", detail)))
    return f"SELECT 'CC-{rule}' AS rule_id, '{severity}' AS severity, {url} AS url, {texts}, {at[0]} AS rule_ord, {key or url} AS src_key, CAST({pos} AS integer) AS pos, {at[1]} AS seq FROM {source}"


_AWAY = "(SELECT s.url, s.canonical, t.url AS t_url, t.http_status AS t_status, t.indexable AS t_ok FROM state s LEFT JOIN state t ON t.url = s.canonical WHERE s.canonical <> s.url) x"
_WALK = "(SELECT a.url, b.url AS c1, b.canonical AS c2, a.url || ' → ' || b.url || ' → ' || b.canonical AS chain FROM state a JOIN state b ON a.canonical = b.url WHERE a.canonical <> a.url AND b.canonical <> b.url) x"
_LANG = "(SELECT h.*, t.http_status AS t_status, t.canonical AS t_canonical, t.blocked AS t_blocked, t.noindex AS t_noindex FROM lang h JOIN state t ON t.url = h.target) x"
_LINK = "(SELECT l.*, t.http_status AS t_status, t.canonical AS t_canonical, t.redirect_target AS t_redirect FROM links l JOIN state t ON t.url = l.link_url) x"
_ENTRIES = "(SELECT string_agg(lang || ' → ' || target, ', ' ORDER BY pos) FROM lang q WHERE q.src = {0})"
_REASON = "CASE WHEN t_blocked THEN 'robots.txt disallows crawling it' WHEN t_status <> 200 THEN 'it returns HTTP ' || t_status WHEN t_status = 200 AND t_noindex THEN 'it is marked noindex' END"
_ENTRY = "'hreflang: ' || lang || ' → ' || target"
_L = {"key": "src", "url": "src", "pos": "pos"}

_BRANCHES = [
    _rule("SITEMAP-INDEXABILITY-001", "error", "state WHERE in_sitemap AND noindex", declared="'sitemap.xml'", observed="'noindex'", canonical="canonical", at=(0, 0)),
    _rule("SITEMAP-INDEXABILITY-002", "error", "state WHERE in_sitemap AND blocked", declared="'sitemap.xml'", observed="'robots.txt: disallow'", at=(0, 1)),
    _rule("SITEMAP-INDEXABILITY-003", "warning", "state WHERE in_sitemap AND canonical <> url", declared="'sitemap.xml'", canonical="canonical", at=(0, 2)),
    _rule("SITEMAP-INDEXABILITY-004", "error", "state WHERE in_sitemap AND NOT blocked AND http_status IS DISTINCT FROM 200", declared="'sitemap.xml'", observed="CASE WHEN http_status IS NULL THEN 'not fetched or absent from static output' ELSE 'HTTP ' || http_status END", canonical="canonical", at=(0, 3)),
    _rule("SITEMAP-COVERAGE-001", "warning", "state WHERE NOT in_sitemap AND indexable AND word_count IS NOT NULL AND EXISTS (SELECT 1 FROM state WHERE in_sitemap)", declared="'no sitemap entry'", observed="'indexable HTML page'", canonical="canonical", detail="'discovered via: internal link'", at=(1, 0)),
    _rule("CANONICAL-CONSISTENCY-001", "error", "state WHERE html_canonical <> http_canonical", declared="'HTTP Link: ' || http_canonical", observed="'HTML canonical: ' || html_canonical", at=(2, 0)),
    _rule("CANONICAL-CONSISTENCY-003", "error", f"{_AWAY} WHERE t_status <> 200", observed="'HTTP ' || t_status", canonical="canonical", at=(2, 1)),
    _rule("CANONICAL-CONSISTENCY-003", "error", f"{_AWAY} WHERE t_url IS NOT NULL AND t_status IS NULL", observed="'no response recorded'", canonical="canonical", at=(2, 2)),
    _rule("CANONICAL-CONSISTENCY-004", "error", f"{_AWAY} WHERE t_status = 200 AND NOT t_ok", observed="'canonical target is non-indexable'", canonical="canonical", at=(2, 3)),
    _rule("CANONICAL-CONSISTENCY-003", "warning", f"{_AWAY} WHERE t_url IS NULL", observed="'not found in scan'", canonical="canonical", at=(2, 4)),
    _rule("CANONICAL-PRESENCE-001", "warning", "state WHERE indexable AND canonical IS NULL AND word_count IS NOT NULL", declared="'no canonical'", observed="'no rel=\"canonical\" link and no Link canonical header'", detail="'indexable page without a canonical'", at=(3, 0)),
    _rule("CANONICAL-RESOLUTION-001", "error", f"{_WALK} WHERE c2 <> url", canonical="chain", detail="'Chain length: 2'", at=(4, 0)),
    _rule("CANONICAL-RESOLUTION-002", "error", f"{_WALK} WHERE c2 = url", canonical="chain", at=(4, 1)),
    _rule("ROBOTS-EFFECTIVE-001", "warning", "state WHERE meta_noindex <> http_noindex", declared="'meta robots: noindex=' || CAST(meta_noindex AS varchar)", observed="'X-Robots-Tag: noindex=' || CAST(http_noindex AS varchar)", at=(5, 0)),
    _rule("HREFLANG-RECIPROCAL-002", "error", "state s WHERE EXISTS (SELECT 1 FROM lang h WHERE h.src = s.url) AND NOT EXISTS (SELECT 1 FROM lang h WHERE h.src = s.url AND h.target = s.url)", observed=f"'hreflang entries: ' || {_ENTRIES.format('s.url')}", at=(6, 0)),
    _rule("HREFLANG-RECIPROCAL-001", "error", "lang h WHERE target <> src AND target IN (SELECT url FROM state) AND NOT EXISTS (SELECT 1 FROM lang b WHERE b.src = h.target AND b.target = h.src)", declared=_ENTRY, observed=f"'target hreflang: [' || coalesce({_ENTRIES.format('h.target')}, '') || ']'", at=(6, 1), **_L),
    _rule("HREFLANG-RECIPROCAL-001", "error", "lang h WHERE target <> src AND target NOT IN (SELECT url FROM state)", declared=_ENTRY, observed="'target not found in scan'", at=(6, 2), **_L),
    _rule("HREFLANG-CANONICAL-001", "error", f"{_LANG} WHERE t_canonical <> target", declared=_ENTRY, observed="'target canonical: ' || t_canonical", canonical="t_canonical", at=(7, 0), **_L),
    _rule("HREFLANG-INDEXABILITY-001", "error", f"{_LANG} WHERE {_REASON} IS NOT NULL", declared=_ENTRY, observed=_REASON, canonical="t_canonical", detail="'hreflang target returned HTTP ' || t_status", at=(8, 0), **_L),
    _rule("LINK-TARGET-001", "error", f"{_LINK} WHERE t_status <> 200 AND t_redirect IS NULL", observed="'HTTP ' || t_status", detail="'link target: ' || link_url", at=(9, 0), **_L),
    _rule("LINK-TARGET-003", "error", f"{_LINK} WHERE t_status IS NULL", declared="link_url", observed="'no response recorded'", at=(9, 1), **_L),
    _rule("LINK-TARGET-002", "warning", f"{_LINK} WHERE t_redirect IS NOT NULL", declared="link_url", observed="'redirect → ' || t_redirect", canonical="t_canonical", at=(9, 2), **_L),
    _rule("LINK-TARGET-004", "warning", f"{_LINK} WHERE t_canonical <> link_url", declared="link_url", observed="'link target canonicalizes elsewhere'", canonical="t_canonical", at=(9, 3), **_L),
    _rule("REDIRECT-RESOLUTION-001", "error", "state WHERE redirect_target IS NOT NULL AND k % 74 = 0", observed="url || ' → ' || redirect_target || ' → ' || url", at=(10, 0)),
    _rule("ORPHAN-001", "warning", "state WHERE indexable AND http_status = 200 AND url NOT IN (SELECT url FROM reach)", declared="CASE WHEN in_sitemap THEN 'sitemap.xml' ELSE 'scanned page' END", observed="'not reachable via internal links'", canonical="canonical", at=(11, 0)),
]
_SHOWN = "rule_id, severity, url, declared, observed, canonical, detail"
_ALL = " UNION ALL ".join(_BRANCHES)

ORACLE_SQL: dict[str, str] = {}
for _id in sorted({b.split("'")[1] for b in _BRANCHES}):
    _name = "rule_" + _id.removeprefix("CC-").lower().replace("-", "_")
    ORACLE_SQL[_name] = _with(f"SELECT {_SHOWN} FROM ({' UNION ALL '.join(b for b in _BRANCHES if _id in b)}) f", reach="ORPHAN" in _id)

ORACLE_SQL["findings_all_sorted"] = _with(f"SELECT {_SHOWN}, rule_ord, src_key, pos, seq FROM ({_ALL}) f", True)
ORACLE_SQL["findings_keys"] = _with(f"SELECT rule_id, url, severity, coalesce(declared, canonical, detail) AS subject, rule_ord, pos, seq FROM ({_ALL}) f", True)
ORACLE_SQL["findings_by_severity"] = _with(f"SELECT severity, count(*) AS n FROM ({_ALL}) f GROUP BY 1", True)
ORACLE_SQL["findings_by_rule"] = _with(f"SELECT rule_id, count(*) AS n, CASE WHEN bool_or(severity = 'error') THEN 'error' ELSE 'warning' END AS severity FROM ({_ALL}) f GROUP BY 1", True)
ORACLE_SQL["findings_catalog_join"] = _with(
    f"""SELECT rule_id, CASE WHEN rule_id LIKE '%INDEXABILITY-003' OR rule_id LIKE '%COVERAGE%' OR rule_id LIKE '%PRESENCE%' OR rule_id LIKE 'CC-ROBOTS%' OR rule_id IN ('CC-LINK-TARGET-002', 'CC-LINK-TARGET-004', 'CC-ORPHAN-001')
    THEN 'warning' ELSE 'error' END AS default_severity, severity, count(*) AS n FROM ({_ALL}) f GROUP BY ALL""", True)  # fmt: skip
ORACLE_SQL["findings_excluded"] = _with(
    f"""SELECT rule_id, count(*) AS n FROM ({_ALL}) f WHERE NOT (rule_id = 'CC-ORPHAN-001' AND regexp_matches(url, '^https://site.test/p/1[^/]*$'))
    AND NOT (rule_id = 'CC-LINK-TARGET-004' AND url LIKE 'https://site.test/s/%') AND NOT (rule_id = 'CC-SITEMAP-INDEXABILITY-003' AND url LIKE 'https://site.test/p/_5') GROUP BY 1""", True)  # fmt: skip

ORACLE_SQL["state_derived"] = _with("SELECT url AS url_key, canonical AS effective_canonical, noindex, indexable AS is_indexable, CASE WHEN blocked THEN 'Blocked' ELSE 'NoRule' END AS robots_txt_status, (SELECT count(*) FROM links l WHERE l.src = state.url) AS n_links FROM state")
ORACLE_SQL["state_statistics"] = _with(
    """SELECT count(*) AS total_urls, count(*) FILTER (indexable) AS indexable_urls, count(*) FILTER (NOT indexable) AS non_indexable_urls, count(*) FILTER (indexable AND url NOT IN (SELECT url FROM reach)) AS orphan_urls,
    count(*) FILTER (in_sitemap) AS sitemap_urls, count(*) FILTER (NOT in_sitemap) AS internal_link_urls, count(redirect_target) AS redirect_urls, count(*) FILTER (http_status >= 400) AS broken_urls FROM state""", True)  # fmt: skip
ORACLE_SQL["reach_urls"] = _with("SELECT url AS url_key FROM reach", True)
ORACLE_SQL["state_sources_fold"] = _with(
    """SELECT url AS url_key, url, string_agg(source, ',' ORDER BY prio) AS sources FROM (SELECT DISTINCT url, 'Sitemap' AS source, 0 AS prio FROM state WHERE in_sitemap
    UNION SELECT link_url, 'InternalLink', 1 FROM links UNION SELECT target, 'Hreflang', 2 FROM lang) f GROUP BY url""")  # fmt: skip

_PAIR = f"""{_SITE},
b AS (SELECT *, (SELECT count(*) FROM links l WHERE l.src = state.url) AS n_links FROM state WHERE k % 67 <> 1),
c0 AS (SELECT * REPLACE (CASE WHEN k % 83 <> 1 THEN canonical END AS canonical, CASE WHEN k % 9 = 0 THEN word_count // 4 ELSE word_count END AS word_count, CASE WHEN k % 8 = 0 THEN greatest(heading_count - 2, 0) ELSE heading_count END AS heading_count),
 (SELECT count(*) FROM links l WHERE l.src = state.url) AS all_links FROM state WHERE k % 71 <> 1),
c AS (SELECT *, CASE WHEN k % 10 = 3 AND url LIKE '%/s/%' THEN all_links // 2 ELSE all_links END AS n_links, (NOT noindex AND NOT blocked AND coalesce(http_status = 200, false) AND coalesce(canonical = url, true)) AS ok FROM c0),
loss AS (SELECT b.url AS url_key, 'words' AS what, b.word_count AS was, c.word_count AS now FROM b JOIN c USING (url) UNION ALL SELECT b.url, 'headings', b.heading_count, c.heading_count FROM b JOIN c USING (url)
 UNION ALL SELECT b.url, 'links', b.n_links, c.n_links FROM b JOIN c USING (url)),
pct AS (SELECT *, (CAST(was AS double) - CAST(now AS double)) / CAST(was AS double) * CAST(100 AS double) AS loss_pct FROM loss WHERE was > 0 AND now IS NOT NULL)"""
_P = lambda body: f"WITH RECURSIVE {_PAIR} {body}"
ORACLE_SQL["diff_loss_percent"] = _P("SELECT url_key, what, was, now, loss_pct FROM pct")
ORACLE_SQL["rule_diff_loss_pages"] = _P(
    """SELECT 'CC-DIFF-LOSS-INDEXABLE' AS rule_id, 'error' AS severity, url, 'present in baseline' AS declared, 'missing in candidate' AS observed FROM b WHERE indexable AND url NOT IN (SELECT url FROM c)
    UNION ALL SELECT CASE what WHEN 'links' THEN 'CC-DIFF-LOSS-LINKS' ELSE 'CC-DIFF-LOSS-CONTENT' END, 'warning', url_key, 'baseline ' || what || ': ' || was, 'candidate ' || what || ': ' || now FROM pct
    WHERE loss_pct > CASE what WHEN 'words' THEN 50 WHEN 'headings' THEN 15 ELSE 10 END""")  # fmt: skip
ORACLE_SQL["rule_diff_loss_site"] = _P(
    """SELECT 'CC-DIFF-LOSS-INDEXABLE' AS rule_id, 'error' AS severity, '(site-wide)' AS url, 'baseline indexable: ' || was AS declared, 'candidate indexable: ' || now AS observed
    FROM (SELECT (SELECT count(*) FROM b WHERE indexable) AS was, (SELECT count(*) FROM c WHERE ok) AS now) x WHERE was > 0 AND (CAST(was AS double) - now) / was * 100 > -100""")  # fmt: skip
ORACLE_SQL["diff_lost"] = _P("SELECT url AS url_key FROM b WHERE url NOT IN (SELECT url FROM c)")
ORACLE_SQL["diff_gained"] = _P("SELECT url AS url_key FROM c WHERE url NOT IN (SELECT url FROM b)")
_CHANGES = """(SELECT url AS url_key, 0 AS seq, 'canonical_changed' AS kind, b.canonical AS from_value, c.canonical AS to_value FROM b JOIN c USING (url) WHERE b.canonical IS DISTINCT FROM c.canonical
 UNION ALL SELECT url, 1, 'index_changed', CAST(b.indexable AS varchar), CAST(c.ok AS varchar) FROM b JOIN c USING (url) WHERE b.indexable <> c.ok
 UNION ALL SELECT url, 3, 'word_count_changed', CAST(b.word_count AS varchar), CAST(c.word_count AS varchar) FROM b JOIN c USING (url) WHERE b.word_count IS DISTINCT FROM c.word_count
 UNION ALL SELECT url, 4, 'link_count_changed', CAST(b.n_links AS varchar), CAST(c.n_links AS varchar) FROM b JOIN c USING (url) WHERE b.n_links <> c.n_links) d"""
ORACLE_SQL["diff_changed_long"] = _P(f"SELECT * FROM {_CHANGES}")
ORACLE_SQL["diff_counts"] = _P(
    f"""SELECT (SELECT count(*) FROM b WHERE indexable) AS indexable_baseline, (SELECT count(*) FROM c WHERE ok) AS indexable_candidate, (SELECT count(*) FROM c WHERE ok) - (SELECT count(*) FROM b WHERE indexable) AS delta,
    (SELECT count(*) FROM b WHERE url NOT IN (SELECT url FROM c)) AS lost, (SELECT count(*) FROM c WHERE url NOT IN (SELECT url FROM b)) AS gained, (SELECT count(DISTINCT url_key) FROM {_CHANGES}) AS changed""")  # fmt: skip


def _values(rows, columns: str) -> str:
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(VALUES {','.join('(' + ','.join(map(quote, r)) + ')' for r in rows)}) AS t({columns})"


_TOKENS = "list_transform(string_split(lower(value), ','), lambda t: trim(t))"
_HAS = lambda *names: "(" + " OR ".join(f"list_contains(tok, '{n}')" for n in names) + ")"
_NUM = lambda p: f"list_filter(list_transform(list_filter(tok, lambda t: starts_with(t, '{p}:')), lambda t: TRY_CAST(trim(t[{len(p) + 2}:]) AS bigint)), lambda n: n IS NOT NULL)"
_LIMIT = lambda p: f"coalesce(list_min(list_filter({_NUM(p)}, lambda n: n >= 0)), list_min({_NUM(p)}))"
_LAST = lambda p: f"list_last(list_transform(list_filter(tok, lambda t: starts_with(t, '{p}:')), lambda t: trim(t[{len(p) + 2}:])))"
_PARSED_OF = f"""SELECT p_partkey, value, CASE WHEN {_HAS('noindex', 'none')} THEN true WHEN {_HAS('index', 'all')} THEN false END AS noindex, CASE WHEN {_HAS('nofollow', 'none')} THEN true WHEN {_HAS('follow', 'all')} THEN false END AS nofollow,
 CASE WHEN {_HAS('noarchive')} THEN true END AS noarchive, CASE WHEN {_HAS('nosnippet')} THEN true END AS nosnippet, {_LIMIT('max-snippet')} AS max_snippet, {_LAST('max-image-preview')} AS max_image_preview,
 {_LIMIT('max-video-preview')} AS max_video_preview, {_LAST('unavailable_after')} AS unavailable_after FROM (SELECT p_partkey, value, {_TOKENS} AS tok FROM ({{0}}) y) x"""
_PARSED = _PARSED_OF.replace("{0}", f"SELECT p_partkey, {cases.directive('p_partkey')} AS value FROM part")
_SIDE = lambda c: _PARSED_OF.replace("{0}", f"SELECT p_partkey, {c} AS value FROM ({cases.PAIRED}) z")
_TEXT = lambda *names: ", ".join(f"CAST({n} AS varchar) AS {n}" for n in names)
ORACLE_SQL["robots_directive_parse"] = f"SELECT p_partkey, value, {_TEXT('noindex', 'nofollow', 'noarchive', 'nosnippet', 'max_snippet', 'max_image_preview', 'max_video_preview', 'unavailable_after')} FROM ({_PARSED}) q"
_RANK = lambda x: f"CASE {x} WHEN 'none' THEN 0 WHEN 'standard' THEN 1 WHEN 'large' THEN 2 ELSE 3 END"
ORACLE_SQL["robots_directive_merge"] = f"""WITH p AS ({_SIDE('value_a')}), r AS ({_SIDE('value_b')}) SELECT p_partkey, value_a, value_b, {_TEXT('noindex', 'nofollow', 'max_snippet', 'max_image_preview')} FROM (SELECT a.p_partkey, a.value AS value_a, b.value AS value_b, coalesce(a.noindex OR b.noindex, a.noindex, b.noindex) AS noindex, coalesce(a.nofollow OR b.nofollow, a.nofollow, b.nofollow) AS nofollow,
 CASE WHEN a.max_snippet >= 0 AND b.max_snippet >= 0 THEN least(a.max_snippet, b.max_snippet) WHEN a.max_snippet >= 0 THEN a.max_snippet WHEN b.max_snippet >= 0 THEN b.max_snippet ELSE least(a.max_snippet, b.max_snippet) END AS max_snippet,
 CASE WHEN a.max_image_preview IS NULL THEN b.max_image_preview WHEN b.max_image_preview IS NULL OR {_RANK('a.max_image_preview')} <= {_RANK('b.max_image_preview')} THEN a.max_image_preview ELSE b.max_image_preview END AS max_image_preview
 FROM p a JOIN r b USING (p_partkey)) q"""
_ROBOTS = _with(
    """SELECT url, CASE WHEN p LIKE '/p/12%' THEN CASE WHEN length('/p/12') >= 4 THEN 'Allowed' END WHEN p LIKE '/p/1%' THEN 'Blocked' WHEN p LIKE '/p/%5' THEN 'Blocked' WHEN p LIKE '/p/%' THEN 'Allowed'
    WHEN p LIKE '/s/3%' THEN 'Allowed' WHEN p LIKE '/s/%' THEN 'Blocked' ELSE 'NoRule' END AS status FROM (SELECT url, url[18:] AS p FROM state) x""")  # fmt: skip
ORACLE_SQL["robots_txt_match"] = ORACLE_SQL["robots_txt_status"] = _ROBOTS
ORACLE_SQL["robots_group_select"] = (
    f"SELECT p_partkey, u AS user_agent, coalesce((SELECT agent FROM {_values([(a,) for a in cases.AGENTS if a != '*'], 'agent')} WHERE contains(lower(u), agent) ORDER BY length(agent) DESC, agent LIMIT 1), '*') AS agent FROM (SELECT p_partkey, user_agent AS u FROM ({cases.AGENT_ROWS}) y) x"
)
_REST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)"
_PATH = f"CASE WHEN starts_with({_REST}, '/') THEN {_REST} ELSE '/' || {_REST} END"
ORACLE_SQL["page_url_keys"] = f"SELECT page_id, split_part(url, '#', 1) AS url_key, regexp_extract(url, '^https?://[^/?#]*') AS origin, {_PATH} AS path_query FROM pages"
ORACLE_SQL["url_origin_remap"] = f"SELECT page_id, CASE WHEN regexp_extract(url, '^https?://[^/?#]*') = '{cases.CRAWL_ORIGIN}' THEN '{cases.PUBLIC_ORIGIN}' || url[{len(cases.CRAWL_ORIGIN) + 1}:] ELSE url END AS url FROM pages"
ORACLE_SQL["route_from_path"] = cases.FILE_ROUTES
_START, _WAY, _QUERY = "regexp_extract(base, '^https?://[^/?#]*')", "regexp_extract(base, '^https?://[^/?#]*([^?#]*)', 1)", "regexp_extract(base, '^[^?#]*([?][^#]*)', 1)"
_FOLDER = f"regexp_replace({_WAY}, '[^/]*$', '')"
_UP = cases.RESOLVED_SQL.format(_START, _FOLDER, _QUERY, _WAY, f"regexp_replace({_FOLDER}, '[^/]+/$', '')")
ORACLE_SQL["url_resolve"] = f"SELECT page_id, base, reference, {_UP} AS url FROM (SELECT page_id, url AS base, {cases.REFERENCE} AS reference FROM pages) x"
ORACLE_SQL["url_resolve_cases"] = (
    "SELECT page_id, CAST(pos - 1 AS integer) AS pos, href, regexp_extract(url, '^https?://[^/?#]*') || array_to_string(list_transform(string_split(split_part(href, '#', 1), ''), lambda c: CASE WHEN c > '~' THEN url_encode(c) ELSE c END), '') AS target "
    "FROM (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages) y) x"
)
_GLOBS = ("^/en/[^/]*$", "^/de/.*$", "^/.*1[^/]*$", "^/.r/[^/]*$", "^/en/[^/]*\\.html$")
ORACLE_SQL["glob_match"] = f"SELECT page_id, {', '.join(f'''regexp_matches(p, '{g}') AS g{k}''' for k, g in enumerate(_GLOBS))} FROM (SELECT page_id, {_PATH} AS p FROM pages) x"
ORACLE_SQL["sitemap_locs"] = f"SELECT 'm' || n || '.xml' AS path, CASE WHEN n % 4 = 3 THEN 'sitemapindex' ELSE 'urlset' END AS root, loc FROM ({cases.SITEMAP_ITEMS}) x"
ORACLE_SQL["sitemap_entries"] = f"SELECT 'm' || n || '.xml' AS path, loc, lastmod, CAST(NULL AS varchar) AS changefreq, priority FROM ({cases.SITEMAP_ITEMS}) x WHERE n % 4 <> 3"
ORACLE_SQL["pages_heading_count"] = "SELECT page_id, CAST(length(regexp_extract_all(lower(html), '<h[1-6][\\s>/]')) AS bigint) AS heading_count FROM pages"
_HREFS = "SELECT page_id, unnest(h) AS href, CAST(generate_subscripts(h, 1) - 1 AS integer) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages) x"
ORACLE_SQL["pages_links"] = _HREFS
ORACLE_SQL["pages_link_degree"] = f"SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct FROM ({_HREFS}) x GROUP BY 1"
ORACLE_SQL["redirect_chain_replay"] = _with(
    """, hop AS (SELECT url AS request_url, url AS here, [url] AS chain, 0 AS n FROM state WHERE redirect_target IS NOT NULL AND http_status IS NOT NULL
     UNION ALL SELECT h.request_url, s.redirect_target, list_append(h.chain, s.redirect_target), n + 1 FROM hop h JOIN state s ON s.url = h.here AND s.http_status = 301 AND s.redirect_target IS NOT NULL WHERE n < 10 AND len(list_distinct(h.chain)) = len(h.chain))
    SELECT request_url, 301 AS initial_status, coalesce(s.http_status, 0) AS status, array_to_string(chain, ' ') AS chain, h.last AS final_url
    FROM (SELECT *, CASE WHEN len(list_distinct(chain)) < len(chain) THEN chain[len(chain) - 1] ELSE here END AS last, row_number() OVER (PARTITION BY request_url ORDER BY n DESC) AS r FROM hop) h LEFT JOIN state s ON s.url = h.last WHERE r = 1""")  # fmt: skip
_KEYS = f"SELECT DISTINCT rule_id, url, severity, coalesce(declared, canonical, detail) AS subject FROM ({_ALL}) f"
ORACLE_SQL["findings_new_only"] = _with(
    f""", bst AS (SELECT * FROM state WHERE k % 67 <> 1),
    c0 AS (SELECT * REPLACE (CASE WHEN k % 83 <> 1 THEN html_canonical END AS html_canonical, CASE WHEN k % 83 <> 1 THEN http_canonical END AS http_canonical, CASE WHEN k % 83 <> 1 THEN canonical END AS canonical) FROM state WHERE k % 71 <> 1),
    cst AS (SELECT * REPLACE ((NOT noindex AND NOT blocked AND coalesce(http_status = 200, false) AND coalesce(canonical = url, true)) AS indexable) FROM c0),
    blink AS (SELECT l.* FROM links l JOIN bst ON bst.url = l.src), clink AS (SELECT l.* FROM links l JOIN cst ON cst.url = l.src WHERE NOT (k % 10 = 3 AND url LIKE '%/s/%') OR pos < (SELECT count(*) FROM links m WHERE m.src = l.src) // 2),
    blang AS (SELECT h.* FROM lang h JOIN bst ON bst.url = h.src), clang AS (SELECT h.* FROM lang h JOIN cst ON cst.url = h.src),
    {_reach_of("b", "bst", "blink")}, {_reach_of("c", "cst", "clink")},
    old AS (WITH state AS (SELECT * FROM bst), links AS (SELECT * FROM blink), lang AS (SELECT * FROM blang), reach AS (SELECT * FROM b_reach) {_KEYS}),
    now AS (WITH state AS (SELECT * FROM cst), links AS (SELECT * FROM clink), lang AS (SELECT * FROM clang), reach AS (SELECT * FROM c_reach) SELECT rule_id, url, severity, coalesce(declared, canonical, detail) AS subject FROM ({_ALL}) f)
    SELECT rule_id, is_new, count(*) AS n FROM (SELECT rule_id, NOT EXISTS (SELECT 1 FROM old o WHERE o.rule_id = now.rule_id AND o.url = now.url AND o.severity = now.severity AND o.subject IS NOT DISTINCT FROM now.subject) AS is_new FROM now) x GROUP BY ALL""")  # fmt: skip
ORACLE_SQL["redirect_rows"] = "SELECT * FROM " + _values(cases.REDIRECT_ROWS, "url_key, kind, http_status, chain, redirect_target")
ORACLE_SQL["header_canonical"] = f"SELECT p_partkey, value, {cases.LINK_TARGETS} AS target FROM ({cases.LINK_VALUES}) x"
_BODY = "regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '<!--.*?-->|<[^>]*>', ' ', 'gs')"
ORACLE_SQL["pages_signals"] = (
    "SELECT p.page_id, CAST(NULL AS varchar) AS canonical, CAST(coalesce(n_links, 0) AS integer) AS n_links, "
    f"CAST(len(regexp_extract_all({_BODY}, '[^ \\t\\r\\n]+')) AS bigint) AS word_count, CAST(length(regexp_extract_all(lower(html), '<h[1-6][\\s>/]')) AS bigint) AS heading_count "
    f"FROM pages p LEFT JOIN (SELECT page_id, count(DISTINCT href) AS n_links FROM ({_HREFS}) x GROUP BY 1) l USING (page_id)"
)

# Sources, sinks, gates; messages, which the evidence of a finding fixes.
_ENTRY_TEXT = "'This page declares ' || replace(declared, 'hreflang: ', 'hreflang ') || ', but ' || {} || '"
_TARGET = "split_part(declared, ' → ', 2)"
_SITEMAP = "'The sitemap declares this URL"
_MESSAGES = {
    (0, 0): f"{_SITEMAP} for indexing, but the effective indexing directive excludes it.'", (0, 1): f"{_SITEMAP} for indexing, but robots.txt disallows crawling it.'",
    (0, 2): f"{_SITEMAP}, but it canonicalizes to a different URL. The sitemap should contain the canonical URL.'", (0, 3): f"{_SITEMAP}, but it did not resolve to a successful page response.'",
    (1, 0): "'This URL is indexable and returns HTTP 200, but no sitemap declares it. Search engines can still find it, but the sitemap no longer describes the site.'",
    (2, 0): "'The HTML canonical and HTTP Link header canonical disagree. Use a single, consistent canonical method.'", (2, 1): "'The canonical target returned ' || observed || '. Canonical targets must resolve successfully.'",
    (2, 2): "'The canonical target was discovered but not fetched, so it could not be verified.'", (2, 3): "'The canonical target resolves successfully but is not indexable.'",
    (2, 4): "'The canonical target was not found in the scanned site. It may be unreachable or external.'",
    (3, 0): "'This page is indexable but declares no canonical URL, so duplicate variants of the same content can compete with it.'",
    (4, 0): "'Canonical chain exceeds depth 1: ' || canonical", (4, 1): "'Canonical cycle detected: ' || canonical",
    (5, 0): "'Meta robots and X-Robots-Tag disagree on noindex. Meta robots: ' || split_part(declared, '=', 2) || ', X-Robots-Tag: ' || split_part(observed, '=', 2) || '. Resolve the conflict to ensure predictable indexing behavior.'",
    (6, 0): "'This page declares hreflang entries for other pages but does not include a self-referencing hreflang entry.'",
    (6, 1): _ENTRY_TEXT.format(_TARGET) + " does not link back with a reciprocal hreflang entry.'", (6, 2): _ENTRY_TEXT.format(_TARGET) + " was not found in the scan and cannot be verified for reciprocity.'",
    (7, 0): _ENTRY_TEXT.format(_TARGET) + " canonicalizes to ' || canonical || '. Hreflang URLs should point to the canonical version.'",
    (8, 0): _ENTRY_TEXT.format("'that URL cannot be indexed because '") + "' || observed || '. Hreflang annotations are ignored when the alternate is not indexable.'",
    (9, 0): "'Internal link target ' || replace(detail, 'link target: ', '') || ' returned ' || observed || ' without a usable redirect target.'",
    (9, 1): "'Internal link target ' || declared || ' was not fetched, so its resolution could not be verified.'",
    (9, 2): "'Internal link targets ' || declared || ' which redirects to ' || replace(observed, 'redirect → ', '') || '. Link directly to the canonical URL.'",
    (9, 3): "'Internal link targets ' || declared || ', but that page canonicalizes to ' || canonical || '.'",
    (10, 0): "'Redirect cycle detected: ' || observed", (11, 0): "'This URL is indexable, but it is not reachable via internal links from the scan entry point.'",
}
_TEXTS = " ".join(f"WHEN rule_ord = {o} AND seq = {s} THEN {text}" for (o, s), text in _MESSAGES.items())
ORACLE_SQL["findings_messages"] = _with(f"SELECT rule_id, url, CASE {_TEXTS} END AS message FROM ({_ALL}) f", True)
ORACLE_SQL["findings_written"] = _with(f"SELECT {_SHOWN} FROM ({_ALL}) f", True)
_FEW = f"(SELECT * FROM ({_ALL}) g WHERE rule_ord IN (0, 3, 4)) f"
ORACLE_SQL["report_json"] = _with(f"SELECT {_SHOWN} FROM {_FEW}", True)
ORACLE_SQL["report_sarif"] = _with(f"SELECT rule_id, severity AS level, url, coalesce(declared, canonical, detail) AS subject FROM {_FEW}", True)
_LEVEL = "CASE WHEN bool_or(severity = 'error') THEN 'error' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'info' END"
_GIVEN = lambda before, after="": " ".join(f"UNION ALL SELECT '{before}{e.capitalize()}:{after}' || {e} FROM few WHERE {e} IS NOT NULL" for e in ("declared", "observed", "canonical"))
_FEW_ROWS = f", few AS (SELECT * FROM {_FEW})"
ORACLE_SQL["report_markdown"] = _with(
    f"""{_FEW_ROWS} SELECT line, count(*) AS n FROM (SELECT '| `' || rule_id || '` | ' || {_LEVEL} || ' | ' || count(*) || ' |' AS line FROM few GROUP BY rule_id UNION ALL SELECT DISTINCT '### ' || rule_id FROM few
    UNION ALL SELECT '**' || url || '** — `' || upper(severity) || '`' FROM few {_GIVEN("- **", "** ")}) x GROUP BY line""", True)  # fmt: skip
ORACLE_SQL["report_text"] = _with(
    f"""{_FEW_ROWS} SELECT line, count(*) AS n FROM (SELECT rule_id || '  ' || upper(severity) || '  (' || count(*) || CASE WHEN count(*) = 1 THEN ' finding)' ELSE ' findings)' END AS line FROM few GROUP BY rule_id, severity
    UNION ALL SELECT '  URL:       ' || url FROM few {" ".join(f"UNION ALL SELECT '{f'  {e.capitalize()}:':<13}' || {e} FROM few WHERE {e} IS NOT NULL" for e in ("declared", "observed", "canonical"))}
    UNION ALL SELECT (SELECT count(*) FROM few) || ' findings: ' || string_agg(n || ' ' || severity || '(s)', ' ' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM few GROUP BY severity) y HAVING count(*) > 0) x GROUP BY line""", True)  # fmt: skip
ORACLE_SQL["findings_gate"] = _with(
    f"""SELECT family, fail_on, EXISTS (SELECT 1 FROM ({_ALL}) g WHERE g.rule_ord = x.o AND g.severity = fail_on) AS fails, false AS fails_if_new
    FROM (SELECT * FROM (VALUES ('canonical_presence', 3), ('canonical_resolution', 4)) a(family, o), (VALUES ('error'), ('warning'), ('info')) b(fail_on)) x""", True)  # fmt: skip
ORACLE_SQL["findings_own_family"] = _with(
    f"""SELECT {_SHOWN} FROM ({_ALL}) f WHERE rule_ord = 3 UNION ALL SELECT 'OWN-1', 'info', url, NULL, CAST(word_count AS varchar), NULL, NULL FROM state WHERE word_count < 50""", True)
ORACLE_SQL["snapshot_table"] = ORACLE_SQL["snapshot_json"] = _with("SELECT url AS url_key, url, http_status, canonical AS effective_canonical, indexable AS is_indexable, word_count, heading_count FROM state")
ORACLE_SQL["snapshot_statistics"] = ORACLE_SQL["state_statistics"]
ORACLE_SQL["file_kinds"] = (
    "SELECT relative, CASE WHEN relative = 'robots.txt' THEN 'robots' WHEN n LIKE 'sitemap-%' OR n LIKE '%-sitemap.xml' OR n = 'sitemap.xml' THEN 'sitemap' WHEN n LIKE '%.html' OR n LIKE '%.htm' THEN 'html' END AS kind "
    f"FROM (SELECT relative, split_part(relative, '/', -1) AS n FROM (SELECT {cases.FILE_NAMES} AS relative FROM part) x) y"
)
ORACLE_SQL["html_signals"] = cases.PAGE_SIGNALS
ORACLE_SQL["html_broken"] = cases.BROKEN_SIGNALS
ORACLE_SQL["robots_txt_parse"] = cases.SUPPLIER_RULES
ORACLE_SQL["robots_tags_merge"] = ORACLE_SQL["robots_directive_merge"]
ORACLE_SQL["sitemap_page_urls"] = "SELECT DISTINCT loc AS url FROM (" + ORACLE_SQL["sitemap_locs"] + ") x WHERE root = 'urlset'"
ORACLE_SQL["live_sitemap_urls"] = ORACLE_SQL["sitemap_page_urls"]
ORACLE_SQL["redirect_last_hop"] = _with("SELECT url AS url_key, CASE WHEN k % 74 = 0 THEN url ELSE redirect_target END AS last, CASE WHEN k % 74 = 0 THEN 3 ELSE 2 END AS n FROM state WHERE redirect_target IS NOT NULL")
_ORIGIN = "regexp_extract(url, '^https?://[^/?#]*')"
ORACLE_SQL["static_states"] = f"""WITH own AS (SELECT url, split_part(url, '#', 1) AS key, page_id % 3 = 0 AS mapped, (SELECT count(DISTINCT href) FROM ({_HREFS}) h WHERE h.page_id = pages.page_id) AS n_links FROM pages),
 linked AS (SELECT DISTINCT {_ORIGIN} AS o, {_ORIGIN} || href AS key FROM pages JOIN ({_HREFS}) h USING (page_id))
 SELECT http_status, found_in_sitemap, is_indexable, sources, count(*) AS n, CAST(sum(n_links) AS bigint) AS n_links FROM (
  SELECT 200 AS http_status, bool_or(mapped) AS found_in_sitemap, true AS is_indexable, CASE WHEN bool_or(key IN (SELECT key FROM linked)) THEN 'DirectScan,InternalLink' ELSE 'DirectScan' END || CASE WHEN bool_or(mapped) THEN ',Sitemap' ELSE '' END AS sources, arg_max(n_links, url) AS n_links FROM own GROUP BY key
  UNION ALL SELECT CASE WHEN o = '{cases.CRAWL_ORIGIN}' THEN 404 END, false, false, 'InternalLink', 0 FROM linked WHERE key NOT IN (SELECT key FROM own)) x GROUP BY ALL"""
ORACLE_SQL["crawl_replay"] = _with(
    f""", pg AS (SELECT url, coalesce(http_status, 503) AS status, redirect_target, CASE WHEN http_status = 200 THEN html_canonical END AS canon FROM state
      UNION ALL SELECT DISTINCT 'https://site.test/p/' || p, 404, NULL, NULL FROM (SELECT unnest([p_partkey + 1, p_partkey + 2]) AS p FROM part) x WHERE 'https://site.test/p/' || p NOT IN (SELECT url FROM state)),
    go AS (SELECT l.src, l.link_url AS dst, false AS moved FROM links l JOIN pg ON pg.url = l.src AND pg.status = 200 UNION SELECT url, canon, false FROM pg WHERE canon IS NOT NULL UNION SELECT url, redirect_target, true FROM pg WHERE redirect_target IS NOT NULL),
    visit AS (SELECT '{HOME}' AS url, true AS fetched UNION SELECT go.dst, go.moved OR NOT starts_with(go.dst, 'https://site.test/p/7') FROM visit v JOIN go ON go.src = v.url AND v.fetched)
    SELECT v.url AS url_key, CASE WHEN v.fetched THEN pg.status END AS http_status, CASE WHEN starts_with(v.url, 'https://site.test/p/7') THEN 'Blocked' ELSE 'NoRule' END AS robots_txt_status,
     CASE WHEN v.fetched AND pg.status = 200 THEN (SELECT count(*) FROM links l WHERE l.src = v.url) ELSE 0 END AS n_links FROM (SELECT url, bool_or(fetched) AS fetched FROM visit GROUP BY 1) v JOIN pg USING (url)""")  # fmt: skip
ORACLE_SQL["static_files"] = cases.SUPPLIER_STATES
ORACLE_SQL["public_origins"] = f"SELECT page_id, {cases.ORIGIN_TEXT.format(_ORIGIN)} AS text, CASE WHEN page_id % 5 < 2 THEN {_ORIGIN} END AS origin FROM pages"
ORACLE_SQL["policy_limits"] = f"SELECT name, fail_on, {', '.join(f'CAST({c} AS double) AS {c}' for c in ('indexable', 'links', 'words', 'headings'))} FROM " + _values(
    [(n, *rest) for n, _, *rest in cases.POLICIES], "name, fail_on, indexable, links, words, headings"
)
ORACLE_SQL["reach_depths"] = _with(
    f""", edge AS (SELECT l.src, l.link_url AS dst FROM links l WHERE link_url IN (SELECT url FROM state) UNION SELECT url, redirect_target FROM state WHERE redirect_target IN (SELECT url FROM state)),
    walk AS (SELECT '{HOME}' AS url, 0 AS d UNION SELECT e.dst, d + 1 FROM walk w JOIN edge e ON e.src = w.url WHERE d < 40)
    SELECT CAST(depth AS bigint) AS depth, count(*) AS n FROM (SELECT url, min(d) AS depth FROM walk GROUP BY 1) x GROUP BY 1""")  # fmt: skip
ORACLE_SQL["stream_findings"] = _with(f"SELECT {_SHOWN} FROM ({_ALL}) f WHERE rule_ord IN (0, 3, 5, 10)", True)
