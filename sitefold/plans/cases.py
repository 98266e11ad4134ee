"""Small literal inputs of queries, with results where no engine can state them."""

from __future__ import annotations

DIRECTIVES = ("noindex, nofollow", "index, follow", "none", "all", "NOINDEX", "follow,nofollow ,max-snippet:7, max-snippet:-1", "max-snippet:100", "max-image-preview:large", "max-image-preview:none, nosnippet", "googlebot: noindex", "noarchive,unavailable_after: 25 Jun 2030", "max-video-preview:x, max-video-preview:5", "")
ROBOTS_RULES = (("/p/", True), ("/p/1", False), ("/p/12", True), ("/p/*5$", False), ("/s/*", False), ("/s/3", True))
AGENTS = ("*", "bot", "goodbot", "badbot", "good")
USER_AGENTS = ("GoodBot/1.0", "badbot", "Mozilla/5.0", "a bot", "Good citizen")
CRAWL_ORIGIN, PUBLIC_ORIGIN = "https://tionsh.example.net", "https://www.public.test"
ROUTES = (("index.html", "https://example.test/"), ("a/index.htm", "https://example.test/a/"), ("about.html", "https://example.test/about"), ("faq/why?.htm", "https://example.test/faq/why%3F"), ("c#/notes.html", "https://example.test/c%23/notes"), ("a b/c d.html", "https://example.test/a%20b/c%20d"), ("x/y.HTML", "https://example.test/x/y.HTML"))
RESOLVED = (
    ("https://a.test/x/y", "z", "https://a.test/x/z"), ("https://a.test/x/y", "../z?q=1#f", "https://a.test/z?q=1"), ("https://a.test", "//B.test:443/p", "https://b.test/p"), ("https://a.test/x?y=1", "", "https://a.test/x?y=1"),
    ("https://a.test/x", "HTTP://C.test/./a/../b c", "http://c.test/b%20c"), ("https://a.test/d/", "?n", "https://a.test/d/?n"), ("https://a.test/d/e", "#only", "https://a.test/d/e"), ("https://a.test/", "http://[", None),
)
GLOBS = ("/en/*", "/de/**", "/**/1*", "/?r/*", "/en/*.html")
EXCLUSIONS = ({"rule_id": "CC-ORPHAN-001", "url_pattern": "/p/1*"}, {"rule_id": "CC-LINK-TARGET-004", "url_pattern": "https://site.test/s/**"}, {"rule_id": "CC-SITEMAP-INDEXABILITY-003", "url_pattern": "/p/?5"})
SITEMAPS = (
    ("a.xml", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.test/1?x=1&amp;y=2 </loc><priority>0.5</priority></url><url><loc>https://a.test/2</loc><lastmod>2024-01-01</lastmod></url></urlset>'),
    ("b.xml", '<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>https://a.test/3</s:loc></s:url></s:urlset>'),
    ("c.xml", "<sitemapindex><sitemap><loc>https://a.test/a.xml</loc></sitemap></sitemapindex>"),
    ("d.xml", "<urlset/>"),
)
_A = "https://a.test/"
#: (url, status, location), the urls that are asked for, and the rows that they give.
RESPONSES = (
    (_A + "1", 301, "/2"), (_A + "2", 302, "https://other.test/z"), (_A + "5", 307, "6"), (_A + "6", 308, "5"), (_A + "7", 300, "/8"), (_A + "8", 204, None), (_A + "9", 399, "/8#part"), (_A + "10", 304, None),
    *((f"{_A}h{k}", 301, f"/h{k + 1}") for k in range(13)),
)
REQUESTS = (_A + "1", _A + "5", _A + "7", _A + "9", _A + "10", _A + "h0")
REDIRECT_ROWS = (
    (_A + "1", "moved", 301, f"{_A}1 {_A}2 https://other.test/z", "https://other.test/z"), (_A + "2", "fetched", 302, "true", _A + "2"), (_A + "5", "moved", 307, f"{_A}5 {_A}6 {_A}5", _A + "5"), (_A + "6", "fetched", 308, "true", _A + "6"),
    (_A + "7", "moved", 300, f"{_A}7 {_A}8", _A + "8"), (_A + "8", "fetched", 204, "true", _A + "8"), (_A + "9", "moved", 399, f"{_A}9 {_A}8#part", _A + "8#part"), (_A + "8", "fetched", 204, "true", _A + "8#part"),
    (_A + "10", "fetched", 304, "false", _A + "10"), (_A + "h0", "moved", 301, " ".join(f"{_A}h{k}" for k in range(11)), _A + "h10"), (_A + "h10", "fetched", 301, "true", _A + "h10"),
)
LINK_HEADERS = (
    ("</a>; rel='canonical'", "/a"), ('</a>; rel="canonical", </b>; rel="canonical"', "/a"), ("</a>; rel=canonical|</b>; rel=next|</c>; type=x; REL = \"next Canonical\"", "/c"), ("</a>; rel=canonical|</b>; rel=alternate", "/a"),
    ("no brackets; rel=canonical, </d>;rel=canonical", "/d"), ("</e>; rel=canonicals", None), ("</f>" + "; x=y" * 120 + "; rel=canonical", "/f"), ("", None),
)
#: A path of a static file by part key, in SQL that both engines read alike.
FILE_NAMES = """concat(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_deep/' ELSE '.well/x/' END, CASE p_partkey % 9 WHEN 0 THEN 'robots.txt' WHEN 1 THEN 'sitemap.xml' WHEN 2 THEN 'sitemap-7.html'
 WHEN 3 THEN 'news-sitemap.xml' WHEN 4 THEN 'page.html' WHEN 5 THEN 'page.htm' WHEN 6 THEN 'page.xhtml' WHEN 7 THEN 'mysitemap.xml' ELSE concat('p', p_partkey, '.html') END)"""
#: (name, html) of https://a.test/d/p, then canonical, robots, hreflang, links, words, headings.
PAGES = (
    ("canonical", '<head><link rel="canonical" href="../c#x"><link rel="canonical" href="/second"></head><body>one two', _A + "c", "", "", "", 2, 0),
    ("robots", '<head><meta name="Robots" content="noindex"><meta name="author" content="x"><meta name="robots" content="max-snippet:5"></head><body><p>one', None, "noindex|max-snippet:5", "", "", 1, 0),
    ("hreflang", '<head><link rel="alternate" hreflang="de" href="/de/"><link rel="Alternate" hreflang="x-default" href="p?a"><link rel="alternate" href="/feed"></head><body>', None, "", f"de={_A}de/ x-default={_A}d/p?a", "", 0, 0),
    ("links", '<body><a href="#f">a</a> <a href="mailto:x@y">m</a> <a href="javascript:0">j</a> <a href="q?x=1#y">q</a> <a href="q?x=1">q</a> <a href="https://b.test/">b</a> <a>none</a>', None, "", "", _A + "d/q?x=1", 7, 0),
    ("words", "<body><h1>a b</h1><script>x y</script><style>z</style><h7>c</h7><h6>d&nbsp;e</h6>", None, "", "", "", 5, 2),
    ("empty", "", None, "", "", "", 0, 0),
)
#: (name, user agent, body), then agent, rules, delay, sitemaps.
ROBOTS_FILES = (
    ("groups", "GoodBot/2", "User-agent: good\nUser-agent: other\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /", "good", "-/a +/a/b", 2.0, ""),
    ("groups", "unknown", "User-agent: good\nUser-agent: other\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /", "*", "-/", None, ""),
    ("joined", "bot", "user-agent: bot\ndisallow: /x # why\nsitemap: /s.xml\nuser-agent: *\nallow: /\nUSER-AGENT: Bot\nDisallow:\nDisallow: /y", "bot", "-/x -/y", None, _A + "s.xml"),
    ("unruled", "bot", "User-agent: bot\nCrawl-delay: x\nUser-agent: *\nDisallow: /", "bot", "", None, ""),
    ("none", "bot", "Disallow: /before\nnonsense\nSitemap: https://b.test/m.xml", "*", "", None, "https://b.test/m.xml"),
)
CRAWL_ROBOTS = "User-agent: *\nDisallow: /p/7"
ORIGINS = (
    ("https://www.a.test", "https://www.a.test"), ("HTTP://A.Test:80/", "http://a.test"), ("https://a.test:8443", "https://a.test:8443"), ("https://a.test/x", None), ("ftp://a.test", None), ("a.test", None), ("https://u@a.test", None), ("https://a.test?q", None),
)
#: (name, text), then severities that fail and the limits; all null for what is refused.
POLICIES = (
    ("empty", "", "error", 5.0, 10.0, 50.0, 15.0), ("some", '[general]\nfail_on = ["Warning", "error"]\n[diff]\nmax_link_loss_percent = 0\nmax_word_loss_percent = 99.5', "warning error", 5.0, 0.0, 99.5, 15.0),
    ("key", "[diff]\nmax_loss = 1", None, None, None, None, None), ("range", "[diff]\nmax_link_loss_percent = 101", None, None, None, None, None), ("severity", '[general]\nfail_on = ["fatal"]', None, None, None, None, None),
    ("reason", '[[exclusions]]\nrule_id = "CC-ORPHAN-001"\nurl_pattern = "/x"\nreason = " "', None, None, None, None, None),
)

# Inputs that are made of table columns, in SQL that both engines read alike; what they give is SQL too.


def _pick(k: str, values) -> str:
    """One of ``values`` by ``k``."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {n} THEN {quote(v)}" for n, v in enumerate(values)) + " END"


def directive(k: str) -> str:
    """A robots directive of a part."""
    more = "CASE p_size % 4 WHEN 1 THEN concat(', max-snippet:', p_size) WHEN 2 THEN concat(',Max-Image-Preview: ', CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'standard' ELSE 'large' END) WHEN 3 THEN concat(', max-video-preview:', p_size - 25) ELSE '' END"
    return f"concat({_pick(k, DIRECTIVES)}, {more})"


PAIRED = f"SELECT p_partkey, {directive('p_partkey')} AS value_a, {directive('(p_partkey * 5 + p_size)')} AS value_b FROM part"
#: Elements of sitemaps: 40 files of part pages, every fourth an index, every fourth with a prefix.
SITEMAP_ITEMS = """SELECT p_partkey % 40 AS n, p_partkey AS k, concat('https://a.test/p/', p_partkey, '?x=1&y=', p_size) AS loc, CASE WHEN p_partkey % 3 = 0 THEN '2024-01-01' END AS lastmod,
 CASE WHEN p_partkey % 7 < 3 THEN CAST(p_partkey % 7 AS double) / 2 END AS priority FROM part"""
LINK_VALUES = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('</p/', p_partkey, '>; rel="canonical"') WHEN 1 THEN concat('</a>; rel=next, </p/', p_partkey, '>; REL=Canonical') WHEN 2 THEN concat('</x', p_partkey, '>; rel=alternate')
 WHEN 3 THEN concat('</p/', p_partkey, '>; rel=canonical|</q/', p_partkey, '>; rel="next canonical"') WHEN 4 THEN '' ELSE concat('no brackets; rel=canonical, </d/', p_partkey, '>;rel=canonical') END AS value FROM part"""
LINK_TARGETS = "CASE p_partkey % 6 WHEN 0 THEN concat('/p/', p_partkey) WHEN 1 THEN concat('/p/', p_partkey) WHEN 3 THEN concat('/q/', p_partkey) WHEN 5 THEN concat('/d/', p_partkey) END"
#: Pages of parts at https://a.test/d/p, and their signals.
PAGE_HTML = """SELECT p_partkey, CASE p_partkey % 6
 WHEN 0 THEN concat('<head><link rel="canonical" href="../c', p_partkey, '#x"><link rel="canonical" href="/second"></head><body>one two')
 WHEN 1 THEN concat('<head><meta name="Robots" content="noindex"><meta name="author" content="x"><meta name="robots" content="max-snippet:', p_size, '"></head><body><p>one')
 WHEN 2 THEN concat('<head><link rel="alternate" hreflang="de" href="/de/', p_partkey, '"><link rel="Alternate" hreflang="x-default" href="p?a=', p_size, '"><link rel="alternate" href="/feed"></head><body>')
 WHEN 3 THEN concat('<body><a href="#f">a</a> <a href="mailto:x@y">m</a> <a href="javascript:0">j</a> <a href="q?x=', p_partkey, '#y">q</a> <a href="q?x=', p_partkey, '">q</a> <a href="https://b.test/">b</a> <a href="/', p_size, '">none</a>')
 WHEN 4 THEN concat('<body><h1>a b</h1><script>x y</script><style>z</style><h7>c</h7><h6>d&nbsp;e</h6>', repeat('<p>w &amp; w</p>', p_size)) ELSE '' END AS html FROM part"""
PAGE_SIGNALS = """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN concat('https://a.test/c', p_partkey) END AS canonical, CASE WHEN p_partkey % 6 = 1 THEN concat('noindex|max-snippet:', p_size) ELSE '' END AS robots,
 CASE WHEN p_partkey % 6 = 2 THEN concat('de=https://a.test/de/', p_partkey, ' x-default=https://a.test/d/p?a=', p_size) ELSE '' END AS lang, CASE WHEN p_partkey % 6 = 3 THEN concat('https://a.test/', p_size, ' https://a.test/d/q?x=', p_partkey) ELSE '' END AS links,
 CAST(CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 7 WHEN 4 THEN 5 + 3 * p_size ELSE 0 END AS bigint) AS word_count, CAST(CASE WHEN p_partkey % 6 = 4 THEN 2 ELSE 0 END AS bigint) AS heading_count FROM part"""
#: Broken markup of parts as browsers read it, and its signals.
BROKEN_HTML = """SELECT p_partkey, CASE p_partkey % 8
 WHEN 0 THEN concat('<table>', repeat('w ', p_size), '<tr><td>a b</table>') WHEN 1 THEN concat('<p>x', repeat('</i>y', p_size)) WHEN 2 THEN concat('<p>x', repeat('<b></b>y', p_size))
 WHEN 3 THEN concat('<title>t u</title><ul>', repeat('<li>a<li>b', p_size)) WHEN 4 THEN concat('<noscript><a href=/n>a</a></noscript><a href=/p', p_partkey, '>x y') WHEN 5 THEN concat('<h1>a<h2>b</h3>', repeat('<h4>c', p_size))
 WHEN 6 THEN concat('<b>', repeat('<p>a</b>b', p_size)) ELSE concat('<textarea><a href=/n>', repeat(' z', p_size), '</textarea>k<script>"</p>') END AS html FROM part"""
BROKEN_SIGNALS = """SELECT p_partkey, CASE WHEN p_partkey % 8 = 4 THEN concat('https://a.test/p', p_partkey) ELSE '' END AS links,
 CAST(CASE p_partkey % 8 WHEN 0 THEN p_size + 2 WHEN 1 THEN 1 WHEN 2 THEN p_size + 1 WHEN 3 THEN 2 * p_size WHEN 4 THEN 2 WHEN 5 THEN p_size + 2 WHEN 6 THEN p_size + 1 ELSE p_size + 3 END AS bigint) AS word_count,
 CAST(CASE WHEN p_partkey % 8 = 5 THEN p_size + 2 ELSE 0 END AS bigint) AS heading_count FROM part"""
FILE_ROUTES = """SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a b/' ELSE 'c#/d/' END, CASE p_partkey % 5 WHEN 0 THEN 'index.html' WHEN 1 THEN 'index.htm' WHEN 2 THEN concat('p', p_partkey, '.html') WHEN 3 THEN concat('why', p_partkey, '?.htm') ELSE 'x.HTML' END) AS path,
 concat('https://example.test/', CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a%20b/' ELSE 'c%23/d/' END, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN concat('p', p_partkey) WHEN 3 THEN concat('why', p_partkey, '%3F') ELSE 'x.HTML' END) AS url FROM part"""
#: References by page; ``{0}`` is the page's scheme and host, ``{1}`` its folder, ``{2}`` its query with the mark, ``{3}`` its path, ``{4}`` the folder above.
REFERENCE = """CASE page_id % 10 WHEN 0 THEN concat('rel', page_id) WHEN 1 THEN concat('/abs//', page_id, '?q=1#f') WHEN 2 THEN '?n=' WHEN 3 THEN '#only' WHEN 4 THEN '//B.test:443/p' WHEN 5 THEN 'HTTP://C.test/./a/../b c' WHEN 6 THEN '../up'
 WHEN 7 THEN '' WHEN 8 THEN './x/../../y/' ELSE 'http://[' END"""
RESOLVED_SQL = """CASE page_id % 10 WHEN 0 THEN concat({0}, {1}, 'rel', page_id) WHEN 1 THEN concat({0}, '/abs//', page_id, '?q=1') WHEN 2 THEN concat({0}, {3}, '?n=') WHEN 3 THEN concat({0}, {3}, {2})
 WHEN 4 THEN CASE WHEN {0} LIKE 'https:%' THEN 'https://b.test/p' ELSE 'http://b.test:443/p' END WHEN 5 THEN 'http://c.test/b%20c' WHEN 6 THEN concat({0}, {4}, 'up') WHEN 7 THEN concat({0}, {3}, {2}) WHEN 8 THEN concat({0}, {4}, 'y/') END"""
ORIGIN_TEXT = "concat({0}, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/x' WHEN 3 THEN '?q' ELSE '#f' END)"
#: robots.txt files of suppliers, and the agent that asks.
SUPPLIER_ROBOTS = """SELECT s_suppkey, concat('Bot', s_suppkey % 4, '/2.0') AS user_agent, concat('User-agent: bot', s_suppkey % 3, chr(10), 'Disallow: /a', s_suppkey, ' # why', chr(10), 'Allow: /a', s_suppkey, '/b', chr(10), 'Crawl-delay: ', s_suppkey % 5,
 chr(10), chr(10), 'USER-AGENT: *', chr(10), 'Disallow: /x', s_suppkey % 7, chr(10), 'Disallow:', chr(10), 'Sitemap: /m', s_suppkey, '.xml') AS body FROM supplier"""
SUPPLIER_RULES = """SELECT s_suppkey, concat('Bot', s_suppkey % 4, '/2.0') AS user_agent, CASE WHEN s_suppkey % 3 = s_suppkey % 4 THEN concat('bot', s_suppkey % 3) ELSE '*' END AS agent,
 CASE WHEN s_suppkey % 3 = s_suppkey % 4 THEN concat('-/a', s_suppkey, ' +/a', s_suppkey, '/b') ELSE concat('-/x', s_suppkey % 7) END AS rules,
 CASE WHEN s_suppkey % 3 = s_suppkey % 4 THEN CAST(s_suppkey % 5 AS double) END AS delay, concat('https://a.test/m', s_suppkey, '.xml') AS sitemaps FROM supplier"""
AGENT_ROWS = f"SELECT p_partkey, concat({_pick('p_partkey', USER_AGENTS)}, ' x', p_size) AS user_agent FROM part"
#: Files of suppliers (pages, sitemaps, a robots.txt, notes), and the states of https://a.test that they give.
SUPPLIER_FILES = """SELECT concat(CASE WHEN s_suppkey = 1 THEN 'index' WHEN s_suppkey % 4 = 0 THEN concat('_posts/p', s_suppkey) WHEN s_suppkey % 4 = 1 THEN concat('.well/p', s_suppkey) WHEN s_suppkey % 4 = 2 THEN concat('d/', s_suppkey, '/index')
 ELSE concat('p', s_suppkey) END, CASE s_suppkey % 3 WHEN 0 THEN '.htm' ELSE '.html' END) AS path,
 concat(repeat('<p>w', CAST(s_suppkey % 7 + 1 AS int)), CASE WHEN s_suppkey = 1 THEN '<a href="/p3">x</a>' WHEN s_suppkey % 5 = 0 THEN concat('<a href="/lost', s_suppkey, '">x</a>') ELSE '' END) AS body FROM supplier
UNION ALL SELECT concat('maps/sitemap-', s_suppkey, '.xml'), concat('<urlset><url><loc>https://a.test/p', s_suppkey, '</loc></url><url><loc>https://a.test/absent', s_suppkey, '</loc></url></urlset>') FROM supplier WHERE s_suppkey % 20 = 3
UNION ALL SELECT 'robots.txt', concat('User-agent: *', chr(10), 'Disallow: /d/') FROM supplier WHERE s_suppkey = 1
UNION ALL SELECT concat('deep/', s_suppkey, '/notes.txt'), 'not read' FROM supplier WHERE s_suppkey % 50 = 7"""
SUPPLIER_STATES = """SELECT concat('https://a.test/', CASE WHEN s_suppkey = 1 THEN '' WHEN s_suppkey % 4 = 0 THEN concat('_posts/p', s_suppkey) WHEN s_suppkey % 4 = 1 THEN concat('.well/p', s_suppkey) WHEN s_suppkey % 4 = 2 THEN concat('d/', s_suppkey, '/')
 ELSE concat('p', s_suppkey) END) AS url_key, 200 AS http_status, CASE WHEN s_suppkey % 4 = 2 THEN 'Blocked' ELSE 'NoRule' END AS robots_txt_status, s_suppkey % 20 = 3 AS found_in_sitemap, s_suppkey IN (1, 3) AS is_reachable,
 concat('DirectScan', CASE WHEN s_suppkey = 3 THEN ',InternalLink' ELSE '' END, CASE WHEN s_suppkey % 20 = 3 THEN ',Sitemap' ELSE '' END) AS sources, CAST(s_suppkey % 7 + CASE WHEN s_suppkey = 1 OR s_suppkey % 5 = 0 THEN 2 ELSE 1 END AS bigint) AS word_count FROM supplier
UNION ALL SELECT concat('https://a.test/lost', s_suppkey), 404, 'NoRule', false, false, 'InternalLink', NULL FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT concat('https://a.test/absent', s_suppkey), 404, 'NoRule', true, false, 'Sitemap', NULL FROM supplier WHERE s_suppkey % 20 = 3"""
