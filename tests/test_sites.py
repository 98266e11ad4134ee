"""Rules, sources and reports on hand-made sites."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sitefold.functions.redirects import has_cycle, last_hop
from sitefold.functions.robots import parse_directive
from sitefold.operators import diff, findings
from sitefold.operators.reach import reachable_keys
from sitefold.operators.rules import FAMILIES, diff_loss
from sitefold.operators.state import Site, derive, statistics, with_defaults
from sitefold.schemas import FETCHES
from sitefold.sinks import reports
from sitefold.sources import crawl, sitemap, snapshot
from sitefold.sources.policy import LIMITS
from sitefold.sources.html import signals
from sitefold.sources.static_site import list_files, read_files, scan_directory

PAGE = '<html><head><link rel="canonical" href="https://example.test{0}">{2}</head><body><h1>Title</h1><p>some words here</p>{1}</body></html>'
ROBOTS = "User-agent: *\nDisallow: /private\n"


A_TEST = "https://a.test/"
#: Files of a directory (links by name), and the states of https://a.test that they give.
FILES = (
    ("index.html", '<h1>Home page</h1><a href="/_posts/one">1</a><a href="/lost">2</a>'), ("_posts/one.html", '<p>a b c</p><a href="/.well/known">k</a>'), (".well/known.html", "<p>x"), ("index/index.html", "<p>apart from links"),
    ("robots.txt", "User-agent: *\nDisallow: /index/"), ("deep/robots.txt", "User-agent: *\nDisallow: /"), ("maps/sitemap-1.xml", "<urlset><url><loc>https://a.test/_posts/one</loc></url><url><loc>https://a.test/absent</loc></url></urlset>"),
    ("notes.txt", "not read"),
)
FILE_STATES = (
    (A_TEST, 200, "NoRule", False, True, "DirectScan", 4), (A_TEST + "_posts/one", 200, "NoRule", True, True, "DirectScan,InternalLink,Sitemap", 4), (A_TEST + ".well/known", 200, "NoRule", False, True, "DirectScan,InternalLink", 1),
    (A_TEST + "index/", 200, "Blocked", False, False, "DirectScan", 3), (A_TEST + "lost", 404, "NoRule", False, True, "InternalLink", None), (A_TEST + "absent", 404, "NoRule", True, False, "Sitemap", None),
)


def link(*paths):
    return "".join(f'<a href="{p}">x</a>' for p in paths)


def urlset(*paths):
    return "<urlset>" + "".join(f"<url><loc>https://example.test{p}</loc></url>" for p in paths) + "</urlset>"


def scan(spark, folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return scan_directory(spark, str(folder))


GOOD = {
    "index.html": PAGE.format("/", link("/about", "/blog/"), ""), "about.html": PAGE.format("/about", link("/"), ""), "blog/index.html": PAGE.format("/blog/", link("/"), ""),
    "robots.txt": ROBOTS, "sitemap.xml": urlset("/", "/about", "/blog/"), "style.css": "p{}",
}


def ids(site, **kw):
    return sorted(r["rule_id"] for r in findings.run_rules(site, **kw).collect())


def test_clean_site(spark, tmp_path):
    site = scan(spark, tmp_path, GOOD)
    n = statistics(site.state).head()
    assert (n.total_urls, n.indexable_urls, n.orphan_urls, n.sitemap_urls, n.internal_link_urls) == (3, 3, 0, 3, 3)
    assert ids(site) == []


def test_static_findings(spark, tmp_path):
    files = GOOD | {
        "lonely.html": PAGE.format("/lonely", "", ""), "hidden.html": PAGE.format("/hidden", link("/gone"), '<meta name="robots" content="noindex">'), "private.html": PAGE.format("/private", "", ""),
        "plain.html": "<html><body>words <a href='/a'>a</a></body></html>", "a.html": PAGE.format("/b", "", ""), "b.html": PAGE.format("/a", "", ""), "sitemap-2.xml": urlset("/hidden", "/private", "/nothing"),
        "en/page.html": PAGE.format("/en/page", "", '<link rel="alternate" hreflang="en" href="/en/page"><link rel="alternate" hreflang="es" href="/hidden">'),
    }
    site = scan(spark, tmp_path, files)
    got = set(ids(site))
    assert {"CC-ORPHAN-001", "CC-SITEMAP-INDEXABILITY-001", "CC-SITEMAP-INDEXABILITY-002", "CC-SITEMAP-INDEXABILITY-004", "CC-LINK-TARGET-001", "CC-CANONICAL-RESOLUTION-002", "CC-CANONICAL-PRESENCE-001", "CC-SITEMAP-COVERAGE-001", "CC-HREFLANG-INDEXABILITY-001", "CC-HREFLANG-RECIPROCAL-001"} <= got
    rule = {"rule_id": "CC-ORPHAN-001", "url_pattern": "https://example.test/lonely", "reason": "r"}
    orphans = findings.run_rules(site, exclusions=[rule]).where("rule_id = 'CC-ORPHAN-001'").select("url").collect()
    assert "https://example.test/lonely" not in [r.url for r in orphans] and orphans
    row = site.state.where("url_key = 'https://example.test/nothing'").head()
    assert row.http_status == 404 and row.sources == ["Sitemap"] and row.word_count is None


def rows(spark, *pages):
    """States of a few columns."""
    schema = "url_key string, url string, http_status int, html_canonical string, http_canonical string, redirect_target string, redirect_chain array<string>, internal_links_out array<string>, hreflang array<struct<lang:string,url:string>>, found_in_sitemap boolean, word_count long, heading_count long"
    names = [x.split()[0] for x in schema.replace(",url:string", "").split(", ")]
    return Site(derive(with_defaults(spark.createDataFrame([tuple(p.get(c, p["url"].partition("#")[0] if c == "url_key" else None) for c in names) for p in pages], schema))), "https://a.test/")


def test_three_cycle_is_a_chain(spark):
    u = "https://a.test/{}".format
    site = rows(spark, *[{"url": u(k), "http_status": 200, "html_canonical": u((k + 1) % 3)} for k in range(3)])
    assert [x for x in ids(site) if "RESOLUTION" in x] == ["CC-CANONICAL-RESOLUTION-001"] * 3


def test_fragment_in_url(spark):
    site = rows(spark, {"url": "https://a.test/x#f", "http_status": 200, "html_canonical": "https://a.test/x"})
    assert site.state.head().is_indexable is False


def test_missing_canonical_target_is_a_warning(spark):
    site = rows(spark, {"url": "https://a.test/x", "http_status": 200, "html_canonical": "https://b.test/"})
    found = findings.run_rules(site).where("rule_id = 'CC-CANONICAL-CONSISTENCY-003'").head()
    assert found.severity == "warning" and found.observed == "not found in scan"


def test_redirects_and_headers(spark):
    site = rows(spark, {"url": "https://a.test/", "http_status": 200, "internal_links_out": ["https://a.test/r", "https://a.test/q"], "html_canonical": "https://a.test/", "http_canonical": "https://a.test/z"},
                {"url": "https://a.test/r", "http_status": 301, "redirect_target": "https://a.test/", "redirect_chain": ["https://a.test/r", "https://a.test/", "https://a.test/r"]}, {"url": "https://a.test/q"})
    got = ids(site)
    for rule in ("CC-REDIRECT-RESOLUTION-001", "CC-LINK-TARGET-002", "CC-LINK-TARGET-003", "CC-CANONICAL-CONSISTENCY-001"):
        assert rule in got


def test_nofollow_conflict(spark):
    base = rows(spark, {"url": "https://a.test/", "http_status": 200}).state
    state = base.withColumn("html_meta_robots", parse_directive("'follow'")).withColumn("http_x_robots_tag", parse_directive("'none, max-snippet:5'"))
    found = findings.run_rules(Site(derive(state))).where("rule_id = 'CC-ROBOTS-EFFECTIVE-001'").collect()
    assert [r.declared for r in found] == ["meta robots: nofollow=false"]


def test_diff_and_losses(spark):
    p = lambda k, **kw: {"url": f"https://a.test/{k}", "http_status": 200} | kw
    old = rows(spark, p(1, word_count=1000, heading_count=10, internal_links_out=list("abcde")), p(2, word_count=10), p(3))
    new = rows(spark, p(1, word_count=100, heading_count=2, internal_links_out=["a"]), p(4))
    assert [r[0] for r in diff.lost(old, new).orderBy("url_key").collect()] == ["https://a.test/2", "https://a.test/3"]
    kinds = [r.kind for r in diff.changes(old, new).orderBy("seq").collect()]
    assert kinds == ["word_count_changed", "link_count_changed"]
    found = diff_loss(old, new, LIMITS)
    assert sorted(r.rule_id for r in found.collect()) == ["CC-DIFF-LOSS-CONTENT"] * 2 + ["CC-DIFF-LOSS-INDEXABLE"] * 3 + ["CC-DIFF-LOSS-LINKS"]
    assert found.where("url = '(site-wide)'").head().detail == "33.3% loss"
    head = diff.counts(old, new).head()
    assert (head.lost, head.gained, head.changed, head.delta) == (2, 1, 1, -1)


def test_new_findings(spark):
    en = lambda *langs: rows(spark, {"url": "https://a.test/", "http_status": 200, "hreflang": [{"lang": x, "url": f"https://a.test/{x}"} for x in langs]})
    only = [f for f in FAMILIES if f.__name__ == "hreflang_reciprocal"]
    marked = findings.mark_new(findings.run_rules(en("es", "fr"), tuple(only)), findings.run_rules(en("es"), tuple(only)))
    assert {(r.rule_id[-3:], r.declared, r.is_new) for r in marked.collect()} == {("002", None, False), ("001", "hreflang: es → https://a.test/es", False), ("001", "hreflang: fr → https://a.test/fr", True)}
    assert findings.gate(marked, ["error"], only_new=True) and not findings.gate(marked, ["info"])


def test_snapshot_round_trip(spark, tmp_path):
    site = scan(spark, tmp_path / "site", GOOD)
    text = snapshot.to_json(site).head()[0]
    (tmp_path / "s.json").write_text(text)
    back = snapshot.read_json(spark, str(tmp_path / "s.json"))
    assert back.state.count() == 3 and ids(back) == []
    snapshot.write_table(site, str(tmp_path / "table"))
    table = snapshot.read_table(spark, str(tmp_path / "table"))
    assert table.state.count() == 3 and (table.base_url, table.scanned_at) == (site.base_url, site.scanned_at) and ids(table) == []
    site.state.limit(2).write.mode("overwrite").parquet(str(tmp_path / "table" / "states"))
    with pytest.raises(ValueError):
        snapshot.read_table(spark, str(tmp_path / "table"))
    data = json.loads(text)
    data["statistics"]["total_urls"] = 9
    (tmp_path / "t.json").write_text(json.dumps(data))
    with pytest.raises(ValueError):
        snapshot.read_json(spark, str(tmp_path / "t.json"))
    data["version"] = "0.9"
    (tmp_path / "v.json").write_text(json.dumps(data))
    with pytest.raises(ValueError):
        snapshot.read_json(spark, str(tmp_path / "v.json"))


def test_reports(spark, tmp_path, monkeypatch):
    old = scan(spark, tmp_path / "old", GOOD)
    new = scan(spark, tmp_path / "new", {k: v for k, v in GOOD.items() if not k.startswith("blog")} | {"x.html": PAGE.format("/x", "", "")})
    marked = findings.mark_new(findings.run_rules(new), findings.run_rules(old))
    items, d = reports.rows_of(marked), reports.diff_of(old, new)
    data = json.loads(reports.to_json("scan", items, new, d))
    assert data["summary"]["new"] == len(items) > 0 and data["diff"]["gained_urls"] == ["https://example.test/x"]
    sarif = json.loads(reports.to_sarif(items))["runs"][0]
    assert len(sarif["results"]) == len(items) and {r["id"] for r in sarif["tool"]["driver"]["rules"]} == {f["rule_id"] for f in items}
    assert "## Findings by rule" in reports.to_markdown(items, new, d) and "are new against" in reports.to_text(items, new, d)
    assert "Nothing to report" in reports.to_markdown([], old) and reports.finding_text(items[0])
    reports.write_findings(marked, str(tmp_path / "findings"))
    assert [r.rule_id for r in spark.read.json(str(tmp_path / "findings")).collect()] and spark.read.json(str(tmp_path / "findings")).count() == len(items)
    monkeypatch.setattr(reports, "MOST", len(items) - 1)
    with pytest.raises(ValueError, match="write_findings"):
        reports.rows_of(marked)


def test_sitemap_errors(spark):
    frame = lambda body: spark.createDataFrame([("s.xml", body)], "path string, body string")
    for bad in ("<other/>", "<urlset><url></url></urlset>", "<urlset><url><loc>no url</loc></url></urlset>", "<urlset>"):
        with pytest.raises(Exception):
            sitemap.locations(frame(bad)).collect()
    assert sitemap.locations(frame("<urlset/>")).count() == 0


def responses(spark, table):
    rows_ = [(u, s, [(k, v) for k, v in h.items()], b) for u, (s, h, b) in table.items()]
    return crawl.replay(spark.createDataFrame(rows_, FETCHES))


HTML = {"Content-Type": "text/html; charset=utf-8"}


def test_crawl(spark):
    site = {
        "https://pre.test/robots.txt": (200, {}, "User-agent: *\nDisallow: /no\nSitemap: https://pre.test/map.xml"), "https://pre.test/map.xml": (200, {}, "<urlset><url><loc>https://pre.test/s</loc></url></urlset>"),
        "https://pre.test/": (200, HTML | {"X-Robots-Tag": "nofollow"}, '<a href="/old">o</a><a href="/no">n</a><a href="https://pre.test/b">b</a>'), "https://pre.test/old": (301, {"Location": "/new"}, None),
        "https://pre.test/new": (200, HTML | {"Link": '<https://pre.test/new>; rel="canonical"'}, "<body>new</body>"), "https://pre.test/b": (404, HTML, None), "https://pre.test/s": (200, HTML, "<body>s</body>"),
    }
    got = crawl.crawl(crawl.Options("https://pre.test/", "https://www.test"), responses(spark, site), spark)
    table = {r.url_key: r for r in got.state.collect()}
    assert table["https://www.test/old"].http_status == 301 and table["https://www.test/old"].redirect_target == "https://www.test/new"
    assert table["https://www.test/new"].is_reachable and table["https://www.test/new"].http_status == 200
    assert table["https://www.test/no"].robots_txt_status == "Blocked" and table["https://www.test/no"].http_status is None
    assert table["https://www.test/b"].http_status == 404 and table["https://www.test/s"].found_in_sitemap and table["https://www.test/"].http_x_robots_tag.nofollow


def test_redirect_rows_of_a_crawl(spark):
    """A hop off the origin belongs to the page that sent it; so does one that comes back."""
    site = {
        "https://a.test/robots.txt": (404, {}, None), "https://a.test/sitemap.xml": (404, {}, None), "https://a.test/": (200, HTML, '<a href="/1">1</a><a href="/5">5</a>'),
        "https://a.test/1": (301, {"Location": "/2"}, None), "https://a.test/2": (302, {"Location": "https://other.test/z"}, None), "https://a.test/5": (301, {"Location": "/6"}, None), "https://a.test/6": (303, {"Location": "/5"}, None),
    }
    got = crawl.crawl(crawl.Options("https://a.test/"), responses(spark, site), spark)
    table = {r.url_key.removeprefix("https://a.test"): (r.http_status, r.redirect_target, r.sources) for r in got.state.collect()}
    assert table == {
        "/": (200, None, ["DirectScan"]), "/1": (301, "https://other.test/z", ["InternalLink", "DirectScan"]), "/2": (302, None, ["Redirect"]),
        "/5": (301, "https://a.test/5", ["InternalLink", "DirectScan"]), "/6": (303, None, ["Redirect"]),
    }


def test_over_http(spark):
    """A server on this machine: statuses, headers, bodies, redirects not followed, a broken answer, a refused connection."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/broken":
                self.wfile.write(b"no status line\r\n\r\n")
                return
            status = {"/": 200, "/old": 302}.get(self.path, 404)
            self.send_response(status)
            self.send_header("Content-Type", "text/html")
            if status == 302:
                self.send_header("Location", "/")
            self.send_header("X-Seen", f"{self.headers['User-Agent']} {self.headers.get('X-Key')}")
            self.end_headers()
            self.wfile.write(b"<body>caf\xc3\xa9</body>")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    home = f"http://127.0.0.1:{server.server_port}"
    try:
        fetch = crawl.over_http(crawl.Options(home + "/", user_agent="me/1", headers={"X-Key": "k"}), timeout=5)
        urls = [home + "/", home + "/old", home + "/none", home + "/broken", "http://127.0.0.1:1/"]
        got = {r.request_url: r for r in fetch(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
        assert [got[u].status for u in urls] == [200, 302, 404, None, None] and got[urls[0]].body == "<body>café</body>" and got[urls[1]].body is None
        assert {h.name: h.value for h in got[urls[1]].headers}["Location"] == "/" and {h.name: h.value for h in got[urls[0]].headers}["X-Seen"] == "me/1 k"
        site = crawl.crawl(crawl.Options(home + "/"), crawl.over_http(crawl.Options(home + "/"), 5), spark)
        assert site.state.head().word_count == 1
    finally:
        server.shutdown()


def test_all_files_of_a_directory(spark, tmp_path):
    """Names that start with an underscore or a dot count, links don't; the directory's own name may occur again below it."""
    top = tmp_path / "site"
    for name in ("index.html", "_posts/a.html", "_c.html", ".well/b.html", "site/d.htm", "e.txt"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("<body>x</body>")
    (top / "link.html").symlink_to(top / "_c.html")
    (tmp_path / "far").mkdir()
    (tmp_path / "far" / "t.html").write_text("x")
    (top / "sub").symlink_to(tmp_path / "far")
    got = sorted(r.relative for r in read_files(spark, str(top) + "/").collect())
    assert got == sorted(["index.html", "_posts/a.html", "_c.html", ".well/b.html", "site/d.htm"]) == sorted(r.relative for r in read_files(spark, f"file://{top}").collect())
    (top / "bad.html").write_bytes(b"\xff")
    with pytest.raises(Exception, match="not UTF-8"):
        read_files(spark, str(top)).collect()


def test_states_of_a_directory(spark, tmp_path):
    for name, text in FILES:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    state = scan_directory(spark, str(tmp_path), "https://a.test").state
    got = [(r.url_key, r.http_status, r.robots_txt_status, r.found_in_sitemap, r.is_reachable, ",".join(sorted(r.sources)), r.word_count) for r in state.collect()]
    assert sorted(got) == sorted(FILE_STATES)


def test_listing_by_levels(spark, tmp_path, monkeypatch):
    """340 folders of five levels, an empty one among them: the rows of a plain walk, without one on the driver."""
    made = [tmp_path]
    for width in (4, 4, 4, 4):
        made += [f / f"{'_' * (k % 2)}n {k}#é" for f in made if len(f.parts) == max(len(x.parts) for x in made) for k in range(width)]
    for n, f in enumerate(made):
        f.mkdir(exist_ok=True)
        for k in range(n % 4):
            (f / f".f{k}?.html").write_text("x")
    want = sorted(os.path.relpath(os.path.join(at, name), tmp_path) for at, _, names in os.walk(tmp_path) for name in names)
    monkeypatch.setattr(os, "scandir", None)
    monkeypatch.setattr(os, "walk", None)
    assert sorted(r.relative for r in list_files(spark, str(tmp_path)).collect()) == want and len(made) == 341
    (tmp_path / "none").mkdir()
    assert list_files(spark, str(tmp_path / "none")).count() == list_files(spark, str(tmp_path / "missing")).count() == 0


def test_two_files_of_one_url(spark, tmp_path):
    """The last file by name gives the columns; what the other links to is discovered all the same."""
    site = scan(spark, tmp_path, {"index.html": link("/a"), "a.htm": "<h1>one</h1>" + link("/old"), "a.html": "<p>one two three</p>"})
    rows = {r["url_key"]: r for r in site.state.collect()}
    assert site.state.count() == len(rows) == 3
    assert rows["https://example.test/a"]["word_count"] == 3 and rows["https://example.test/a"]["heading_count"] == 0
    assert rows["https://example.test/old"]["http_status"] == 404


def test_walk_through_a_page_of_many_links(spark):
    """A hub of 500 links, a cycle and a dead end; edges are dealt out by parts of a page."""
    rows = [("h", [f"p{k}" for k in range(500)]), *((f"p{k}", ["h", "gone"] if k else ["q"]) for k in range(500)), ("q", ["r"]), ("r", []), ("alone", ["h"])]
    state = with_defaults(spark.createDataFrame(rows, "url_key string, internal_links_out array<string>"))
    found = {r["url_key"]: r["depth"] for r in reachable_keys(state, "h").collect()}
    assert found == {"h": 0, "q": 2, "r": 3} | {f"p{k}": 1 for k in range(500)}
    assert reachable_keys(state, "nowhere").count() == 0


def test_words_of_a_body():
    words = lambda html: signals(html, "https://a.test/")[4]
    assert words("<head><title>no no</title></head><body><svg><title>a b</title></svg><p>c</p></body>") == 3
    assert words("<title>no</title><p>one<script>x y</script> two <noscript>z</noscript></p>") == 2
    assert words("<body>one two three<noscript><style>a b</style></noscript></body>") == 3  # raw text, counted and taken off once
    assert words("<body>one two three<template><style>a b</style></template></body>") == 1


def test_crawl_failures(spark):
    base = {"https://a.test/robots.txt": (404, {}, None), "https://a.test/sitemap.xml": (404, {}, None)}
    for page in ((503, HTML, None), (200, {"Content-Type": "text/plain"}, "x")):
        with pytest.raises(RuntimeError):
            crawl.crawl(crawl.Options("https://a.test/"), responses(spark, base | {"https://a.test/": page}), spark)
    linked = base | {"https://a.test/": (200, HTML, '<a href="/x">x</a>')}
    with pytest.raises(RuntimeError, match="failed"):
        crawl.crawl(crawl.Options("https://a.test/"), responses(spark, linked), spark)
    with pytest.raises(RuntimeError, match="budget"):
        crawl.crawl(crawl.Options("https://a.test/", max_pages=1), responses(spark, linked | {"https://a.test/x": (200, HTML, "x")}), spark)


def test_chains(spark):
    rows_ = spark.createDataFrame([(["a", "b", "a"],), (["a", "b"],), ([],)], "c array<string>").select(has_cycle(F.col("c")).alias("x"), last_hop(F.col("c")).alias("y")).collect()
    assert [tuple(r) for r in rows_] == [(True, "a"), (False, "b"), (False, None)]


def test_directives(spark):
    values = ["all,noindex , max-snippet:9,max-snippet:-1", "none", "googlebot: noindex"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(parse_directive("v").alias("d")).select("d.*").collect()
    assert got[0].noindex is True and got[0].max_snippet == 9 and got[1].nofollow is True and got[2].noindex is None
    assert spark.range(1).select(F.lit(1)).count() == 1
