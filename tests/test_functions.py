import pytest

from sitefold.functions.globs import glob_match
from sitefold.functions.robots import specificity
from sitefold.functions.urls import drop_fragment, public_origin, resolve, route_of_file
from sitefold.plans import cases
from sitefold.sources.crawl import parse_headers
from sitefold.sources.html import signals
from sitefold.sources.policy import parse as parse_policy
from sitefold.sources.robots_txt import crawl_delay, parse


@pytest.mark.parametrize("base,ref,want", cases.RESOLVED)
def test_resolve(base, ref, want):
    assert drop_fragment(resolve(base, ref)) == want


@pytest.mark.parametrize("path,url", cases.ROUTES)
def test_routes(path, url):
    assert route_of_file("https://example.test", path) == url


def test_globs():
    assert glob_match("/admin/*", "/admin/x") and not glob_match("/admin/*", "/admin/x/y")
    assert glob_match("/admin/**", "/admin/x/y") and glob_match("/a/**/b", "/a/xb") and glob_match("/a?c", "/abc")


def test_public_origin():
    assert public_origin("https://Example.com/") == "https://example.com"
    for bad in ("ftp://x.test", "https://x.test/a", "https://u@x.test", "https://x.test?q"):
        with pytest.raises(ValueError):
            public_origin(bad)


BODY = """
User-agent: *
Disallow: /all
User-agent: goodbot
User-agent: good
# a comment
Disallow: /private
Allow: /private/open
Crawl-delay: 2
Sitemap: /map.xml
User-agent: empty
User-agent: goodbot
Disallow: /*.pdf$
Crawl-delay: -1
"""


def test_robots_groups():
    got = parse(BODY, "https://a.test/", "GoodBot/2")
    assert got.agent == "goodbot" and got.rules == [("/private", False), ("/private/open", True), ("/*.pdf$", False)]
    assert got.crawl_delay == 2 and got.sitemaps == ["https://a.test/map.xml"]
    assert parse(BODY, "https://a.test/", "good thing").agent == "good"
    assert parse(BODY, "https://a.test/", "other").rules == [("/all", False)]
    assert parse("User-agent: *\nDisallow: /\nUser-agent: me\n", "https://a.test/", "me").rules == []
    assert specificity("/*.pdf$") == 5


def test_crawl_delay():
    got = parse(BODY, "https://a.test/", "goodbot")
    assert crawl_delay(None, got) == 2 and crawl_delay(5, got) == 5 and crawl_delay(None, None) is None
    with pytest.raises(ValueError):
        crawl_delay(61, None)


def test_headers():
    assert parse_headers(["X-A: b: c"]) == {"X-A": "b: c"}
    for bad in ("nothing", ": x", "User-Agent: me"):
        with pytest.raises(ValueError):
            parse_headers([bad])


def test_signals():
    html = """<html><head><title>no words</title><link rel="Alternate" hreflang="en-GB" href="/en#x"><link rel="x CANONICAL" href="/page"><meta name="ROBOTS" content="noindex">
    <style>p{}</style></head><body><h1>One two</h1><p>three <script>no no</script><a href="b?x=1#f">four</a><a href="#a">five</a><a href="mailto:x@y">six</a>
    <a href="https://other.test/">seven</a><a href="b?x=1">b</a></p><h2>end</h2></body></html>"""
    canonical, robots, hreflang, links, words, headings = signals(html, "https://a.test/d/")
    assert canonical == "https://a.test/page" and robots == ["noindex"] and hreflang == [{"lang": "en-GB", "url": "https://a.test/en"}]
    assert links == ["https://a.test/d/b?x=1"] and words == 9 and headings == 2


def test_signals_alias():
    html = '<a href="https://preview.test/x">a</a><link rel="canonical" href="https://preview.test/c">'
    canonical, _, _, links, _, _ = signals(html, "https://www.test/", "https://preview.test")
    assert canonical == "https://www.test/c" and links == ["https://www.test/x"]


def test_policy():
    p = parse_policy('[general]\nfail_on=["Warning"]\npublic_origin="https://x.test"\n[diff]\nmax_word_loss_percent=20\n[[exclusions]]\nrule_id="CC-ORPHAN-001"\nurl_pattern="/a/**"\nreason="r"')
    assert p.fail_on == ["warning"] and p.limits["words"] == 20 and p.limits["links"] == 10 and p.exclusions[0]["url_pattern"] == "/a/**"
    bad = ('[general]\nfail_on=["x"]', "[diff]\nmax_word_loss_percent=101", "[other]\na=1", '[[exclusions]]\nrule_id="NO"\nurl_pattern="/"\nreason="r"',
           '[[exclusions]]\nrule_id="CC-ORPHAN-001"\nurl_pattern="x"\nreason="r"', '[[exclusions]]\nrule_id="CC-ORPHAN-001"\nurl_pattern="/x"\nreason=" "', "[general]\nfail_on=[]")
    for text in bad:
        with pytest.raises(ValueError):
            parse_policy(text)
