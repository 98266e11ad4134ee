"""Broken markup as browsers read it; expectations follow the HTML standard."""

import random
import time

import pytest

from sitefold.sources.html import signals
from sitefold.sources.html_tree import Reader

BASE = "https://a.test/"


def links(html):
    return [x.removeprefix(BASE) for x in signals(html, BASE)[3]]


@pytest.mark.parametrize("html,words", [
    # an ignored end tag leaves one text node, an element or a comment makes two
    ("<body>foo</i>bar", 1), ("<body>foo<b></b>bar", 2), ("<body>foo<!-- x -->bar", 2), ("<p>a<b>b</b>c", 3), ("foo</>bar", 1), ("foo</ x>bar", 2), ("<p>foo</section>bar", 1), ("<p>foo</p>bar", 2), ("foo</p>bar", 2), ("foo</br>bar", 2),
    # only what a body holds counts
    ("", 0), ("<title>a b</title>", 0), ("<head>a</head>", 1), ("<title>a b</title>c", 1), ("<body><title>a b</title>c", 3), ("<html><head><p>a</head>b", 1), ("</body>a</body>b", 1), ("<body>a</body></html>b", 1), ("<body>a<body>b", 1),
    # text in a table comes before it, as one node with the text there
    ("<body>a<table>b<tr>c<td>d</td>e</tr>f</table>g", 3), ("<table>a<tr><td>b", 2), ("<table><tr>a<b>b</b>c", 3), ("<table> <tr> <td>a </td> </tr></table>", 1), ("<table><td>a<td>b<tr><td>c</table>d", 4), ("<table><caption>a<tr><td>b", 2),
    # raw text: what looks like tags is text
    ("<body><textarea><p>a b</textarea>c", 3), ("<body><script>a </p> b</script>c", 1), ("<body><script><!-- <script> a </script> b --></script>c", 1), ("<body>a<script>b c", 1), ("<body><iframe><b>a</b></iframe>b", 2),
    ("<body><xmp><b>a b</xmp>", 2), ("<body><plaintext>a</plaintext> b", 2), ("<body><style>a</styl> b</style>c", 1), ("<body>a<noscript><p>b c</p></noscript>", 1),
    # skipped elements count off once for each; templates too
    ("<body>a<template>b<p>c</template>d", 2), ("<body>a b c<template><style>x</style></template>", 2), ("<svg><style>a b</style></svg>c", 1), ("<svg><title>a b</title></svg>c", 3),
    # no body beside frames
    ("<frameset><frame></frameset><noframes>a</noframes>b", 0), ("<div><frameset>a", 0), ("x<frameset>a", 1),
    # references, and a "<" that opens nothing
    ("<body>a&nbsp;b &lt;c&gt; d&notit;", 4), ("<body>a < b<c", 3), ("<body>a <1 b", 3), ("<body>a<", 1), ("<body>a</", 1), ("<body>a<![CDATA[b]]>c", 2), ("<svg><![CDATA[a b]]></svg>", 2), ("<body>a<p title='b c>d", 1), ("<body>a b　c", 3),
    # formatting elements are opened again around blocks
    ("<b>a<p>b</b>c</p>d", 4), ("<a>x<div>y</a>z</div>w", 4), ("<p><b>a<p>b</b>c", 3), ("<select>a<option>b<p>c<option>d</select>e", 4),
])
def test_words(html, words):
    assert Reader(html).words == words


@pytest.mark.parametrize("html,want", [
    ("<a href=/1>x<a href=/2>y", ["1", "2"]), ("<noscript><a href=/1>x</a></noscript><a href=/2>", ["2"]), ("<textarea><a href=/1></textarea>", []), ("<!-- <a href=/1> --><a href=/2>", ["2"]), ("<!--><a href=/1>", ["1"]),
    ("<select><a href=/1></select><a href=/2>", ["2"]), ("<template><a href=/1></template>", ["1"]), ("<a href=/1 href=/2>", ["1"]), ("<a HREF = '/1'>", ["1"]), ("<a/href=/1/>", ["1/"]), ("<a href=\"/1?a=1&copy=2&amp;b\">", ["1?a=1&copy=2&b"]),
    ("<a href>x", [""]), ("<a name=x>", []), ("<table><a href=/1>x<tr><td><a href=/2>", ["1", "2"]), ("<a href='/1>x", []), ("<title><a href=/1></title>", []), ("<svg><a href=/1></svg>", ["1"]), ("<script>'<a href=/1>'</script>", []),
])
def test_links(html, want):
    assert links(html) == want


def test_head_and_headings():
    assert signals("<body><link rel=canonical href=/c><meta name=robots content=noindex>", BASE)[:2] == (BASE + "c", ["noindex"])
    assert signals("<noscript><meta name=robots content=noindex></noscript>", BASE)[1] == []
    assert signals("<title><link rel=canonical href=/c></title><link rel=canonical href=/d>", BASE)[0] == BASE + "d"
    assert signals("<h1>a<h2>b</h3><h7>c<svg><h3>d</svg><h4/>", BASE)[5] == 4
    assert [n for n, _ in Reader("<table><td>a<col>").elements] == ["html", "head", "body", "table", "tbody", "tr", "td", "colgroup", "col"]
    assert [n for n, _ in Reader("<p>a<ul><li>b<li>c<div>d<li>e").elements] == ["html", "head", "body", "p", "ul", "li", "li", "div", "li"]


def test_any_text_ends():
    """No sequence of tags, well formed or not, makes the reader fail, and words are those of the text nodes at most."""
    tags = "html head body frameset title p a b nobr i div li ul table tr td caption col colgroup tbody select option optgroup form input button template script style noscript textarea svg math mi title foreignobject h1 h2 br image hr ruby rt applet plaintext dd".split()
    rng = random.Random(3)
    for _ in range(6000):
        parts = []
        for _ in range(rng.randrange(24)):
            tag = rng.choice(tags)
            parts.append(rng.choice((f"<{tag}>", f"<{tag} a='1'>", f"</{tag}>", f"<{tag}/>", "w ", "x", " ", "<!--c-->", f"<{tag}", "<![CDATA[y]]>")))
        html = "".join(parts)
        page = Reader(html)
        assert 0 <= page.words <= len(html), html


@pytest.mark.parametrize("unit", ["<div>", "<p>a<b>b", "<b>", "a<i></b>", "<table><tr><td>", "<", "</p>", "<a href=x>", "&amp;", "<!--", "<a b='"])
def test_long_documents(unit):
    # elements that never close are walked through for each tag that looks for one, so time may grow with their depth
    began = time.perf_counter()
    Reader(unit * 8_000)
    assert time.perf_counter() - began < 20
