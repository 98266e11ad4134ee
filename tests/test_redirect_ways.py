"""Redirects of recorded responses by doubled ways: as a hop-by-hop walk follows them."""

import random

import pytest

from sitefold.schemas import FETCHES
from sitefold.sources import crawl

HOME = "https://a.test"
COLUMNS = ("request_url", "initial_status", "status", "chain", "final_url", "body")


def responses(seed):
    """Redirects at random: chains, circles, self-links, off the origin, fragments, odd locations and statuses, and a long chain."""
    rng, out = random.Random(seed), []
    for k in range(80):
        url = f"{HOME}/{k}"
        kind = rng.randrange(8)
        to = rng.choice([f"/{rng.randrange(90)}", f"{rng.randrange(90)}#f{k % 2}", "https://b.test/x", "http://[", "", None, f"//a.test/{rng.randrange(90)}"])
        html = [{"name": "Content-Type", "value": rng.choice(["text/html; x=y", "text/plain"])}]
        if kind < 5:
            out.append((url, rng.choice([301, 302, 300, 399]), html + ([{"name": "Location", "value": to}] if to is not None else []), None))
        elif kind < 7:
            out.append((url, rng.choice([200, 404]), html, f"<p>{k}"))
    out += [(f"{HOME}/c{k}", 301, [{"name": "location", "value": f"/c{k + 1}"}], None) for k in range(14)]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ways_are_those_of_single_hops(spark, seed, monkeypatch):
    """Also where every end is hot."""
    table = spark.createDataFrame(responses(seed), FETCHES)
    asked = [f"{HOME}/{k}" for k in range(85)] + [f"{HOME}/c0", f"{HOME}/c4", f"{HOME}/c5#x", f"{HOME}/1#y"]
    urls = spark.createDataFrame([(u,) for u in asked], "url string").repartition(3)
    recorded = crawl.replay(table)
    single = crawl.follow(urls, lambda some: recorded(some), HOME, HOME)
    want = sorted(map(str, single.select(*COLUMNS).collect()))
    assert sorted(map(str, crawl.follow(urls, recorded, HOME, HOME).select(*COLUMNS).collect())) == want
    monkeypatch.setattr(crawl, "share_of", lambda total: 2)
    assert sorted(map(str, crawl.follow(urls, crawl.replay(table), HOME, HOME).select(*COLUMNS).collect())) == want


def test_ways_of_no_redirects(spark):
    table = spark.createDataFrame([(HOME + "/", 200, [], "x")], FETCHES)
    urls = spark.createDataFrame([(HOME + "/",), (HOME + "/none",)], "url string")
    got = {r.request_url: (r.status, r.chain, r.final_url) for r in crawl.follow(urls, crawl.replay(table), HOME, HOME).collect()}
    assert got == {HOME + "/": (200, [HOME + "/"], HOME + "/"), HOME + "/none": (None, [HOME + "/none"], HOME + "/none")}
    assert crawl.follow(urls.limit(0), crawl.replay(table), HOME, HOME).collect() == []
