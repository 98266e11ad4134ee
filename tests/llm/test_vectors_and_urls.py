import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sitefold.llm import vector_dedup
from sitefold.llm.url_filter import fit_weights, judge_urls, labelled_urls, url_buckets
from sitefold.llm.vector_dedup import near_vectors, passes_needed
from sitefold.llm.vector_search import best_of_block, top_inner_products
from tests.llm.helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int, component string, key int"


def vectors(seed=1, n=300, d=16):
    """Vectors with copies, near copies, ties and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.standard_normal(d)
        if i and i % 4 == 0:
            x = np.array(rows[rng.integers(len(rows))][1]) + rng.standard_normal(d) * rng.choice([0, 0.05, 0.2, 0.35])
        rows.append((i * 2 - 50, [float(v) for v in np.float32(x)], int(rng.integers(3))))
    center = rng.standard_normal(d)
    rows += [(2000 + i, [float(v) for v in np.float32(center + rng.standard_normal(d) * 0.02)], 1) for i in range(150)]
    return rows


ODD = [(5001, None, 1), (5002, [], 1), (5003, [0.0] * 16, 1), (5004, [float("nan")] + [1.0] * 15, 1), (5005, [None] + [1.0] * 15, 1), (5006, [1.0] * 16, None), (5007, [float("inf")] + [1.0] * 15, 1), (5008, [1.0] * 3, 1), (None, [1.0] * 16, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("top", [1, 5])
def test_top_products(spark, top):
    rows = vectors()
    x = {i: np.floor(256 * np.array(v, dtype=float)).astype(np.int64) for i, v, _ in rows}
    table = frame(spark, rows + ODD)
    got = {}
    for r in top_inner_products(table, table.where("vec_id % 50 = 0 OR vec_id IS NULL"), top=top).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    x |= {5003: np.zeros(16, np.int64), 5006: np.full(16, 256)}
    for q in [i for i in x if i % 50 == 0]:
        want = sorted(((-int(x[q] @ v), i) for i, v in x.items() if i != q))[:top]
        assert got[q] == {k + 1: (i, -s) for k, (s, i) in enumerate(want)}
    assert set(got) == {i for i in x if i % 50 == 0}


def test_few_candidates_and_other_lengths(spark):
    table = frame(spark, [(0, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (3, [2.0], 1), (100, [4.0], 1)])
    got = {(r.query_id, r.vec_id, r.score) for r in top_inner_products(table, table.where("vec_id % 50 = 0")).collect()}
    assert got == {(0, 50, 65536 * 5), (50, 0, 65536 * 5), (100, 3, 65536 * 8)}
    assert top_inner_products(table.where("vec_id = 9"), table).count() == 0 == top_inner_products(table, table.where("vec_id = 9")).count()


def test_bounds_drop_nothing():
    rng = np.random.default_rng(3)
    scale = np.repeat([300.0, 20.0, 2.0, 1.0], 16)
    q, x = (np.floor(rng.standard_normal((n, 64)) * scale).astype(np.int32) for n in (20, 3000))
    ids, own = np.arange(3000), np.arange(20)
    for k, best in enumerate(best_of_block(q, np.ascontiguousarray(x.T), own, ids, 5)):
        s = x.astype(np.int64) @ q[k]
        want = [i for i in np.lexsort((ids, -s)) if i != k][:5]
        assert best[:, 0].tolist() == want and best[:, 1].tolist() == s[want].tolist()


def test_large_numbers_stay_exact():
    q = np.array([[1 << 27, -(1 << 27) + 1]], np.int32)
    x = np.array([[(1 << 27) - 1, 5], [3, 1 << 27]], np.int32)
    (best,) = best_of_block(q, x, np.array([-1]), np.array([7, 8]), 2)
    assert best[:, 1].tolist() == sorted((int(q[0].astype(object) @ x[:, k].astype(object)) for k in range(2)), reverse=True)


def test_components_of_any_size(spark):
    """Finite vectors of large components take part, exactly; ids repeat as candidates, columns clash."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.standard_normal(4) * 10.0 ** int(rng.integers(0, 7))]) for i in range(0, 60, 5)] + [(100, [2.0**20 + 1, 0.0, 0.0, 0.0]), (3, [2.0**21, 1.0, 0.0, 0.0]), (3, [2.0**21, 1.0, 0.0, 0.0])]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, id int, score int, rank int").repartition(3)
    got = {}
    for r in top_inner_products(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    for q, v in ints:
        if q % 50 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in ints if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, s, i) for k, (s, i) in enumerate(want)]
    assert set(got) == {0, 50, 100}
    huge = spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit into a long"):
        top_inner_products(huge, huge).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_near_vectors(spark, seed):
    rows = vectors(seed)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    degree = {i: 0 for i in unit}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    want = components(unit, links)
    got = near_vectors(frame(spark, rows + ODD + rows[:3]), window=16).collect()
    assert len(got) == len(rows) + len(ODD) + 3 and max(degree.values()) >= 149
    for r in got:
        if r.vec_id in unit:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
        else:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept
    assert near_vectors(frame(spark, rows[:1]).where("vec_id = 1")).count() == 0
    assert passes_needed(1 << 30) > passes_needed(1 << 10) >= 4


def watched(monkeypatch):
    """The choices of bits and passes that calls make."""
    plans, choose = [], vector_dedup._chosen
    monkeypatch.setattr(vector_dedup, "_chosen", lambda *a: (plans.append(choose(*a)), plans[-1])[1])
    return plans


@pytest.mark.parametrize("common", [0.0, 0.5, 0.85])
def test_recall_of_the_passes(spark, monkeypatch, common):
    """Isolated pairs at 0.94, and some right at the threshold, in a label whose vectors have a background cosine: production settings."""
    plans = watched(monkeypatch)
    rng, d = np.random.default_rng(5), 64
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(np.sqrt(common) * unit(rng.standard_normal((1, d))) + np.sqrt(1 - common) * unit(rng.standard_normal((3000, d))))
    off = rng.standard_normal((200, d))
    off = unit(off - (off * x[:200]).sum(1, keepdims=True) * x[:200])
    near = np.where(np.arange(200) % 2 == 0, 0.94, 0.9301)[:, None]
    x = np.concatenate((x, near * x[:200] + np.sqrt(1 - near**2) * off))
    want = (unit(x) @ unit(x).T >= 0.93).sum(1) - 1
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in near_vectors(table).collect()}
    assert plans[0].first().bits > 0 and plans[0].first().passes > 3
    assert want.sum() >= 400 and [got[i] for i in range(len(x))] == want.tolist()


def test_passes_run_on_the_given_vectors(spark, monkeypatch):
    """All given vectors, which have no near copies of their own, with one of every fifth planted: each label has its passes."""
    plans = watched(monkeypatch)
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    labels, x = np.array(table["label"]), np.array(table["embedding"], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = np.random.default_rng(2).standard_normal((len(x[::5]), x.shape[1]))
    off -= (off * x[::5]).sum(1, keepdims=True) * x[::5]
    x, labels = np.concatenate((x, 0.94 * x[::5] + np.sqrt(1 - 0.94**2) * off / np.linalg.norm(off, axis=1, keepdims=True))), np.concatenate((labels, labels[::5]))
    rows = [(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), labels, strict=True))]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    chosen = plans[0].collect()
    assert len(chosen) == 10 and all(r.rows > vector_dedup.WINDOW and r.bits > 0 and r.passes > 3 for r in chosen)
    want = ((x @ x.T >= 0.93) & (labels[:, None] == labels[None])).sum(1) - 1
    assert [got[i] for i in range(len(x))] == want.tolist() and want.sum() >= 800


def test_long_runs_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 32)
    rows = vectors(3)
    rows += [(7000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    want = components(unit, links)
    assert {r.vec_id: r.component_id for r in near_vectors(frame(spark, rows)).collect()} == want


def test_ids_with_different_vectors(spark):
    """The smallest vector of an id counts, wherever it stands."""
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [0.0, 1.0], 2), (4, [0.0, 1.0], 1)]
    for order in (rows, rows[::-1]):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(frame(spark, order)).collect())
        smallest_is_first = np.array([0.0, 1.0]).tobytes() < np.array([1.0, 0.0]).tobytes()
        assert smallest_is_first and got == [(1, 0, 1), (2, 2, 2), (2, 2, 2), (3, 2, 2), (4, 2, 2), (4, 2, 2)]


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
URLS = {
    1: ("https://www.Example.COM/en/12?x#y", "www.example.com", "/en/12", "com/en/", "block"), 2: ("http://example.com/en/7", "example.com", "/en/7", "example.com/en/7", "allow"),
    3: ("https://a.net/de/81", "a.net", "/de/81", "net/de/", "allow"), 4: ("https://m.example.net/de/81", "m.example.net", "/de/81", "example.net/de/8", "block"), 5: ("https://com/en/", "com", "/en/", "com/en/", "block"),
    6: ("https://telecom/en/", "telecom", "/en/", None, None), 7: ("no scheme", "", "", None, None), 8: (None, "", "", None, None), 9: ("", "", "", None, None), 10: ("https://É.org?q=/es/", "É.org", "", None, None),
    11: ("x://y://z/a", "y:", "//z/a", None, None), 12: ("https://h.org/es/" + "a" * 50_000, "h.org", "/es/" + "a" * 50_000, "org/es/", "block"), 13: ("https://\nb.org/\nes", "\nb.org", "/\nes", None, None),
}


def test_urls(spark):
    rows = [(k, v[0], "x", 1) for k, v in URLS.items()] + [(None, "https://a.com/en/", "x", 1), (1, URLS[1][0], "x", 1)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule int"), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            _, host, path, rule, verdict = URLS[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None and r.verdict == ("block" if r.score >= 0.5 else "allow") or r.verdict == verdict)
    many = RULES + [(f"host{k}.test/p", "block") for k in range(300)]
    again = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule int"), many).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_url_model(spark):
    weights, bias = fit_weights(labelled_urls(spark))
    pages = spark.createDataFrame([(1, "https://x.ads-track.test/en/5"), (2, "https://garden.test/en/5"), (3, "https://best-casino.test/de/1"), (4, "https://www.museum.test/fr/3")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(pages, []).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]
    assert len(weights) == 2048 and fit_weights(labelled_urls(spark).limit(0)) == ([0.0] * 2048, 0.0) and isinstance(bias, float)
    table = labelled_urls(spark)
    host = F.regexp_extract("url", r"([a-z-]+[.](test|invalid))/", 1)
    held_hosts = F.pmod(F.xxhash64(host), F.lit(4)) == 1
    held = table.where(held_hosts).collect()
    scored = judge_urls(spark.createDataFrame([(k, x.url) for k, x in enumerate(held)], "page_id long, url string"), [], table.where(~held_hosts)).collect()
    right = [(r.verdict == "block") == bool(held[r.page_id].block) for r in scored]
    assert len(held) > 60 and np.mean(right) > 0.8
    told = [k for k, x in enumerate(held) if not x.url.split("/", 3)[3][:3] in ("", "en/", "de/", "fr/", "es/")]
    assert np.mean([right[[r.page_id for r in scored].index(k)] for k in told]) > 0.85


def test_paths_decide_where_hosts_do_not(spark):
    pages = spark.createDataFrame([(1, "https://somewhere.test/casino/free-spins"), (2, "https://somewhere.test/docs/manual")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(pages, []).orderBy("page_id").collect()] == ["block", "allow"]


def test_weights_are_those_of_brute_force(spark):
    """Plain logistic regression, one row at a time, over n-grams made in Python; odd labelled rows and a sample bound."""
    rows = [("https://a.test/x", 1), ("https://b.test/y", 0), ("https://b.test/y", 0), ("no host", 0), (None, 1), ("https://c.test/", None), ("https://d.test/é", 1)]
    table = spark.createDataFrame(rows, "url string, block int")
    weights, bias = fit_weights(table, rounds=7)
    known = [(u, y) for u, y in rows if u is not None and y is not None]
    grams = set()
    split = {}
    for u, _ in known:
        rest = u.partition("://")[2]
        h = rest.split("/")[0]
        split[u] = [(f"^{t}$"[i : i + n], seed) for seed, t in ((0, h), (1, rest[len(h) :])) for n in (3, 4) for i in range(max(1, len(t) + 3 - n))]
        grams |= set(split[u])
    codes = {(r.g, r.s): r.b for r in spark.createDataFrame(sorted(grams), "g string, s int").selectExpr("g", "s", "cast(pmod(xxhash64(g, s), 1024) AS int) + s * 1024 AS b").collect()}
    w, c = np.zeros(2048), 0.0
    for _ in range(7):
        step, lift = 1e-4 * w, 0.0
        for u, y in known:
            mine = sorted({codes[g] for g in split[u]})
            error = (1 / (1 + np.exp(-(w[mine].sum() / len(mine) ** 0.5 + c))) - y) / len(known)
            step[mine] += error / len(mine) ** 0.5
            lift += error
        w, c = w - 4 * step, c - 4 * lift
    assert np.allclose(weights, w, atol=1e-12) and abs(bias - c) < 1e-12
    many = spark.range(3000).selectExpr("concat('https://h', id, '.test/') AS url", "cast(id % 2 AS int) AS block")
    assert fit_weights(many, rounds=1, most=100) != fit_weights(many, rounds=1)


def test_long_urls_are_read_whole(spark):
    rng = random.Random(4)
    paths = ["/" + "".join(rng.choice("abcdefgh-/é😀") for _ in range(n)) for n in (0, 1, 190, 193, 507, 508, 509, 510, 511, 512, 513, 1500, 5000)]
    got = {r.path: set(r.buckets) for r in url_buckets(spark.createDataFrame([("https://" + "h." * 150 + "test" + p,) for p in paths], "url string")).select("path", F.filter("buckets", lambda b: b >= 1024).alias("buckets")).collect()}
    for path in paths:
        text = f"^{path}$"
        grams = {(text[i : i + n],) for n in (3, 4) for i in range(max(1, len(text) - n + 1))}
        want = {r[0] for r in spark.createDataFrame(sorted(grams), "g string").selectExpr("cast(pmod(xxhash64(g, 1), 1024) AS int) + 1024").collect()}
        assert got[path] == want
    middle = [(k, "https://garden.test/" + "garden/" * 40 + word * 20 + "/garden" * 40) for k, word in enumerate(("casino-win", "cookingpot"))]
    scores = [r.score for r in judge_urls(spark.createDataFrame(middle, "page_id long, url string"), []).orderBy("page_id").collect()]
    assert scores[0] != scores[1]
