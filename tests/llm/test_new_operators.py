"""Winnowing, fill-in-middle and Lloyd against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitefold.llm import lloyd, winnowing
from sitefold.llm.fill_in_middle import Arrangement, draws, fill_in_middle, restored
from sitefold.llm.lloyd import cluster_vectors, with_inertia
from sitefold.llm.winnowing import benchmark_hits

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, key long, windows string, n int, items string, form string"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "w", 2, "x", "psm") for i, t in rows], SCHEMA).repartition(3)


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def leaks(docs, items, window=10):
    """``(doc_id, n_words, n_hit, items)`` by comparing every window with every other."""
    by_window = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m and item is not None else 0):
            by_window.setdefault(tuple(w[k : k + m]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in by_window}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in by_window:
                    hit |= set(range(k, k + m))
                    found |= by_window[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def leak_tables(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcé7") for _ in range(rng.randint(1, 3))) for _ in range(40)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, make(rng.choice([1, 2, 4, 5, 6, 9, 10, 11, 14, 30]) if k > 3 else 25)) for k in range(14)]
    items += [(3, make(12)), (20, items[0][1]), (21, items[0][1][5:18]), (None, make(12)), (22, []), (23, ["same"] * 12)]
    docs = []
    for k in range(60):
        w = make(rng.choice([0, 1, 9, 10, 40, 120]))
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1]
            a, at = rng.randint(0, max(0, len(part) - 8)), rng.randint(0, len(w))
            w[at:at] = part[a : a + rng.choice([9, 10, 12, 40])]
        docs.append((k, rng.choice([" ", "\n", ", ", "--"]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    docs += [(0, docs[0][1]), (1, docs[9][1]), (None, docs[3][1]), (None, None), (100, None), (101, ""), (102, " .,\n"), (103, "same " * 30), (104, " ".join(make(20_000)) + " " + " ".join(items[0][1]))]
    return docs, [(i, " ".join(w)) for i, w in items] + [(30, None), (31, "..")]


@pytest.mark.parametrize(("seed", "most_bits"), [(1, winnowing.MOST_BITS), (2, 64)])
def test_leaks_are_those_of_brute_force(spark, seed, most_bits):
    """Also with a filter so full that it lets everything through."""
    docs, items = leak_tables(seed)
    bench = spark.createDataFrame([(i, t, 1, "p") for i, t in items], "item_id long, text string, length int, print string")
    got = benchmark_hits(frame(spark, docs), bench, most_bits=most_bits).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=repr) == leaks(docs, items)
    for r in got:
        if r["spans"]:
            assert len({p for s in r["spans"] for p in range(s["start"], s["start"] + s["length"])}) == r["n_hit"]


def test_every_window_shares_a_fingerprint():
    rng = np.random.default_rng(5)
    passage, around = rng.integers(0, 1 << 62, 10).astype(np.uint64), rng.integers(0, 1 << 62, 500).astype(np.uint64)
    for at in (0, 17, 490):
        text = around.copy()
        text[at : at + 10] = passage
        assert winnowing._fingerprints(text, 10, 5)[at] == winnowing._fingerprints(passage, 10, 5)[0]
    least = winnowing._fingerprints(around, 10, 5)
    assert len(least) == 491 and len(set(least.tolist())) < 0.45 * 491  # about 2 of 7 k-grams are kept


def test_leaks_of_empty_tables(spark):
    docs, bench = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert benchmark_hits(docs, bench).collect() == []
    one = benchmark_hits(frame(spark, [(1, "a b")]), bench).collect()
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in one] == [(1, 2, 0, [])]


def test_a_window_of_very_many_items_and_documents(spark):
    """One prompt in all items and a third of the documents: no pairs of both."""
    prompt = " ".join(f"w{k}" for k in range(10))
    bench = spark.range(300).select(F.col("id").alias("item_id"), F.concat(F.lit(prompt + " "), F.concat_ws(" ", *[F.concat(F.col("id") * 0 + k, F.col("id")) for k in range(9)])).alias("text"))
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, prompt).otherwise("nothing here").alias("text"))
    hits = benchmark_hits(docs, bench)
    assert hits.groupBy("n_hit", F.size("items").alias("k")).count().orderBy("n_hit").collect() == [(0, 0, 600), (10, 300, 300)]


def middle(i, text, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= 90:
        return i, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_middles_are_those_of_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "Z", " ", "\n", "é", "日本", "😀", "<", ">", "<P", "S>", "M", "<S", "\x00", "\\", "$1"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    docs = [*enumerate(texts), (5, "twice"), (5, "twice"), (None, "no id"), (None, None), (-7, "a<M>b"), (1000, None), (1001, ""), (1002, "word " * 60_000), (1003, "日" * 200_000), (1 << 60, "big id")]
    cut = fill_in_middle(frame(spark, docs))
    got = cut.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((middle(i, t) for i, t in docs), key=repr)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in docs)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


def test_middles_of_other_marks_and_no_rows(spark):
    marks = Arrangement("[PRE]", "[SUF]", "[MID]", seed=9, arranged=100, suffix_first=50)
    cut = fill_in_middle(frame(spark, [(k, f"some <P> text {k}") for k in range(50)]), marks=marks)
    back = cut.select("form", restored(F.col("output"), F.col("form"), marks).alias("t")).collect()
    assert {r["form"] for r in back} == {"psm", "spm"} and {r["t"] for r in back} == {f"some <P> text {k}" for k in range(50)}
    assert fill_in_middle(frame(spark, [])).collect() == []
    for wrong in (("", "b", "c"), ("a", "a", "c"), ("ab", "a", "c"), ("<P>", "><", "c")):
        with pytest.raises(ValueError):
            Arrangement(*wrong)
    plan = fill_in_middle(frame(spark, [])).select(*draws(F.lit(1), 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def clustered(rows, clusters=8, rounds=10, dims=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:clusters]
    centroids = [v for _, v in first]

    def assign():
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in kept]
        return found

    for _ in range(rounds):
        near = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near = assign()
    return sorted((i, k, d, sum(e for e, c in near if c == k), sum(e for e, _ in near), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, near, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, label int, distance double").repartition(3)


def test_clusters_are_those_of_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((5, 64))
    rows = [(k, (base[k % 5] + 0.3 * rng.standard_normal(64)).tolist()) for k in range(150)]
    rows += [(k, [1.0] * 64) for k in range(200, 230)]  # copies
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [None] + [1.0] * 63), (304, [float("nan")] * 64), (305, [float("inf")] * 64), (None, [2.0] * 64), (306, [0.0] * 64), (7, rows[7][1])]
    got = with_inertia(*cluster_vectors(vectors(spark, rows))).collect()
    assert sorted(tuple(r) for r in got) == clustered(rows)


def test_large_components_are_exact(spark):
    rows = [(k, [float((k * 37 + d) % 11 - 5) * (2.0**15 if k % 3 else 1.0) for d in range(64)]) for k in range(40)]
    got = with_inertia(*cluster_vectors(vectors(spark, rows))).collect()
    assert sorted(tuple(r) for r in got) == clustered(rows) and max(abs(x) for _, v in rows for x in v) * 1024 > lloyd.NARROW
    with pytest.raises(Exception, match="does not fit"):
        cluster_vectors(vectors(spark, [(k, [2.0 ** (60 if k == 8 else k % 3)] * 64) for k in range(9)]), clusters=2, rounds=1)


def test_few_vectors_and_none(spark):
    few = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [5.0] * 64)]
    assert sorted(tuple(r) for r in with_inertia(*cluster_vectors(vectors(spark, few))).collect()) == clustered(few)
    assert with_inertia(*cluster_vectors(vectors(spark, [(1, None)]))).collect() == []
    assert with_inertia(*cluster_vectors(vectors(spark, []))).collect() == []


@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=12), st.integers(1, 4))
@settings(max_examples=50, deadline=None)
def test_ties_go_to_the_lowest_number(rows, k):
    x = np.array(rows, np.int64)
    for kind in (np.int64, object):
        best, distance = lloyd.nearest(x.astype(kind), x[:k].astype(kind))
        want = [min((int(((a - c) ** 2).sum()), n) for n, c in enumerate(x[:k])) for a in x]
        assert [(int(d), int(b)) for d, b in zip(distance, best, strict=True)] == want
