"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitefold.llm import packing, quality, textkernel, token_counts
from sitefold.llm.components import linked_components
from sitefold.llm.line_dedup import dedup_lines
from sitefold.llm.minhash_dedup import near_duplicates
from sitefold.llm.mixing import mix_to_targets
from sitefold.llm.packing import pack_documents
from sitefold.llm.quality import score_quality
from sitefold.llm.substring_dedup import COVER, PERIOD, remove_repeats
from sitefold.llm.token_counts import count_tokens
from sitefold.llm.wordunits import distinct, tokenizer
from sitefold.llm.workspace import Workspace, spread_join
from tests.llm.helpers import LOWER, WORDS, components, deduped_lines, near_copies, repeats

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, key long, component long, o string, h1 int"


def frame(spark, texts):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in texts], SCHEMA).repartition(3)


def vocabulary(rng, n=300):
    return ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 8))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Texts with exact copies, altered copies, shared passages, odd white space and extremes of length."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    make = lambda k: [rng.choice(words) for _ in range(k)]
    passage, texts, base = make(70), {}, make(120)
    for i in range(n):
        w = make(rng.choice([0, 1, 3, 5, 30, 49, 50, 51, 90, 200]))
        kind = rng.randrange(6)
        if kind == 0 and texts:
            w = WORDS.findall(texts[rng.choice(list(texts))])
        elif kind == 1:
            w = [rng.choice(words) if rng.random() < 0.02 * rng.randrange(5) else x for x in base]
        elif kind == 2:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 15) :][: rng.choice([49, 50, 55])]
        texts[i * 3 - 20] = "".join(x + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for x in w)
    texts[1000] = " ".join(make(30_000))
    texts[1001] = "  \n\t "
    texts[1002] = texts[1000].upper()
    return texts


@given(st.lists(st.text(alphabet=" \n\tabCé\x85\u3000.", max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    raw, at = textkernel.text_bytes(pa.array([*texts, None], pa.string()))
    starts, ends, first = textkernel.word_spans(raw, at)
    data = raw.tobytes()
    got = [[data[s:e].decode() for s, e in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [WORDS.findall(t) for t in [*texts, ""]]
    hashed = textkernel.word_hashes(raw, starts, ends, lower=True)
    by_word = {}
    for h, s, e in zip(hashed.tolist(), starts, ends, strict=True):
        by_word.setdefault(h, set()).add(data[s:e].decode().translate(LOWER))
    assert all(len(x) == 1 for x in by_word.values())


def test_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = corpus(seed)
    sets, component = near_copies(texts)
    rows = [*texts.items(), (None, "a b c d e"), (2000, None), (2001, ""), (-20, texts[-20])]
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (len(sets.get(r.doc_id, ())), component.get(r.doc_id, r.doc_id)) and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_many_altered_copies(spark):
    """A group in which many differ from the middle by more than a link allows, and none of which is lost."""
    rng = random.Random(5)
    words = vocabulary(rng, 4000)
    base = [rng.choice(words) for _ in range(150)]
    texts = {i: " ".join(rng.choice(words) if rng.random() < (i % 8) / 80 else x for x in base) for i in range(240)}
    _, component = near_copies(texts)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts.items())).collect()}
    assert got == component and 20 < len(set(got.values())) < 230


def test_near_duplicates_write_few_tables(spark, monkeypatch):
    """What a run costs on many small partitions is its shuffles and files: links are confirmed at once, their components found once."""
    rng = random.Random(5)
    words = vocabulary(rng, 4000)
    base = [rng.choice(words) for _ in range(150)]
    texts = {i: " ".join(rng.choice(words) if rng.random() < (i % 8) / 80 else x for x in base) for i in range(240)}
    _, component = near_copies(texts)
    written, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, frame, name, *by: written.append(name) or write(self, frame, name, *by))
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts.items())).collect()}
    assert got == component and "rest" in written and len(written) <= 12


@pytest.mark.parametrize("shape", ["path", "star of stars", "random", "loops only", "none"])
def test_linked_components(spark, shape):
    rng = random.Random(shape)
    ids = rng.sample(range(-500, 500), 300)
    pairs = {
        "path": list(zip(ids[:-1], ids[1:], strict=True)) + [(600 + k, 601 + k) for k in range(70)],
        "star of stars": [(ids[k // 17], ids[k]) for k in range(1, 300)],
        "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(200)],
        "loops only": [(5, 5)],
        "none": [],
    }[shape]
    edges = spark.createDataFrame(pairs + pairs[:3] + [(b, a) for a, b in pairs[:5]], "a long, b long").repartition(3)
    got = {r.node: r.component for r in linked_components(edges, len(pairs), Workspace(spark, "test"), "labels").collect()}
    nodes = {x for pair in pairs for x in pair if pair[0] != pair[1]}
    assert got == components(nodes, [p for p in pairs if p[0] != p[1]])


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    texts = corpus(seed)
    want = repeats(texts)
    rows = [*texts.items(), (None, texts[1000]), (2000, None), (2001, ""), (1000, texts[1000])]
    got = remove_repeats(frame(spark, rows), with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, kept = want.get(r.doc_id, (0, 0, "") if r.doc_id else (30_000, 0, " ".join(WORDS.findall(texts[1000]))))
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
        assert r.kept_text is None or r.kept_text == kept
    assert sum(r.n_removed for r in got) > 500


def test_lines(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([16, 17, 30, 64, 129, 300, 900, 3000]))) for _ in range(25)]

    def edit(s):
        k, c, m = rng.randrange(len(s)), rng.choice("xyzé"), rng.randrange(3)
        return s[:k] + c + s[k + 1 :] if m == 0 else s[:k] + s[k + 1 :] if m == 1 else s[:k] + c + s[k:]

    texts = {}
    for i in range(-10, 50):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                s = edit(s)
            lines.append(rng.choice([s, s.upper(), "  " + s + "\r", "", "short"]))
        texts[i] = "\n".join(lines)
    want = deduped_lines(texts)
    rows = [*texts.items(), (None, base[0]), (2000, None), (2001, ""), (-10, texts[-10])]
    got = dedup_lines(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in want:
            assert (r.kept_text, r.n_removed) == want[r.doc_id] and r.n_lines == texts[r.doc_id].count("\n") + 1
        else:
            assert r.n_removed == 0 and r.kept_text == {None: base[0], 2000: None, 2001: ""}[r.doc_id] and r.n_lines == (r.doc_id != 2000)
    assert sum(r.n_removed for r in got) > 20


def test_lines_of_letters_of_many_bytes(spark):
    """An earlier line that has the same bytes at both ends, but differs between them, hides no partner."""
    accents = "é" * 12
    texts = {1: accents + "zyxwvutsrqp" + "mnopqrstu", 2: accents + "abcdefghijk" + "mnopqrstu", 3: accents + "abcdefghijk" + "mnop7rstu"}
    rng = random.Random(8)
    for k in range(60):
        head, tail = ("".join(rng.choice("éЖ日🙂a") for _ in range(rng.randint(4, 30))) for _ in range(2))
        for variant in range(5):
            middle = [*"".join(rng.choice("日bЖ") for _ in range(12))] if variant % 2 == 0 else middle.copy()
            if variant % 2:
                middle[rng.randrange(12)] = rng.choice("xé🙂")
            texts[10 + 5 * k + variant] = head + "".join(middle) + tail
    texts[900] = "ß日" * 3000 + "x" + "é" * 3000
    texts[901] = "ß日" * 3000 + "é" * 3000
    want = deduped_lines(texts)
    assert want[3][1] == 1 and want[901][1] == 1 and sum(n for _, n in want.values()) > 100
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in dedup_lines(frame(spark, texts.items())).collect()}
    assert got == want


ODD = ["a", " ", "  ", "\n", "é", "日本", "'s", "<|endoftext|>", "12", "!!", "\t", "\xa0", "x" * 40, "\u0301", "🙂", "Σ", "\x1c", "İ", "ß", ", ", "The ", ". ", "\r\n", "\u200b"]


def odd_texts(n=1500):
    rng = random.Random(7)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_long_encoding_is_that_of_the_whole():
    t = tokenizer(public_tokenizers.path(token_counts.TOKENIZER))
    path = public_tokenizers.path(token_counts.TOKENIZER)
    pieces, calls = token_counts.PieceCounts(path), []
    texts = odd_texts(150) + ["x" * 3000, " " * 500, "ab " * 800, "a" + " " * 300 + "b", "one two\nthree four, five" * 50, "Ж ж\nё " * 90 + "й"]
    for x in texts:
        for chunk, overlap in ((16, 4), (50, 3), (200, 20)):
            ids, raw = t.encode(x * 3, add_special_tokens=False).ids, np.frombuffer((x * 3).encode(), np.uint8)
            assert token_counts.encode_long(raw, token_counts.by_library(raw, path), chunk, overlap).tolist() == ids
            assert token_counts.encode_long(raw, token_counts.by_words(raw, pieces, path), chunk, overlap).sum() == len(ids)
    raw = np.frombuffer(b"two  spaces, then words.\n" * 400, np.uint8)
    encode = token_counts.by_library(raw, path)
    assert token_counts.encode_long(raw, lambda a, b: (calls.append(b - a), encode(a, b))[1], 1000, 64).tolist() == t.encode(raw.tobytes().decode()).ids
    assert 10 <= len(calls) <= 12 and max(calls) < 1100


def test_token_counts(spark):
    t = tokenizer(public_tokenizers.path(token_counts.TOKENIZER))
    texts = [*odd_texts(), " ".join(["word"] * 40_000), "plain words, with marks. And lines\nof text!"]
    rows = [*enumerate(texts), (None, None), (0, texts[0])]
    got = count_tokens(frame(spark, rows), chunk=700, overlap=16).collect()
    assert len(got) == len(rows)
    for r in got:
        x = "" if r.doc_id is None else texts[r.doc_id]
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(x.encode()), n, n > 512) and (r.n_chunks > 1) == (len(x.encode()) > 700)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")
def test_long_documents_are_spliced():
    """Every text over one chunk is encoded in chunks, whatever stands beside it; all counts are the library's."""
    path = public_tokenizers.path(token_counts.TOKENIZER)
    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()
    raw, at = textkernel.text_bytes(pa.array(texts, pa.string()))
    n_tokens, n_chunks = token_counts.counts(raw, at, path)
    sizes = np.diff(at)
    assert (sizes > token_counts.CHUNK).sum() > 300 and (n_chunks > 1).tolist() == (sizes > token_counts.CHUNK).tolist() and (n_chunks >= sizes / token_counts.CHUNK).all()
    want = tokenizer(path).encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert n_tokens.tolist() == [len(x.ids) for x in want]


def _long_lines():
    """Texts without white space: base64, minified code, a data address, Chinese with and without marks, one letter."""
    rng = random.Random(8)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    han = [chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(500)]
    return {
        "base64": "".join(rng.choices(signs, k=300_000)), "code": "".join(rng.choices(["function(a,b){", "return", "x1", ";", "}", "'s", "<|endoftext|>", "<|", "don't", "=>"], k=40_000)),
        "address": "data:image/png;base64," + "".join(rng.choices(signs, k=50_000)), "chinese": "".join(rng.choices([*han, *"，。！" * 15], k=60_000)), "marks": "".join(rng.choices("'-_.<>|", k=30_000)),
        "letters": "".join(rng.choices(han, k=20_000)), "one": "a" * 20_000,
    }


@pytest.mark.parametrize("name", sorted(_long_lines()))
def test_long_texts_without_white_space(name):
    """Counts are the library's, and no more than four times the bytes of the text are encoded."""
    path = public_tokenizers.path(token_counts.TOKENIZER)
    text = _long_lines()[name]
    raw = np.frombuffer(text.encode(), np.uint8)
    encode, seen = token_counts.by_words(raw, token_counts.PieceCounts(path), path), []
    got = token_counts.encode_long(raw, lambda a, b: (seen.append(b - a), encode(a, b))[1], free=token_counts.free_bytes(path)).sum()
    assert got == len(tokenizer(path).encode(text, add_special_tokens=False).ids)
    assert sum(seen) < 4 * len(raw) and (name in ("marks", "letters", "one") or max(seen) < 3 * token_counts.CHUNK)


def test_four_megabytes_without_white_space():
    """Linear time, also with nothing certain but the classes of characters."""
    import base64
    import time

    path = public_tokenizers.path(token_counts.TOKENIZER)
    text = base64.b64encode(np.random.default_rng(1).bytes(3 << 20)).decode()
    raw, at = textkernel.text_bytes(pa.array([text]))
    began = time.perf_counter()
    n_tokens, _ = token_counts.counts(raw, at, path)
    assert time.perf_counter() - began < 30 and n_tokens[0] == len(tokenizer(path).encode(text, add_special_tokens=False).ids)


def test_class_edges_are_cuts_of_the_library():
    """Encoding both sides of an edge apart changes nothing, whatever stands around it."""
    path = public_tokenizers.path(token_counts.TOKENIZER)
    t, free, rng = tokenizer(path), token_counts.free_bytes(path), random.Random(9)
    for _ in range(300):
        text = "".join(rng.choices(["a", "Zq", "7", "42", "'", "'s", "'ll", ".", "-", "<", "|", ">", "<|endoftext|>", " ", "\n", "é", "中", "，", "。", "_", "\u3000"], k=12))
        raw = np.frombuffer(text.encode(), np.uint8)
        ids = t.encode(text, add_special_tokens=False).ids
        for k in token_counts.class_edges(raw, np.arange(len(raw)), free).tolist():
            left, right = raw[:k].tobytes().decode(), raw[k:].tobytes().decode()
            assert t.encode(left, add_special_tokens=False).ids + t.encode(right, add_special_tokens=False).ids == ids


def test_equal_hashes_would_not_mix_units():
    """Remembered units are compared by their bytes: as many distinct ones come back as there are."""
    words = [b"a", b"b", b"a", b"", b"ab", b"\xc3\xa9", b"b"]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    codes, units = distinct(raw, ends - [len(w) for w in words], ends)
    assert [units[k] for k in codes] == words


def test_packing(spark):
    t = tokenizer(public_tokenizers.path(packing.TOKENIZER))
    texts = [*odd_texts(400), " ".join(random.Random(1).choices(vocabulary(random.Random(2)), k=9000)), "", "one"]
    rows = [*enumerate(texts), (None, None)]
    got = pack_documents(frame(spark, rows), group=5000, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, packing.END]
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [y for r in mine for y in r.ids] == ids and {r.doc_tokens for r in mine} == {len(ids)}
        assert [r.start for r in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        n = sum(r.length for r in s)
        assert [r.offset for r in s] == [sum(q.length for q in s[:k]) for k in range(len(s))]
        assert n & (n - 1) == 0 and n <= 4096 and {r.tier for r in s} == {n}


def test_pack_prefers_whole_documents():
    packed = packing.pack([4096 * 2 + 3000, 1096, 2048, 2048, 500], tiers=(4096, 2048, 1024, 512))
    assert [(0, 8192, 3000), (1, 0, 1096)] in packed and [(2, 0, 2048)] in packed and [(3, 0, 2048)] in packed
    assert sorted(sum(n for _, _, n in s) for s in packed)[-5:] == [2048, 2048, 4096, 4096, 4096]


def junk(rng, words):
    return rng.choice([lambda: " ".join(w.upper() + "!!" for w in rng.choices(words, k=60)), lambda: " | ".join(rng.choices(words, k=80)), lambda: " ".join([rng.choice(words)] * 80)])()


def test_quality(spark):
    rng = random.Random(4)
    words = vocabulary(rng)
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(4, 14))).capitalize() + "."
    texts, labels = {}, []
    for i in range(600):
        good = rng.random() < 0.7
        texts[i] = "\n".join(sentence() for _ in range(rng.randint(3, 20))) if good else junk(rng, words)
        labels.append((i, int(good)))
    docs = frame(spark, [*texts.items(), (None, "x"), (9000, None), (9001, ""), (9002, "w " * 50_000)])
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 0), (7, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in score_quality(docs, known).collect()}
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in texts) and not got[None].held_out
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out and i != 7]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in score_quality(docs, flipped.where("doc_id <> 7")).collect()}
    base = {r.doc_id: r.score for r in score_quality(docs, known.where("doc_id <> 7 AND quality IS NOT NULL")).collect()}
    assert all(abs(again[k] - base[k]) < 1e-12 for k in again)
    assert {r.score for r in score_quality(docs, known.limit(0)).collect()} == {0.5}


def test_mixing(spark):
    rng = random.Random(6)
    tongues = {k: vocabulary(random.Random(ord(k)), 60) for k in "abc"}
    shares = "a" * 6 + "b" * 3 + "c"
    texts = [(i, " ".join(rng.choices(tongues[shares[i % 10]], k=rng.randint(1, 60)))) for i in range(500)]
    labelled = spark.createDataFrame([(i, shares[i % 10]) for i in range(250)] + [(499, None), (None, "a")], "doc_id long, domain string")
    rows = [*texts, (None, "x"), (900, None), (901, ""), (902, "w " * 20_000)]
    got = mix_to_targets(frame(spark, rows), labelled, {"a": 0.2, "b": 0.3, "c": 0.5}).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[900] == 0
    right = [(r.domain == shares[r.doc_id % 10]) for r in got if r.doc_id is not None and r.doc_id < 500 and r.n_tokens > 5]
    assert sum(right) > 0.97 * len(right)
    mixed = mix_to_targets(frame(spark, texts), labelled, {"a": 0.2, "b": 0.3, "c": 0.5})
    tokens = {r.domain: r.t for r in mixed.groupBy("domain").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("t")).collect()}
    total = sum(tokens.values())
    assert all(abs(tokens[d] / total - w) < 0.03 for d, w in (("a", 0.2), ("b", 0.3), ("c", 0.5)))
    assert {r.rate for r in mix_to_targets(frame(spark, texts[:5]), labelled.limit(0)).collect()} == {1.0}


def test_scores_are_those_of_plain_discriminants(spark):
    """Two Gaussians by determinants and solved systems, from the same statistics; a row that repeats counts twice."""
    rng = random.Random(14)
    words = vocabulary(rng)
    texts = {i: " ".join(rng.choices(words, k=rng.randint(1, 40))) + "." * (i % 3) if i % 4 else junk(rng, words) for i in range(300)}
    labels = {i: int(i % 4 > 0) for i in texts if i % 7}
    rows = [*texts.items(), (8, texts[8])]
    got = {r.doc_id: r.score for r in score_quality(frame(spark, rows), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    x = quality.statistics(*textkernel.text_bytes(pa.array([t for _, t in rows], pa.string())))
    use = [k for k, (i, _) in enumerate(rows) if i in labels and zlib.crc32(str(i).encode()) % 5]
    y, z, d = np.array([labels[rows[k][0]] for k in use]), x[use], x.shape[1]
    parts = [z[y == c] for c in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in parts]
    pooled = np.diag(sum(len(p) * c for p, c in zip(parts, cov, strict=True)) / len(z))

    def density(c, v):
        own = quality.SHRINKAGE + (1 - quality.SHRINKAGE) * d / (d + len(parts[c]))
        s = (1 - own) * cov[c] + own * np.diag(pooled) + quality.FLOOR * np.eye(d)
        gap = v - parts[c].mean(0)
        return np.log(len(parts[c]) / len(z)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * gap @ np.linalg.solve(s, gap)

    for (i, _), v in zip(rows, x, strict=True):
        assert abs(got[i] - 1 / (1 + np.exp(np.clip((density(0, v) - density(1, v)) / quality.TEMPERATURE, -700, 700)))) < 1e-6


def test_rates_are_those_of_brute_force(spark):
    """Naive Bayes memberships and projected gradients in plain Python and NumPy; a repeated row adds its words."""
    rng, d = random.Random(15), 3
    tongues = [vocabulary(random.Random(k), 25) for k in range(d)]
    texts = [(i, " ".join(rng.choices(tongues[i * i % d] + tongues[0][:3], k=rng.randint(0, 50)))) for i in range(120)] + [(7, "a b")]
    labelled = {i: "xyz"[i * i % d] for i in range(0, 120, 2)}
    targets = {"x": 0.3, "y": 0.7, "z": 0.0, "nowhere": 0.2}
    with pytest.warns(UserWarning, match="nowhere"):
        got = {r.doc_id: r for r in mix_to_targets(frame(spark, texts), spark.createDataFrame(list(labelled.items()), "doc_id long, domain string"), targets).collect()}
    bags = {}
    for i, t in texts:
        bags[i] = bags.get(i, []) + t.split()
    distinct_words = sorted({w for b in bags.values() for w in b})
    code = {r.w: r.b for r in spark.createDataFrame([(w,) for w in distinct_words], "w string").selectExpr("w", "pmod(xxhash64(w), 4096) AS b").collect()}
    names = sorted(set(labelled.values()))
    counts = np.zeros((len(names), 4096))
    for i, k in labelled.items():
        for w in bags[i]:
            counts[names.index(k), code[w]] += 1
    weights = np.log((counts + 1) / (counts.sum(1, keepdims=True) + 4096))
    prior = np.log([sum(v == k for v in labelled.values()) / len(labelled) for k in names])
    ids, n = sorted(bags), np.array([len(bags[i]) for i in sorted(bags)], float)
    scores = np.array([sum((weights[:, code[w]] for w in bags[i]), np.zeros(len(names))) * min(24, len(bags[i])) / max(1, len(bags[i])) + prior for i in ids])
    p = np.exp(scores - scores.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    want = np.array([targets[k] for k in names])
    want /= want.sum()
    have, total, rate = (n[:, None] * p).sum(0), n.sum(), np.ones(len(ids))
    root = np.sqrt(total / have)
    step = 1 / np.linalg.eigvalsh(root[:, None] * ((n[:, None] * p).T @ p) / total * root)[-1]
    for _ in range(200):
        gap = ((rate * n)[:, None] * p).sum(0) / total - want
        if np.abs(gap).max() < 1e-5:
            break
        rate = np.maximum(0, rate - p @ (step * root**2 * gap))
    assert [got[i].n_tokens for i in ids] == n.tolist() and np.allclose([got[i].rate for i in ids], rate, atol=1e-6)
    assert np.allclose([got[i].membership for i in ids], p.max(1), atol=1e-9)


def test_samples_of_labelled_documents_keep_rare_domains(spark):
    texts = [(i, "rare words here " * 9 if i == 7 else f"common word{i % 5} " * 9) for i in range(400)]
    labelled = spark.createDataFrame([(i, "rare" if i == 7 else "common") for i in range(400)], "doc_id long, domain string")
    got = {r.doc_id: r.domain for r in mix_to_targets(frame(spark, texts), labelled, {"rare": 0.5, "common": 0.5}, most=20).collect()}
    assert got[7] == "rare" and got[8] == "common"
    many = spark.range(1200).selectExpr("id AS doc_id", "cast(id AS string) AS domain")
    with pytest.raises(ValueError, match="domains"):
        mix_to_targets(frame(spark, texts), many)


def test_repeats_of_a_very_common_passage(spark):
    """A third of all documents share one passage; keys with more than one of a few shares are dealt out."""
    rng = random.Random(16)
    words = vocabulary(rng)
    shared = rng.choices(words, k=60)
    texts = {i: " ".join([*rng.choices(words, k=rng.randint(0, 20)), *(shared if i % 3 == 0 else []), *rng.choices(words, k=5)]) for i in range(90)}
    want = repeats(texts)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(frame(spark, texts.items())).collect()}
    assert got == {i: v[:2] for i, v in want.items()} and sum(v[1] for v in want.values()) > 1500
    left = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 1 ELSE id END AS key", "id")
    counted = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"))
    spread = spread_join(left, counted, F.xxhash64("id"), parts=10)
    assert sorted(map(tuple, spread.select("key", "id", "lo").collect())) == sorted((1 if i < 900 else i, i, 0 if i < 900 else i) for i in range(1000))


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("doc_id = 2")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    domains = spark.createDataFrame([(1, "a")], "doc_id long, domain string")
    for out in (near_duplicates(none), remove_repeats(none), dedup_lines(none), count_tokens(none), pack_documents(none), score_quality(none, labels), mix_to_targets(none, domains)):
        assert out.count() == 0
