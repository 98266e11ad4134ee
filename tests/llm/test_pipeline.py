"""The pipeline's stages against brute force on the smallest table."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitefold.llm.mixing import mix_to_targets
from sitefold.llm.quality import score_quality
from tests.llm.helpers import deduped_lines, near_copies

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rejected = docs.columns, {r.doc_id for r in score_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 0").collect()}
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or out[-1].columns == columns
    table = lambda frame: {r.doc_id: r for r in frame.collect()}
    before, judged, lined, single = (table(x) for x in out[:4])
    assert set(judged) == set(before) - rejected and rejected
    want = {i: t for i, (t, gone) in deduped_lines({i: r.text for i, r in judged.items()}).items() if not gone or t.strip(" \t\r\n")}
    assert {i: r.text for i, r in lined.items()} == want and all(r.n_chars == len(r.text) for r in lined.values())
    _, component = near_copies(want)
    assert set(single) == {i for i, c in component.items() if i == c}
    mixed = [r.doc_id for r in out[4].collect()]
    assert set(mixed) <= set(single) and abs(len(mixed) / len(single) - 1) < 0.25
    pieces = out[5].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == set(mixed)


EXTRA = "removed long, copies string, row int, lines int, kept_text string, component long, copy int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def odd_documents():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(n))
    texts = [text(rng.randint(1, 6)) for _ in range(60)]
    rows = [*enumerate(texts), (100, texts[3]), (101, texts[4] + "\n" + texts[5]), (7, texts[7]), (102, None), (103, ""), (104, " \n"), (None, texts[8]), (None, None), (105, text(4000))]
    return [(i, t, ("en", "de", None)[(i or 0) % 3], None, None if t is None else len(t), 1, "c", 2, 3, "k", 4, 5) for i, t in rows]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, empty and long texts and columns with the names that stages use inside; then an empty table."""
    rows = odd_documents()
    spark.createDataFrame([(i, i % 7 > 0) for i in range(60)], "doc_id long, good boolean").selectExpr("doc_id", "cast(good AS int) AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, frame: stages[name](spark, frame, str(tmp_path))
    seen = lambda frame: sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.copies, r.row) for r in frame.collect()))
    whole = seen(docs)
    judged = run("quality classifier", docs)
    rejected = {r.doc_id for r in score_quality(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).where("predicted = 0").collect()} - {None}
    assert judged.columns == docs.columns and seen(judged) == [r for r in whole if not r[0] or r[1] not in rejected]
    lined = run("line dedup", docs)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    want = {i: t for i, (t, gone) in deduped_lines({i: t for i, t in texts.items() if t is not None}).items() if not gone or t.strip(" \t\r\n")}
    got = lined.collect()
    assert lined.columns == docs.columns and {r.doc_id: r.text for r in got if r.doc_id is not None and r.text is not None} == want
    assert sum(r.doc_id is None for r in got) == 2 and 102 in {r.doc_id for r in got} and sum(r.doc_id == 7 for r in got) == 2 and all(r.text is None or r.n_chars == len(r.text) for r in got)
    single = run("minhash near-dedup", docs)
    _, component = near_copies(texts)
    assert single.columns == docs.columns and seen(single) == [r for r in whole if not r[0] or component[r[1]] == r[1]]
    mixed = run("mixing to target weights", docs)
    chosen = {r.doc_id: r.copies for r in mix_to_targets(docs, spark.createDataFrame([(i, ("en", "de")[i % 3]) for i in range(60) if i % 3 < 2], "doc_id long, domain string")).collect()}
    counted = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert mixed.columns == docs.columns and counted == Counter({(r[0], r[1]): chosen[r[0]] * sum(q[:2] == r[:2] for q in rows) for r in rows if chosen[r[0]]})
    pieces = run("packing", docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("each")).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in rows} and {r.doc_id: r.n // r.each for r in pieces}[7] == 2 and {r.doc_id: r.n for r in pieces}[102] == 1
    for name, stage in stages.items():
        assert stage(spark, docs.where("doc_id = -1"), str(tmp_path)).count() == 0, name


def test_run_is_lazy_only_at_the_end(spark):
    if os.path.isdir(DATA):
        assert corpus_pipeline.run(spark, DATA).columns[:2] == ["doc_id", "start"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "mixing to target weights", "packing"]
