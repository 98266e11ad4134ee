"""Removal of passages that an earlier document has, found through difference-cover anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm import textkernel as tk
from sitefold.llm.workspace import Workspace, bound_arrow_batches, spread_join

WINDOW = 50
#: A perfect difference set: every residue modulo PERIOD is a difference of two members. So for any two positions i and j
#: some shift below PERIOD takes both to residues in COVER. Fixed values.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: What words' hashes are changed by before they are hashed again.
AGAIN = np.uint64(0xA0761D6478BD642F)


def _anchor_length(window: int) -> int:
    if window < PERIOD:
        raise ValueError(f"windows need at least {PERIOD} words")
    return window - PERIOD + 1


def _anchored(window: int):
    length, cover = _anchor_length(window), np.array(COVER)

    def run(batches):
        for batch in batches:
            raw, offsets = tk.text_bytes(batch.column(1))
            counts, digests, anchors = [], [], []
            for a, b in tk.row_slices(offsets):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = tk.word_spans(part, at)
                runs = tk.window_hashes(tk.word_hashes(part, starts, ends, lower=False), length, window)
                data = part.tobytes()
                for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    counts.append(j - i)
                    digests.append(hashlib.sha256(b" ".join(data[at[k] : at[k + 1]].split())).hexdigest())
                    if j - i >= window:
                        places = (np.arange(0, j - i, PERIOD)[:, None] + cover).ravel()
                        anchors.append(runs[i + places[places <= j - i - length]])
                    else:
                        anchors.append(runs[:0])
            at = np.concatenate(([0], np.cumsum([len(x) for x in anchors]))).astype(np.int32)
            flat = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))],
                ["doc_id", "n_words", "sha256", "anchors"],
            )

    return run


def _near_anchors(window: int):
    """``(key1, key2, doc, start)`` of the windows that hold a shared anchor within their first PERIOD words: two hashes of 64 bits,
    over words that are hashed twice."""
    cover = np.array(COVER)

    def run(batches):
        for batch in batches:
            raw, offsets = tk.text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(2)
            at, flat = marks.offsets.to_numpy(), marks.values.to_numpy()
            for a, b in tk.row_slices(offsets):
                part = raw[offsets[a] : offsets[b]]
                starts, ends, first = tk.word_spans(part, offsets[a : b + 1] - offsets[a])
                words = tk.word_hashes(part, starts, ends, lower=False)
                runs = [tk.window_hashes(w, window, window) for w in (words, tk.mix(words ^ AGAIN))]
                keys, again, docs, begins = [], [], [], []
                for k in range(a, b):
                    i, n = first[k - a], first[k - a + 1] - first[k - a] - window + 1
                    if n <= 0:
                        continue
                    index = flat[at[k] : at[k + 1]]
                    place = index // len(COVER) * PERIOD + cover[index % len(COVER)]
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, np.clip(place - PERIOD + 1, 0, n), 1)
                    np.add.at(edges, np.clip(place + 1, 0, n), -1)
                    near = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                    keys.append(runs[0][i + near])
                    again.append(runs[1][i + near])
                    begins.append(near)
                    docs.append(np.full(len(near), ids[k]))
                if keys:
                    both = [pa.array(np.concatenate(x).view(np.int64)) for x in (keys, again)]
                    yield pa.RecordBatch.from_arrays([*both, pa.array(np.concatenate(docs).astype(np.int64)), pa.array(np.concatenate(begins).astype(np.int32))], ["key1", "key2", "doc", "start"])

    return run


def _without(window: int):
    def run(batches):
        for batch in batches:
            starts = batch.column(2)
            removed, digests, texts = [], [], []
            for text, begins in zip(batch.column(1).cast(pa.binary()), starts, strict=True):
                words = (text.as_py() or b"").split()
                edges = np.zeros(len(words) + 1, np.int64)
                for x in begins.as_py():
                    if x + window <= len(words):
                        edges[x] += 1
                        edges[x + window] -= 1
                covered = np.cumsum(edges[:-1]) > 0
                kept = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_removed", "changed_sha256", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row per input row; ``kept_text`` too where asked for and changed.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. Runs of ``window - PERIOD + 1`` words are hashed at cover positions only: equal windows share
    an anchor at the same place, whatever their positions. Anchors of one document only are dropped; the rest are
    extended to the whole windows around them, and the smallest doc_id of each window's hash (128 bits) decides. Both
    steps are partial minima, so passages that very many documents share cost one row a task and key, and where rows are joined
    with these minima a common key is dealt out over many tasks. A document with the
    words of an earlier one loses all of them and takes no further part.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, case kept. Null texts have no words. Rows with a null doc_id
    lose nothing and make no other lose. Rows that repeat a doc_id are taken for copies of one row: they don't remove each
    other's words and get the same result. Texts of fewer words than a window are kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "repeats")
    bound_arrow_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = space.write(texts.mapInArrow(_anchored(window), "doc_id long, n_words long, sha256 string, anchors array<long>"), "anchors")
    same = base.where(f"n_words >= {window}").groupBy("sha256").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    copies = space.write(base.select("doc_id", "sha256").join(same, "sha256").where("doc_id > lo").select("doc_id").distinct(), "copies")
    anchors = (
        base.where("doc_id IS NOT NULL AND size(anchors) > 0").select("doc_id", "anchors").join(copies, "doc_id", "left_anti")
        .select("doc_id", F.posexplode("anchors").alias("place", "key"))
    )
    shared = space.write(anchors.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n"), "shared")
    marks = space.write(spread_join(anchors, shared, F.xxhash64("doc_id", "place")).groupBy("doc_id").agg(F.collect_list("place").alias("places")), "marks")
    near = space.write(texts.join(marks, "doc_id").select("doc_id", "text", "places"), "near")
    windows = near.mapInArrow(_near_anchors(window), "key1 long, key2 long, doc long, start int").select(F.struct("key1", "key2").alias("key"), "doc", "start")
    first = space.write(windows.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "lo", "n"), "first")
    repeats = spread_join(windows, first, F.xxhash64("doc", "start")).where("doc > lo").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("start").alias("starts"))
    repeats = space.write(repeats, "repeats")
    space.drop("marks", "shared", "first")
    changed = (
        near.select("doc_id", "text").join(repeats, "doc_id").select("doc_id", "text", "starts")
        .mapInArrow(_without(window), "doc_id long, n_removed long, changed_sha256 string, kept_text string")
    )
    changed = (changed if with_text else changed.drop("kept_text")).dropDuplicates(["doc_id"])
    out = base.select("doc_id", "n_words", "sha256").join(changed, "doc_id", "left").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    columns = [
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("changed_sha256", "sha256")).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))
