"""Benchmark decontamination by winnowing: fingerprints of both sides are joined, and hits are extended to whole windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm import textkernel as tk
from sitefold.llm.workspace import Workspace, bound_arrow_batches, spread_join

WINDOW = 10
#: Words of a k-gram. Of each window the smallest hash of its k-grams is kept, so every shared window shares a fingerprint.
GRAM = 5
#: Bits for each benchmark fingerprint in the filter that documents are held against, and the most that it may have (16 MiB);
#: a fuller filter lets more windows through to the join, and changes nothing else.
BITS_EACH = 32
MOST_BITS = 1 << 27
#: Bits of one written piece of the filter.
PIECE = 1 << 17
#: Bytes as words see them: A-Z lower-cased, ASCII other than letters and digits as a separator.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = 0x20
_FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)


def _fingerprints(words: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The smallest hash among the k-grams of each window of ``length`` words (rows are not regarded)."""
    k = min(gram, length)
    grams = tk.window_hashes(words, k, length)
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for shift in range(1, length - k + 1):
        np.minimum(least, grams[shift : shift + n], out=least)
    return least


def _rows(column):
    """``(first row, words' hashes, first word of each row, bytes of the words' rows)`` of slices of a text column."""
    raw, offsets = tk.text_bytes(column)
    for a, b in tk.row_slices(offsets):
        part, at = _FOLDED[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = tk.word_spans(part, at)
        yield a, tk.word_hashes(part, starts, ends, lower=False), first, part, at


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _item_windows(window: int, gram: int):
    """``(item_id, length, print, digest)`` of the windows of benchmark items."""

    def run(batches):
        for batch in batches:
            for a, hashes, first, part, at in _rows(batch.column(1)):
                for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    length = min(window, j - i)
                    if not length:
                        continue
                    words = part[at[k] : at[k + 1]].tobytes().split()
                    prints = _fingerprints(hashes[i:j], length, gram)
                    digests = [_digest(words[s : s + length]) for s in range(len(prints))]
                    n = len(prints)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a + k, 1).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, length, np.int32)), pa.array(prints.view(np.int64)), pa.array(digests, pa.binary())],
                        ["item_id", "length", "print", "digest"],
                    )

    return run


def _candidates(lengths: list[int], gram: int, held, bits: int):
    """Per document: its number of words, and the windows whose fingerprint the filter knows."""
    window_type = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("print", pa.int64()), ("digest", pa.binary())])

    def run(batches):
        known = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            counts, at_windows, starts, sizes, prints, digests = [], [0], [], [], [], []
            for _, hashes, first, part, at in _rows(batch.column(3)):
                passed = []
                for length in lengths:
                    least = _fingerprints(hashes, length, gram)
                    place = least & np.uint64(bits - 1)
                    inside = np.flatnonzero(known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    row = np.searchsorted(first, inside, "right") - 1
                    whole = inside + length <= first[row + 1]
                    passed.append((inside[whole], row[whole], np.full(int(whole.sum()), length), least[inside[whole]]))
                where, rows, size, least = (np.concatenate([p[k] for p in passed] or [np.zeros(0, np.int64)]) for k in range(4))
                order = np.argsort(rows, kind="stable")
                where, rows, size, least = where[order], rows[order], size[order], least[order]
                edges = np.searchsorted(rows, np.arange(len(at)))
                counts.extend(np.diff(first).tolist())
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    words = part[at[k] : at[k + 1]].tobytes().split()
                    for n in range(edges[k], edges[k + 1]):
                        s = int(where[n] - first[k])
                        digests.append(_digest(words[s : s + int(size[n])]))
                starts.append(where - first[rows])
                sizes.append(size)
                prints.append(least)
                at_windows.extend((at_windows[-1] + edges[1:]).tolist())
            flat = [np.concatenate(x or [np.zeros(0, np.int64)]) for x in (starts, sizes, prints)]
            windows = pa.StructArray.from_arrays(
                [pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.uint64).view(np.int64)), pa.array(digests, pa.binary())], fields=list(window_type)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(at_windows, pa.int32()), windows)],
                ["doc_id", "key1", "key2", "n_words", "windows"],
            )

    return run


def _filter(prints: DataFrame, most: int) -> tuple[bytearray, int]:
    """A bit for each fingerprint, put together from written pieces of bounded size, so the driver never sees fingerprints."""
    n = prints.count()
    bits = min(max(1 << max(BITS_EACH * n - 1, 1).bit_length(), 64), most)
    width = min(bits, PIECE)
    places = prints.select(F.col("print").bitwiseAND(F.lit(bits - 1)).alias("place")).distinct()

    def piece(table: pa.Table) -> pa.Table:
        place = table["place"].to_numpy()
        some = np.zeros(width, np.uint8)
        some[place % width] = 1
        return pa.table({"piece": [int(place[0] // width)], "some": pa.array([np.packbits(some, bitorder="little").tobytes()], pa.binary())})

    pieces = places.groupBy(F.floor(F.col("place") / width)).applyInArrow(piece, "piece long, some binary").collect()
    known = bytearray(bits // 8)
    for r in pieces:
        known[r["piece"] * width // 8 : (r["piece"] + 1) * width // 8] = r["some"]
    return known, bits


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, spans, items)``, one row per document: words that occur in the benchmark, where, and in which items.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. Each window keeps the smallest
    hash of its k-grams (``gram`` words) as its fingerprint. The k-grams of a window decide alone, so a window that occurs in
    a document has the same fingerprint there: every shared span of a window's length is found. Documents are read once: their
    fingerprints are held against a bit filter of the benchmark's (at most ``most_bits``, however large the benchmark), and
    those that pass go with the SHA-256 of their window's words to an equi-join with the benchmark's windows, by fingerprint and
    words. Adjacent windows make up longer spans. Benchmark windows are distinct on their side; a window that very many
    documents have is dealt out over many tasks. Windows with the same set of items share one id, and item lists are made
    once for each distinct set of such ids, so no pairs of documents and items are made.

    ``spans`` are ``(start, length)`` of windows in words, ``items`` the ids of items with occurring windows as strings, sorted.
    Words are runs of ASCII letters and digits and of all other non-ASCII characters, with A-Z lower-cased. Null and empty texts
    have no words; items without words or with a null id take no part, and items that repeat an id are one item with the windows
    of all its texts. Rows that repeat a doc_id, or have none, are judged each by its own text. Other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "winnowing")
    bound_arrow_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id IS NOT NULL")
    posted = space.write(items.mapInArrow(_item_windows(window, gram), "item_id string, length int, print long, digest binary").distinct(), "posted")
    # windows with the same items share one set: its size and two order-free hashes of its members name it
    member = [F.count(F.lit(1)).cast("string"), *[F.bit_xor(F.xxhash64(F.lit(k), "item_id")).cast("string") for k in (1, 2)]]
    windows = space.write(posted.groupBy("length", "print", "digest").agg(F.concat_ws("/", *member).alias("items_of")), "windows")
    members = windows.groupBy("items_of").agg(F.min(F.struct("length", "print", "digest")).alias("w")).select("items_of", "w.*")
    members = space.write(posted.join(members, ["length", "print", "digest"]).select("items_of", "item_id"), "members")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    known, bits = _filter(windows.select("print"), most_bits)
    held = spark.sparkContext.broadcast(bytes(known))
    doc = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = doc.select("doc_id", F.xxhash64("doc_id", "text").alias("key1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("key2"), "text")
    found = "doc_id long, key1 long, key2 long, n_words long, windows array<struct<start: int, length: int, print: long, digest: binary>>"
    base = space.write(keyed.mapInArrow(_candidates(lengths, gram, held, bits), found), "documents")
    asked = base.where("size(windows) > 0").select("key1", "key2", F.explode("windows").alias("w")).select("key1", "key2", "w.start", F.struct("w.length", "w.print", "w.digest").alias("key"))
    counted = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(windows.select(F.struct("length", "print", "digest").alias("key"), "items_of"), "key")
    hits = spread_join(asked, space.write(counted.select("key", "n", "items_of"), "shared"), F.xxhash64("key1", "start")).select("key1", "key2", F.struct("start", "key.length").alias("span"), "items_of")
    per_doc = hits.groupBy("key1", "key2").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("items_of")).alias("sets"))
    per_doc = space.write(per_doc.withColumn("sets_id", F.sha2(F.concat_ws(",", "sets"), 256)), "hits")
    combined = per_doc.groupBy("sets_id").agg(F.first("sets").alias("sets")).select("sets_id", F.explode("sets").alias("items_of"))
    listed = combined.join(members, "items_of").groupBy("sets_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found_items = per_doc.select("key1", "key2", "spans", "sets_id").join(space.write(listed, "items"), "sets_id").drop("sets_id")
    out = base.select("doc_id", "key1", "key2", "n_words").join(found_items, ["key1", "key2"], "left")
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'end', 0), (x, s) -> named_struct('n', x.n + greatest(0, s.start + s.length - greatest(x.end, s.start)), 'end', greatest(x.end, s.start + s.length)), x -> x.n)"
    )
    return out.select("doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
