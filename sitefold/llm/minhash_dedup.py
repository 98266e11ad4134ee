"""MinHash near-duplicates by a signature-coordinate inverted join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefold.llm import textkernel as tk
from sitefold.llm.components import linked_components
from sitefold.llm.workspace import Workspace, bound_arrow_batches

WORDS = 5
#: A link needs 100 * |intersection| >= SIMILAR * |union|.
SIMILAR = 75
#: Coordinates of a signature, and how many must collide before sets are compared. A pair at similarity 0.75 collides in
#: fewer with probability below 1e-6.
COORDINATES = 48
MATCHES = 20
#: Posting lists are walked as trees whose nodes have about so many children.
FAN_OUT = 64
#: Long lists of undecided documents are joined in blocks of about 2 ** BLOCK_BITS.
BLOCK_BITS = 10
#: 64-bit words of the smallest sketch of a set.
SKETCH = 8

_rng = np.random.default_rng(20240605)
_FLIPS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORDINATE_SEEDS = tk.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in tk.row_slices(offsets):
        part = raw[offsets[a] : offsets[b]]
        starts, ends, first = tk.word_spans(part, offsets[a : b + 1] - offsets[a])
        hashed = tk.word_hashes(part, starts, ends, lower=True)
        runs = tk.window_hashes(hashed, words, words)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= words:
                out.append(np.unique(runs[i : j - words + 1]))
            elif j > i:
                out.append(tk.window_hashes(hashed[i:j], j - i, j - i))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _list_column(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _signed(coordinates: int, words: int):
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            raw, offsets = tk.text_bytes(column)
            sets = shingle_sets(raw, offsets, words)
            sizes = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(sizes)
            signature = np.zeros((len(sets), coordinates), np.uint64)
            marks = np.zeros((2, len(sets)), np.uint64)
            for some in np.array_split(full, max(1, int(sizes.sum()) >> 17)):
                if not len(some):
                    continue
                flat = np.concatenate([sets[k] for k in some])
                at = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                marks[0, some] = np.add.reduceat(tk.mix(flat + np.uint64(1)), at)
                marks[1, some] = np.add.reduceat(tk.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                for c in range(coordinates):
                    least = np.minimum.reduceat((flat ^ _FLIPS[c]) * _FACTORS[c], at)
                    signature[some, c] = tk.mix(least ^ _COORDINATE_SEEDS[c])
            kept = [signature[k] if n else signature[k, :0] for k, n in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), _list_column(kept)],
                ["doc_id", "n_shingles", "mark1", "mark2", "signature"],
            )

    return run


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit for each residue of the shingles: set if an odd number of them has it. The bits in which two sketches differ are
    residues of an odd number of shingles that only one set has, so they never outnumber those shingles. There are about as
    many bits as shingles, a power of two; the two halves of a sketch, XORed, are the sketch of half the size."""
    words = max(SKETCH, 1 << max(0, len(shingles) - 1).bit_length() - 6 if len(shingles) > 64 else 1)
    return np.packbits(np.bincount((shingles % np.uint64(64 * words)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1, bitorder="little").view("<u8")


def _sets(words: int):
    def run(batches):
        for batch in batches:
            raw, offsets = tk.text_bytes(batch.column(1))
            sets = shingle_sets(raw, offsets, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), _list_column(sets), pa.array([odd_sketch(x).tobytes() for x in sets], pa.binary())], ["doc_id", "shingles", "sketch"])

    return run


def _leader_pairs(lists: DataFrame, longest: int) -> DataFrame:
    """``(a, b)``, once each: every member of a posting list with the first of its branch, level by level; ``a < b``.

    First comes the document whose values are the most common ones: of many altered copies that is the least altered.
    A branch has about FAN_OUT members, dealt by their hashes, so a window holds no more.
    """
    rows, pairs, level = lists, None, 0
    while True:
        rows = rows.withColumn("branch", F.expr(f"h & (shiftleft(1L, greatest(0, cast(ceil(log2(freq)) AS int) - {6 * (level + 1)})) - 1L)"))
        rows = rows.withColumn("a", F.min(F.struct("rank", "h", "doc")).over(Window.partitionBy("key", "branch"))["doc"])
        found = rows.where("a <> doc").select("a", F.col("doc").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
        level += 1
        if longest <= FAN_OUT**level:
            return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rows = rows.where("a = doc").select("key", "freq", "rank", "h", "doc")


def _undecided(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, doc, component, size)`` of the members of posting lists that more than one component has."""
    named = lists.join(labels, lists.doc == labels.node, "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    return named.join(mixed.select("key", "size"), "key")


def _close(x: list, y: list | None, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` (or twice in ``x``) of documents of different components that the bounds leave as candidates.

    A side is ``(components, sizes, sketches)``, the sketches of one length.
    """
    other, found = x if y is None else y, [np.zeros((2, 0), np.int64)]
    for k in range(0, len(x[0]), step := max(1, (1 << 18) // max(1, len(other[0])))):
        sizes = x[1][k : k + step, None]
        fits = (x[0][k : k + step, None] != other[0]) & (100 * np.minimum(sizes, other[1]) >= similar * np.maximum(sizes, other[1]))
        i, j = np.nonzero(fits if y is not None else np.triu(fits, k + 1))
        i += k
        for n in range(0, len(i), 1 << 15):
            p, q = i[n : n + (1 << 15)], j[n : n + (1 << 15)]
            apart = np.bitwise_count(x[2][p] ^ other[2][q]).sum(1, dtype=np.int64)
            near = apart * (100 + similar) <= (100 - similar) * (x[1][p] + other[1][q])
            found.append(np.stack((p[near], q[near])))
    return tuple(np.concatenate(found, 1))


def _candidates(similar: int):
    """Pairs ``(a, b)`` of the members of one cell of a posting list; rows come sorted by cell."""

    def compared(head, parts):
        blocks, docs, components, sizes = (np.concatenate([p[k] for p in parts]) for k in range(4))
        data = [v for p in parts for v in p[4]]
        lengths = np.array([len(v) for v in data])

        def side(rows, length, twice):
            """Rows whose sketches have this length or twice the length; those are folded."""
            rows = rows[lengths[rows] == length * (1 + twice)]
            x = np.frombuffer(b"".join([data[r] for r in rows.tolist()]), "<u8").reshape(len(rows), length * (1 + twice) // 8)
            return rows, [components[rows], sizes[rows], x[:, : length // 8] ^ x[:, length // 8 :] if twice else x]

        pairs = [np.zeros((2, 0), np.int64)]
        low, high = np.flatnonzero(blocks == head[1]), np.flatnonzero(blocks == head[2])
        for length in np.unique(lengths).tolist():
            for twice_low, twice_high in ((0, 0), (0, 1), (1, 0))[: 2 if head[1] == head[2] else 3]:
                left, x = side(low, length, twice_low)
                right, y = side(high, length, twice_high)
                if len(left) and len(right):
                    i, j = _close(x, None if head[1] == head[2] and not twice_high else y, similar)
                    pairs.append(np.stack((docs[left[i]], docs[right[j]])))
        pairs = np.concatenate(pairs, 1)
        if pairs.size:
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(0)), pa.array(pairs.max(0))], ["a", "b"])

    def run(batches):
        head, parts = None, []
        for batch in batches:
            heads = np.column_stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            columns = [batch.column(k).to_numpy() for k in range(3, 7)]
            cuts = np.flatnonzero((heads[1:] != heads[:-1]).any(1)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(heads)], strict=True):
                if i == j:
                    continue
                if head is not None and (heads[i] != head).any():
                    yield from compared(head, parts)
                    parts = []
                head = heads[i]
                parts.append((*(c[i:j] for c in columns), batch.column(7).slice(i, j - i).to_pylist()))
        if parts:
            yield from compared(head, parts)

    return run


def _crossing_pairs(undecided: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """``(a, b)``: every pair of different components in a posting list that may still be a link by its sizes and sketches.

    Long lists are dealt out as cells, each of two blocks of about 2 ** BLOCK_BITS members, so a task holds one cell at most.
    """
    rows = undecided.join(sets.select("doc_id", F.size("shingles").cast("long").alias("n"), "sketch"), undecided.doc == sets.doc_id)
    rows = rows.withColumn("blocks", F.expr(f"cast(ceil(size / {1 << BLOCK_BITS}D) AS int)")).withColumn("block", F.expr("cast(pmod(xxhash64(doc, 1), blocks) AS int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "component", "n", "sketch")
    cell = ["key", "low", "high"]
    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_candidates(similar), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similar: int = SIMILAR,
    words: int = WORDS,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Every distinct shingle set is one node, named by the smallest doc_id that has it, so exact copies cost nothing more.
    Nodes are posted under their signature's coordinate-value pairs. A value that only one node has is dropped; a node
    left with fewer than ``matches`` values can link with nothing. Of the others just a prefix is walked, rarest values
    first: two nodes with ``matches`` collisions meet in it. Members of a list are paired with the head of their branch,
    at most about FAN_OUT to a head, and all these pairs are confirmed at once on full shingle sets. Members of lists that
    still hold several components are then compared across components only, list by list: what their sizes and the sketches
    of their sets leave is confirmed likewise. So no link is lost, and pairs within a component are never made. The links
    found last join components, so only components are followed from them.

    Null or empty texts and texts without words have an empty set and link with nothing. Rows with a null doc_id are
    returned as their own component (null). Rows that repeat a doc_id are one document, whose links are those of all its
    texts. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "minhash")
    bound_arrow_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = space.write(
        texts.mapInArrow(_signed(coordinates, words), "doc_id long, n_shingles long, mark1 long, mark2 long, signature array<long>"), "signed"
    )
    marks = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "mark1", "mark2")
    named = marks.groupBy("mark1", "mark2").agg(F.min("doc_id").alias("rep"))
    reps = named.select(F.col("rep").alias("doc_id"))
    posts = (
        signed.where("n_shingles > 0").join(reps, "doc_id", "left_semi")
        .select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct("signature")).alias("key"))
    )
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    survivors = space.write(
        posts.join(shared, "key").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("freq", "key"))).alias("values"))
        .where(F.size("values") >= matches),
        "survivors",
    )
    base = space.write(signed.drop("signature"), "base")
    space.drop("signed")
    named = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("mark1", "mark2").agg(F.min("doc_id").alias("rep"))
    lists = space.write(
        survivors.withColumn("rank", F.expr("-aggregate(values, 0L, (n, v) -> n + v.freq)"))
        .select("doc", "rank", F.explode(F.slice("values", F.lit(1), F.size("values") - (matches - 1))).alias("v"))
        .select(F.col("v.key").alias("key"), F.col("v.freq").alias("freq"), "doc", "rank", F.xxhash64("doc").alias("h")),
        "lists",
    )
    longest = lists.agg(F.max("freq")).first()[0] or 0
    sets = space.write(
        texts.join(survivors.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, shingles array<long>, sketch binary"), "sets"
    )
    shingles = sets.select("doc_id", "shingles")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """``(a, b)`` of the pairs whose full sets are similar enough."""
        both = pairs.join(shingles.toDF("a", "sa"), "a").join(shingles.toDF("b", "sb"), "b")
        common = both.select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("n"))
        return space.write(common.where(f"100 * n >= {similar} * (na + nb - n)").select("a", "b"), name)

    near = links(_leader_pairs(lists, longest), "near")
    labels = linked_components(near, near.count(), space, "labels")
    rest = links(_crossing_pairs(_undecided(lists, labels), sets, similar), "rest")
    space.drop("lists", "sets")
    rep = F.expr("CASE WHEN n_shingles > 0 AND doc_id IS NOT NULL THEN rep ELSE doc_id END")
    result = base.join(named, ["mark1", "mark2"], "left").withColumn("rep", rep).join(labels.toDF("rep", "component"), "rep", "left")
    result = result.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    if n := rest.count():
        one, two = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        across = rest.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = linked_components(across, n, space, "joined").toDF("component_id", "least")
        result = result.join(joined, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
