"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.llm.components import connected_components
from sitefold.llm.workspace import Workspace, bound_arrow_batches, spread_join

COSINE = 0.93
#: Rows down to which the longest keys tried would cut a label whose vectors point everywhere.
WINDOW = 64
#: The chance at which a pair right at the threshold may be missed by all passes.
MISS = 1e-5
BITS = 32
#: Rows of a block in which a long run is compared, and the links of a component are counted.
BLOCK = 1 << 11
#: Passes whose runs are counted to choose the bits of a label; comparisons that cost as much as dealing out one row.
PROBES = 2
DEALT = 2000
_RUN = ["label", "dims", "pass", "key"]
_SORT = [*_RUN, "low", "high"]


def passes_for(bits: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """How many passes leave a pair at the threshold unseen with a chance of ``miss`` at most.

    Two such vectors get the same bit with chance 1 - angle / pi, wherever the other vectors point. They meet in a pass if
    ``bits`` bits agree, as runs of equal keys are compared whole; without bits, one pass compares all.
    """
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if bits == 0 else math.ceil(math.log(miss) / math.log1p(-min(meet, 0.999)))


def bits_for(rows: int, window: int = WINDOW) -> int:
    """The bits that cut ``rows`` vectors that point everywhere down to ``window``."""
    return min(BITS, math.ceil(math.log2(max(rows, 1) / window)) + 1) if rows > window else 0


def passes_needed(rows: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    """The most passes that a label of ``rows`` vectors may get."""
    return max(4, *(passes_for(b, cosine, miss) for b in range(bits_for(rows, window) + 1)))


def _planes(dims: int, n: int) -> np.ndarray:
    return np.random.default_rng([dims, 7]).standard_normal((dims, n * BITS))


def _packed(kind: str):
    def run(batches):
        """``(label, dims, vec_id, vector)`` of the rows that take part, the vector as bytes."""
        for batch in batches:
            column = batch.column(2)
            at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype("<f8")
            sizes = np.diff(at)
            for d in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == d)
                x = values[at[rows][:, None] + np.arange(d)]
                with np.errstate(all="ignore"):
                    norm = np.sqrt((x * x).sum(1))
                good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
                rows, x = rows[good], x[good].astype(kind)
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)), batch.column(0).take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())],
                        ["label", "dims", "vec_id", "vector"],
                    )

    return run


def _unpacked(vectors: list[bytes], dims: int) -> np.ndarray:
    """Vectors in double precision, from bytes of either precision."""
    data = b"".join(vectors)
    return np.frombuffer(data, "<f8" if len(data) == 8 * dims * len(vectors) else "<f4").reshape(len(vectors), dims).astype(float)


def _keyed(most: int, whole: bool):
    """Keys of the passes of each row, cut to the bits of its label: ``(label, dims, pass, key)``, and the vector if ``whole``."""
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            labels, dims, ids, bits, passes = (batch.column(k).to_numpy() for k in (0, 1, 2, 4, 5))
            for d, b in {*zip(dims.tolist(), bits.tolist(), strict=True)}:
                at = np.flatnonzero((dims == d) & (bits == b))
                n = int(passes[at[0]])
                data = [v.as_py() for v in batch.column(3).take(pa.array(at))]
                if b and d not in planes:
                    planes[d] = _planes(d, most)
                for k in range(0, len(at), step := max(1, (1 << 15) // n)):
                    some, vectors = at[k : k + step], data[k : k + step]
                    x = _unpacked(vectors, d)
                    keys = ((x @ planes[d][:, : n * BITS] > 0).reshape(len(x), n, BITS) @ weights >> (BITS - b)).ravel() if b else np.zeros(len(x) * n, np.int64)
                    columns = {
                        "label": np.repeat(labels[some], n), "dims": np.full(len(keys), d, np.int32), "pass": np.tile(np.arange(n, dtype=np.int32), len(x)), "key": keys,
                    }
                    if whole:
                        columns |= {"vec_id": np.repeat(ids[some], n), "vector": pa.array([v for v in vectors for _ in range(n)], pa.binary())}
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :])


def _met(cosine: float):
    """Links of sorted rows with one run and pair of blocks, as a forest: enough to join what belongs together."""

    def linked(head, parts):
        ids, blocks, data = (np.concatenate([p[k] for p in parts]) if k < 2 else [v for p in parts for v in p[2]] for k in range(3))
        x = _unpacked(data, int(head[1]))
        own = head[4] == head[5]
        left, right = (np.arange(len(x)),) * 2 if own else (np.flatnonzero(blocks == head[4]), np.flatnonzero(blocks == head[5]))
        return _forest(ids, left, right, lambda rows, after: cosines(x[rows], x[right[after:]]) >= cosine, own)

    def run(batches):
        head, parts = None, []
        for batch in batches:
            heads = np.column_stack([batch.column(k).to_numpy().astype(np.int64) for k in range(6)])
            blocks, ids, data = batch.column(6).to_numpy(), batch.column(7).to_numpy(), batch.column(8)
            cuts = np.flatnonzero((heads[1:] != heads[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(heads)], strict=True):
                if a == b:
                    continue
                if head is not None and (heads[a] != head).any():
                    yield from linked(head, parts)
                    parts = []
                head = heads[a]
                parts.append((ids[a:b], blocks[a:b], data.slice(a, b - a).to_pylist()))
        if parts:
            yield from linked(head, parts)

    return run


def _forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray, close, own: bool):
    """Joins left rows with the right ones that are close: one link for each two trees that a row brings together."""
    tree, kept = np.arange(len(ids)), []
    for i in range(0, len(left), 512):
        after = i if own else 0
        near = close(left[i : i + 512], after)
        for k in np.flatnonzero(near.sum(1) > (1 if own else 0)):
            trees = np.unique(np.append(tree[right[after:][near[k]]], tree[left[i + k]]))
            if len(trees) > 1:
                kept.append(np.column_stack((np.full(len(trees) - 1, ids[trees[0]]), ids[trees[1:]])))
                tree[np.isin(tree, trees)] = trees[0]
    if kept:
        pairs = np.concatenate(kept)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])


def _counted(cosine: float):
    """Links between two blocks of a bundle of components; a vector counts as often as it has copies, itself included."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def sides(t):
            order = np.argsort(t["component"].to_numpy(), kind="stable")
            return (*(t[c].to_numpy()[order] for c in ("component", "vec_id", "weight", "dims")), t["vector"].combine_chunks().take(pa.array(order)).to_pylist())

        (c1, i1, _, d1, v1), (c2, i2, w2, d2, v2) = sides(left), sides(right)
        ids, counts = [], []
        for c in np.intersect1d(c1, c2):
            (a, b), (e, f) = np.searchsorted(c1, [c, c + 1]), np.searchsorted(c2, [c, c + 1])
            x, y = _unpacked(v1[a:b], int(d1[a])), _unpacked(v2[e:f], int(d2[e]))
            linked = (cosines(x, y) >= cosine) | (i1[a:b, None] == i2[None, e:f])
            ids.append(i1[a:b])
            counts.append(linked.astype(np.int64) @ w2[e:f])
        empty = np.zeros(0, np.int64)
        return pa.table({"vec_id": np.concatenate(ids or [empty]), "n": np.concatenate(counts or [empty]).astype(np.int64)})

    return run


def _chosen(single: DataFrame, cosine: float, window: int, miss: float) -> DataFrame:
    """``(label, dims, rows, bits, passes)``: for each label the bits whose passes cost least, by the runs of a few passes.

    A label of more rows than a window is always sorted by projections, with one bit at least; a smaller one is one window."""
    rows = single.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("rows"))
    most = bits_for(rows.agg(F.max("rows")).first()[0] or 0, window)
    passes = F.expr("element_at(array(" + ",".join(str(passes_for(b, cosine, miss)) for b in range(most + 1)) + "), bits + 1)")
    probed = single.withColumns({"bits": F.lit(BITS), "passes": F.lit(PROBES)}).mapInArrow(_keyed(PROBES, False), "label long, dims int, pass int, key long")
    keys = probed.groupBy(*_RUN).agg(F.count(F.lit(1)).alias("n")).withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(most))))
    runs = keys.groupBy("label", "dims", "bits", "pass", F.expr(f"shiftright(key, {BITS} - bits)").alias("key")).agg(F.sum("n").alias("n"))
    costs = runs.groupBy("label", "dims", "bits").agg((F.sum("n") / PROBES).cast("long").alias("rows"), (F.sum(F.col("n").cast("double") * F.col("n")) / PROBES).alias("met"))
    costs = costs.where(f"bits > 0 OR rows <= {window}").withColumn("passes", passes).withColumn("cost", F.expr(f"passes * ({DEALT}D * rows + met)"))
    return costs.groupBy("label", "dims").agg(F.min(F.struct("cost", "bits", "passes", "rows")).alias("x")).where("x.rows > 1").select("label", "dims", "x.rows", "x.bits", "x.passes")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, window: int = WINDOW, miss: float = MISS
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Of equal vectors of a label the one with the smallest id stands for all. Each pass sorts the vectors, within labels, by
    the signs of random projections and compares every vector with all of its run, that is, those with the same key. So the
    chance that a pair at the threshold meets follows from the number of bits alone, however the vectors of a label are
    spread, and the passes are as many as leave at most ``miss``. What the spread changes is the length of the runs: it is
    measured, and each label of more rows than a window gets the bits that cost least. A run is compared in windows of at most
    BLOCK rows; a longer one is split into such blocks, and each pair of blocks is compared by some task, so that no bound
    loses a pair.

    The verified pairs of all passes are joined into components. Links are then counted exactly within components, block by
    block, each vector with the number of its copies as weight, so that a group of copies gets all its links while no pair of
    them is made. Copies are rows of one 128-bit hash; they take their result from the first of them.

    Null, empty or zero vectors, such with null or non-finite components, and those with a null label link with nothing;
    neither do vectors of different lengths. Rows with a null id are returned alone, with a null component. Rows that repeat
    an id are one vector, the smallest by (label, length, bytes) if they differ. Other columns are ignored.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "vectors")
    bound_arrow_batches(spark, rows=2000)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = base.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    # floats keep their four bytes wherever rows are dealt out; all arithmetic is in double precision
    kind = "<f4" if isinstance(vectors.select(vector_col).schema[0].dataType.elementType, T.FloatType) else "<f8"
    packed = space.write(usable.mapInArrow(_packed(kind), "label long, dims int, vec_id long, vector binary"), "packed")
    again = packed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    least = packed.join(again, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "dims", "vector")).alias("x"))
    packed = packed.join(again, "vec_id", "left_anti").select("label", "dims", "vec_id", "vector").unionByName(least.select("x.*", "vec_id"))
    marked = space.write(packed.select("vec_id", F.struct("label", "dims", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")).alias("key")), "marked")
    reps = space.write(marked.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "reps")
    single = space.write(packed.join(reps.select(F.col("rep").alias("vec_id"), F.col("n").alias("weight")), "vec_id").select("label", "dims", "vec_id", "vector", "weight"), "single")
    chosen = space.write(_chosen(single.drop("weight"), cosine, window, miss), "chosen")
    most = chosen.agg(F.max("passes")).first()[0] or 1
    dealt = single.join(chosen, ["label", "dims"]).select("label", "dims", "vec_id", "vector", "bits", "passes")
    run = "label long, dims int, pass int, key long"
    runs = dealt.mapInArrow(_keyed(most, False), run).groupBy(*_RUN).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)
    runs = space.write(runs.select(*_RUN, F.expr(f"cast(ceil(size / {BLOCK}D) AS int)").alias("blocks")), "runs")
    rows = dealt.mapInArrow(_keyed(most, True), run + ", vec_id long, vector binary").join(runs, _RUN, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(vec_id, 1), blocks) AS int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select(*_RUN, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "vec_id", "vector")
    total = chosen.agg(F.coalesce(F.sum(F.col("passes") * F.col("rows")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (1 << 15))
    met = rows.repartition(parts, *_SORT).sortWithinPartitions(*_SORT).mapInArrow(_met(cosine), "a long, b long")
    links = space.write(met.distinct(), "links")
    labels = space.write(connected_components(links, space), "members")
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = space.write(single.select("dims", "vec_id", "vector", "weight").join(labels.withColumnRenamed("node", "vec_id"), "vec_id").join(sizes, "component"), "linked")
    bundles = max(1, members.count() // BLOCK)
    members = members.withColumn("blocks", F.expr(f"shiftleft(1, greatest(0, cast(ceil(log2(size / {BLOCK}D)) AS int)))"))
    members = members.select(
        F.when(F.col("blocks") > 1, -1 - F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bundles))).alias("bundle"),
        "blocks", F.expr("cast(xxhash64(vec_id) & (blocks - 1) AS int)").alias("block"), "component", "dims", "vec_id", "weight", "vector",
    )
    left = members.select("bundle", F.col("block").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"), "component", "dims", "vec_id", "weight", "vector")
    right = members.select("bundle", F.col("block").alias("j"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), "component", "dims", "vec_id", "weight", "vector")
    keys = ["bundle", "i", "j"]
    counts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_counted(cosine), "vec_id long, n long")
    counts = space.write(counts.groupBy("vec_id").agg((F.sum("n") - 1).alias("n")), "counts")
    found = reps.join(counts.toDF("rep", "links"), "rep", "left").join(labels.toDF("rep", "component"), "rep", "left")
    found = found.select("key", "n", F.coalesce("links", F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    result = spread_join(marked, space.write(found, "found"), F.xxhash64("vec_id")).select("vec_id", F.col("links").alias("n"), "component")
    out = base.select("vec_id").join(result, "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
