"""Exact top-k inner products by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefold.llm.workspace import Workspace, bound_arrow_batches

SCALE = 256
TOP = 5
EVERY = 50
#: Rows of a candidate block and of a query block; queries that are worked on at once; dimensions added at a time.
CANDIDATES = 1 << 14
QUERIES = 1 << 12
TOGETHER = 128
DIMENSIONS = 16
#: Partitions that the cells of the grid are dealt to at most.
CELLS = 1 << 14
#: Components up to this size are packed as 32-bit integers; blocks of larger ones as doubles, which hold floor(256 * x) exactly.
NARROW = 1 << 28
_PACKED = "dims int, ids binary, columns binary, wide boolean"


def _packed(scale: float, rows: int):
    """Blocks in vertical layout: one run of integers for each dimension."""

    def block(ids, vectors):
        x = np.ascontiguousarray(np.array(vectors).T)
        wide = bool(np.abs(x).max() > NARROW)
        columns = x.astype("<f8" if wide else "<i4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([columns]), pa.array([wide])], ["dims", "ids", "columns", "wide"])

    def run(batches):
        held: dict[tuple[int, bool], tuple[list, list]] = {}
        for batch in batches:
            column = batch.column(1)
            at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(float)
            for k, i in enumerate(batch.column(0).to_pylist()):
                with np.errstate(all="ignore"):
                    x = np.floor(scale * values[at[k] : at[k + 1]])
                if i is None or not len(x) or not np.isfinite(values[at[k] : at[k + 1]]).all():
                    continue
                if not np.isfinite(x).all():
                    raise OverflowError(f"a component of vector {i} is too large to be scaled")
                kind = len(x), bool(np.abs(x).max() > NARROW)
                ids, vectors = held.setdefault(kind, ([], []))
                ids.append(i)
                vectors.append(x)
                if len(ids) == rows:
                    yield block(*held.pop(kind))
        for ids, vectors in held.values():
            yield block(ids, vectors)

    return run


def best_of_block(queries: np.ndarray, columns: np.ndarray, own: np.ndarray, ids: np.ndarray, top: int) -> list[np.ndarray]:
    """For each query the places of its ``top`` best candidates, by score and then smaller id, as ``(place, score)`` rows.

    Scores grow by one block of dimensions at a time. What the rest can add is at most the product of both rests' norms
    (Cauchy-Schwarz); a candidate whose upper bound is below the ``top``-th best lower bound is out. Once few are left,
    only those are carried on.
    """
    d, n = columns.shape
    order = np.argsort(-np.square(queries, dtype=float).sum(0), kind="stable")
    kind = float if np.abs(queries).max(initial=0) * float(np.abs(columns).max(initial=0)) * d < 2**53 else np.int64
    q, x = queries[:, order].astype(kind), columns[order].astype(kind)
    rest_q = np.sqrt(np.cumsum(np.square(q[:, ::-1], dtype=float), 1)[:, ::-1])
    rest_x = np.sqrt(np.cumsum(np.square(x[::-1], dtype=float), 0)[::-1])
    self_pair = own[:, None] == ids[None, :]
    score, pairs = None, None
    for b in range(0, d, DIMENSIONS):
        e = min(b + DIMENSIONS, d)
        if pairs is None:
            part = q[:, b:e] @ x[b:e]
            score = part if score is None else score + part
        else:
            i, j = pairs
            for k in range(b, e):
                score += q[i, k] * x[k, j]
        if e == d:
            break
        if pairs is None:
            slack = rest_q[:, e, None] * rest_x[None, e] * (1 + 1e-9) + 1e-6
            low = np.where(self_pair, -np.inf, score - slack)
            floor = np.partition(low, max(n - top, 0), 1)[:, max(n - top, 0)] if n >= top else np.full(len(q), -np.inf)
            alive = (score + slack >= floor[:, None]) & ~self_pair
            if alive.mean() < 0.2:
                pairs = np.nonzero(alive)
                score = score[pairs]
        else:
            slack = rest_q[i, e] * rest_x[e, j] * (1 + 1e-9) + 1e-6
            low = np.full(len(q), -np.inf)
            ranked = np.lexsort((-(score - slack), i))
            first = np.searchsorted(i[ranked], np.arange(len(q) + 1))
            for k in range(len(q)):
                if first[k + 1] - first[k] >= top:
                    low[k] = (score - slack)[ranked[first[k] + top - 1]]
            keep = score + slack >= low[i]
            pairs, score = (i[keep], j[keep]), score[keep]
    out = []
    for k in range(len(q)):
        if pairs is None:
            place = np.flatnonzero(~self_pair[k])
            s = score[k, place]
            if len(place) > top:
                close = s >= np.partition(s, len(s) - top)[len(s) - top]
                place, s = place[close], s[close]
        else:
            a, b = np.searchsorted(pairs[0], [k, k + 1])
            place, s = pairs[1][a:b], score[a:b]
        best = np.lexsort((ids[place], -s))[:top]
        out.append(np.column_stack((place[best], s[best].astype(np.int64))))
    return out


def best_of_wide_block(queries: np.ndarray, columns: np.ndarray, own: np.ndarray, ids: np.ndarray, top: int) -> list[np.ndarray]:
    """What ``best_of_block`` gives, where products may not fit into 64 bits: candidates whose score in doubles, by the bound on
    its error, may be among the best are computed anew in Python's integers."""
    out = []
    size = np.sqrt(np.square(columns).sum(0))
    for k, q in enumerate(queries):
        near = np.flatnonzero(ids != own[k])
        rough, error = q @ columns[:, near], len(q) * 2.0**-52 * np.sqrt(q @ q) * size[near]
        if not np.isfinite(rough).all() or not np.isfinite(error).all():
            near_enough = near
        else:
            floor = np.partition(rough - error, max(len(near) - top, 0))[max(len(near) - top, 0)] if len(near) >= top else -np.inf
            near_enough = near[rough + error >= floor]
        mine = [int(v) for v in q]
        exact = [sum(a * int(b) for a, b in zip(mine, columns[:, j], strict=True)) for j in near_enough]
        best = sorted(zip((-s for s in exact), ids[near_enough].tolist(), near_enough.tolist(), strict=True))[:top]
        if best and max(abs(best[0][0]), abs(best[-1][0])) >= 1 << 63:
            raise OverflowError(f"a score of query {own[k]} does not fit into a long")
        out.append(np.array([(j, -s) for s, _, j in best], np.int64).reshape(-1, 2))
    return out


def _met(top: int):
    def run(batches):
        for batch in batches:
            for d, qi, qc, qw, ci, cc, cw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own, ids = np.frombuffer(qi, "<i8"), np.frombuffer(ci, "<i8")
                queries, columns = np.frombuffer(qc, "<f8" if qw else "<i4").reshape(d, -1).T, np.frombuffer(cc, "<f8" if cw else "<i4").reshape(d, -1)
                search = best_of_wide_block if qw or cw else best_of_block
                if search is best_of_wide_block:
                    queries, columns = queries.astype(float), columns.astype(float)
                for a in range(0, len(own), TOGETHER):
                    best = search(queries[a : a + TOGETHER], columns, own[a : a + TOGETHER], ids, top)
                    who = np.repeat(own[a : a + TOGETHER], [len(x) for x in best])
                    all_best = np.concatenate(best)
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids[all_best[:, 0]]), pa.array(all_best[:, 1])], ["query_id", "vec_id", "score"])

    return run


def top_inner_products(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, top: int = TOP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``top`` candidates by integer inner product, exact.

    Components become floor(scale * x). Ties go to the smaller id. Both tables are packed into blocks in vertical layout;
    each block of queries meets each block of candidates once, on a grid of join keys with about one block of either side
    each, and gives at most ``top`` rows a query. So a task holds two blocks, and the final ranking only a few rows for
    each block.

    Vectors that are null or empty, or with null or non-finite components, take no part, nor do null ids. Components of any
    finite size are exact; a score that does not fit into a long is an error. Vectors of different lengths never meet. A candidate with a query's own id is not its candidate; a repeated
    query counts once, repeated candidates each. Fewer candidates than ``top`` give fewer rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "search")
    bound_arrow_batches(spark, rows=4096)
    pick = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")]
    usable = "id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)"
    candidates = space.write(vectors.select(*pick).where(usable).mapInArrow(_packed(scale, CANDIDATES), _PACKED), "candidates")
    asked = space.write(queries.select(*pick).where(usable).dropDuplicates(["id"]).mapInArrow(_packed(scale, QUERIES), _PACKED), "queries")
    across, down = max(1, candidates.count()), max(1, asked.count())
    key = lambda n, salt: F.pmod(F.xxhash64("ids", F.lit(salt)), F.lit(n)).cast("int")
    left = asked.select("dims", F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"), F.col("wide").alias("q_wide"), key(down, 1).alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"))
    right = candidates.select("dims", F.col("ids").alias("c_ids"), F.col("columns").alias("c_columns"), F.col("wide").alias("c_wide"), key(across, 2).alias("across"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"))
    bound_arrow_batches(spark, rows=4)
    cells = ["dims", "down", "across"]
    met = left.repartition(min(across * down, CELLS), *cells).join(right.hint("merge"), cells).select("dims", "q_ids", "q_columns", "q_wide", "c_ids", "c_columns", "c_wide")
    best = space.write(met.mapInArrow(_met(top), "query_id long, vec_id long, score long"), "best")
    bound_arrow_batches(spark)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
