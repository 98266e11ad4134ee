"""Centroid clustering by plain Lloyd rounds in integers, so that results don't depend on how rows are dealt out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.workspace import Workspace, bound_arrow_batches

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = 3
#: Components up to this size are kept as 32-bit integers, and their squared differences add up in 64 bits for up to 64 of
#: them; rows with larger ones are kept as doubles, which hold floor(scale * x) exactly, and worked on in Python's integers.
NARROW = 1 << 27


def _packed(dims: int, scale: float):
    """``(vec_id, vector)`` of the rows that take part."""

    def run(batches):
        for batch in batches:
            at, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False).astype(float)
            rows = np.flatnonzero(np.diff(at) == dims)
            x = values[at[rows][:, None] + np.arange(dims)]
            finite = np.isfinite(x).all(1)
            rows = rows[finite]
            with np.errstate(over="ignore"):
                x = np.floor(scale * x[finite])
            if not np.isfinite(x).all():
                raise OverflowError("a component is too large to be scaled")
            wide = (np.abs(x) > _narrow(dims)).any(1)
            narrow, data = x.copy(), [b""] * len(x)
            narrow[wide] = 0
            for k, v in enumerate(narrow.astype("<i4")):
                data[k] = x[k].astype("<f8").tobytes() if wide[k] else v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(data, pa.binary())], ["vec_id", "vector"])

    return run


def _narrow(dims: int) -> int:
    """The largest component for which ``dims`` squared differences fit into 62 bits."""
    return min(NARROW, int((2.0**62 / max(dims, 1)) ** 0.5) // 2)


def _integers(vectors: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows as 64-bit integers; and, where any row is wide, all of them as Python's integers."""
    if all(len(v) == 4 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(-1, dims).astype(np.int64), None
    return np.zeros((0, dims), np.int64), np.array([[int(c) for c in np.frombuffer(v, "<i4" if len(v) == 4 * dims else "<f8")] for v in vectors], object)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest squared distance of each row to a centroid, and the lowest number of a centroid that has it."""
    distances = np.empty((len(x), len(centroids)), x.dtype)
    for k, c in enumerate(centroids):
        difference = x - c
        distances[:, k] = (difference * difference).sum(1)
    best = np.array([min(range(len(centroids)), key=row.__getitem__) for row in distances.tolist()], np.int64) if x.dtype == object else distances.argmin(1)
    return best, distances[np.arange(len(x)), best]


def _met(vectors: pd.Series, centroids: list[list[int]], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as integers, their clusters and their distances."""
    x, wide = _integers(vectors.tolist(), dims)
    if wide is None and all(abs(c) <= _narrow(dims) for centroid in centroids for c in centroid):
        return x, *nearest(x, np.array(centroids, np.int64))
    x = x.astype(object) if wide is None else wide
    return x, *nearest(x, np.array(centroids, object))


def _sums(held, dims: int):
    """``(cluster, dimension, total, n)`` of all rows of a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = held.value
        totals, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
        for frame in frames:
            x, cluster, _ = _met(frame["vector"], centroids, dims)
            for k in np.unique(cluster).tolist():
                mine = x[cluster == k]
                totals[k] = [a + int(b) for a, b in zip(totals[k], mine.sum(0), strict=True)]
                counts[k] += len(mine)
        some = [k for k, n in enumerate(counts) if n]
        yield pd.DataFrame(
            {
                "cluster": np.repeat(np.array(some, np.int32), dims), "dimension": np.tile(np.arange(dims, dtype=np.int32), len(some)),
                "total": pd.Series([Decimal(t) for k in some for t in totals[k]], dtype=object), "n": np.repeat(np.array([counts[k] for k in some], np.int64), dims),
            }
        )

    return run


def _assigned(held, dims: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            _, cluster, distance = _met(frame["vector"], held.value, dims)
            if len(distance) and max(distance) >= 1 << 63:
                raise OverflowError("a squared distance does not fit into a long")
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": cluster.astype(np.int32), "distance": distance.astype(np.int64)})

    return run


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, cluster, distance)`` of each vector that takes part, and ``(cluster, centroid, centroid_sha256)``.

    Components become integers floor(scale * x). The vectors with the smallest SHA-256 of ``seed:id`` are the first
    centroids. A round sends the centroids (``clusters`` times ``dims`` integers) to the tasks; each partition gives one sum
    and count for each cluster and dimension, which are added up by a groupBy, and the driver divides that many sums, rounding
    down. Rounds end early once no centroid moves, which changes nothing. Vectors stay where they are read; only sums move,
    so no cluster is too large, however many vectors or copies of one it has.

    Vectors that are null, of another length, or with null or non-finite components take no part, nor do rows with a null id.
    Rows that repeat an id are vectors of their own (of the first centroids, such with equal ids are taken in the order of
    their bytes). Ties go to the smaller cluster; a cluster that gets no vector keeps its centroid. Fewer vectors than
    ``clusters`` make fewer of them; none give empty tables. All arithmetic is exact; a distance that does not fit into a long
    is an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "clusters")
    bound_arrow_batches(spark, rows=8192)
    pick = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = pick.where(f"vec_id IS NOT NULL AND size(vector) = {dims} AND NOT exists(vector, x -> x IS NULL)")
    kept = space.write(usable.mapInArrow(_packed(dims, scale), "vec_id long, vector binary"), "kept")
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "vector").limit(clusters).collect()
    centroids = [[int(c) for c in np.frombuffer(r["vector"], "<i4" if len(r["vector"]) == 4 * dims else "<f8")] for r in first]
    for _ in range(rounds if centroids else 0):
        held = spark.sparkContext.broadcast(centroids)
        parts = kept.select("vector").mapInPandas(_sums(held, dims), "cluster int, dimension int, total decimal(38,0), n long")
        sums = parts.groupBy("cluster", "dimension").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        moved = [list(c) for c in centroids]
        for row in sums:
            moved[row["cluster"]][row["dimension"]] = int(row["total"]) // row["n"]
        held.unpersist()
        if moved == centroids:
            break
        centroids = moved
    held = spark.sparkContext.broadcast(centroids)
    assigned = kept.mapInPandas(_assigned(held, dims), "vec_id long, cluster int, distance long") if centroids else spark.createDataFrame([], "vec_id long, cluster int, distance long")
    table = [(k, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate([[str(v) for v in c] for c in centroids])]
    return space.write(assigned, "assigned"), spark.createDataFrame(table, "cluster int, centroid array<string>, centroid_sha256 string")


def with_inertia(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each assigned vector with the inertia of its cluster and of all, and its centroid's digest; one row a cluster is sent out."""
    summed = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    of_cluster = {r["cluster"]: int(r["s"]) for r in summed}
    rows = [(k, s, sum(of_cluster.values())) for k, s in of_cluster.items()]
    inertia = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long").join(centroids.select("cluster", "centroid_sha256"), "cluster")
    return assigned.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
