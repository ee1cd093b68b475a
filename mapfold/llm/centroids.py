"""Centroid clustering with a filter of rotated coordinates.

Vectors are stored with their leading coordinates in a rotation by principal
axes, and the norm of the rest. The squared distance of the leading coordinates
plus the squared difference of the rests' norms is never more than the squared
distance itself, so a centroid whose bound exceeds the distance to a nearer one
needs no look. What survives is verified in integers: the rotation decides how
much is verified, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

DIMS, CLUSTERS, ROUNDS, STEP = 64, 16, 3, 64
#: Leading coordinates that are kept, and vectors that the rotation is fitted on.
LEADING, FIT_ROWS = 8, 8192
#: Components of this size and more have no exact squared distance in 64 bits.
LIMIT = 1 << 20
#: Rounding of the bounds, as a share of the squares that they are made of.
ROUNDING = 1e-9


class Rotation:
    """The principal axes of a sample of vectors; without a sample the axes stay."""

    def __init__(self, sample: np.ndarray, leading: int):
        dims = sample.shape[1]
        self.middle = sample.mean(0) if len(sample) else np.zeros(dims)
        away = sample - self.middle
        self.axes = np.linalg.eigh(away.T @ away)[1][:, ::-1] if len(sample) else np.eye(dims)
        self.leading = min(leading, dims)

    def stored(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leading coordinates, and the norms of the rest."""
        y = (x - self.middle) @ self.axes
        return y[:, : self.leading], np.sqrt((y[:, self.leading :] ** 2).sum(1))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x (integers) its nearest centroid, the smaller number of equals, the squared distance, and how many were verified."""
    bound = ((lead[:, None, :] - c_lead) ** 2).sum(2) + (rest[:, None] - c_rest) ** 2
    rows, first = np.arange(len(x)), bound.argmin(1)
    distance = np.full(bound.shape, np.iinfo(np.int64).max)
    distance[rows, first] = ((x - centroids[first]) ** 2).sum(1)
    scale = (lead**2).sum(1) + rest**2 + ((c_lead**2).sum(1) + c_rest**2).max()
    left = bound <= (distance[rows, first] + ROUNDING * scale + ROUNDING)[:, None]
    left[rows, first] = False
    i, j = np.nonzero(left)
    distance[i, j] = ((x[i] - centroids[j]) ** 2).sum(1)
    cluster = distance.argmin(1)
    return cluster, distance[rows, cluster], len(x) + len(i)


def integer_vectors(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: the integers floor(STEP * component) of the vectors that are kept."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT))
    return vectors.filter((F.size(v) == dims) & ~odd).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(STEP * c).cast("int")).alias("x"))


def matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def store(kept: DataFrame, rotation: Rotation, dims: int) -> DataFrame:
    """vec_id, x, lead, rest, as a table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation.stored(matrix(batch.column(1), dims, np.float64))
            ends = pa.array(np.arange(len(rest) + 1) * rotation.leading, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, lead.ravel()), pa.array(rest)], ["vec_id", "x", "lead", "rest"])

    return written(kept.mapInArrow(work, "vec_id long, x array<int>, lead array<double>, rest double"), "vectors")


def assignments(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, rotation: Rotation) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """The ids, integers, clusters and distances of batches of stored vectors."""
    c_lead, c_rest = rotation.stored(centroids.astype(np.float64))
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column(1), centroids.shape[1], np.int64)
            cluster, distance, _ = nearest(x, matrix(batch.column(2), rotation.leading, np.float64), batch.column(3).to_numpy(), centroids, c_lead, c_rest)
            yield batch.column(0), x, cluster, distance


def moved(stored: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """The centroids after a round: floors of the means of what is nearest to them; those with nothing stay."""
    k, dims = centroids.shape
    names = ["cluster", "n", *(f"s{i}" for i in range(dims))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for _, x, cluster, _ in assignments(batches, centroids, rotation):
            np.add.at(sums, cluster, np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
        there = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(c) for c in sums[there].T)], names)

    # a row for each cluster from each task, a row for each cluster to the driver
    rows = stored.mapInArrow(work, ", ".join(f"{n} long" for n in names)).groupBy("cluster").agg(*(F.sum(n).alias(n) for n in names[1:])).collect()
    after = centroids.copy()
    for row in rows:
        after[row.cluster] = [row[f"s{i}"] // row.n for i in range(dims)]
    return after


def cluster_vectors(
    vectors: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", leading: int = LEADING, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that is kept.

    Vectors of another length, and those with a null or non-finite component,
    are left out, and so are those with a component of LIMIT or more in size:
    their distances have no place in 64 bits. Components become floor(STEP * x). The
    first centroids are the vectors with the smallest SHA-256 of `1:` and the
    id (nothing for null ids), vectors of one id in their own order; fewer
    vectors than clusters make fewer clusters. Rows that repeat an id, or a
    vector, are vectors each. An empty table gives an empty table. Other columns
    play no part. The rotation is fitted on fit_rows vectors, those of the
    smallest hashes, and on nothing else depends the result.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, dims, id_col, vector_col)
    sample = np.array([r.x for r in kept.orderBy(F.xxhash64("vec_id", "x")).limit(fit_rows).select("x").collect()], np.float64).reshape(-1, dims)
    rotation = Rotation(sample, leading)
    stored = store(kept, rotation, dims)
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r.x for r in stored.orderBy(name, "x").limit(clusters).select("x").collect()], np.int64).reshape(-1, dims)
    for _ in range(rounds):
        centroids = moved(stored, centroids, rotation)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in assignments(batches, centroids, rotation):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = written(stored.mapInArrow(work, "vec_id long, cluster int, distance long"), "assigned")
    sums = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    rows = [(c, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    # one row for each cluster
    return assigned.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
