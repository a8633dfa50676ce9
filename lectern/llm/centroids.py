"""Centroid clustering of integer vectors with an incremental distance matrix.

Every vector keeps its exact integer dot products with all centroids, in a written
table. When a centroid moves, only its components that changed count: the dot product
grows by the vector's component times the change. The nearest centroid is then the
least of ``|c|^2 - 2 v.c``, to which ``|v|^2`` is added for the distance. A round moves
one row per cluster and partition and writes the table anew; vectors never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.tables import written

COMPONENTS, SCALE = 64, 64
CLUSTERS, ROUNDS, SEED = 16, 3, 1
#: Vectors are worked on in runs of so many rows.
SLICE_ROWS = 1 << 14


def kept_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Vectors (vec_id, embedding) with exactly so many components, none null or not finite, as whole numbers floor(scale * x): vec_id, v."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    # also where the filter is evaluated after the numbers: a component without a value is null, not an error
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where((F.size("embedding") == components) & finite).select(F.col("vec_id").cast("long"), whole.alias("v"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ``<seed>:<vec_id>`` has the least SHA-256, in that order; ties go to the smaller components, rows without vec_id come last."""
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    rows = hashed.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def check_range(kept: DataFrame) -> None:
    """All numbers must be exact in 64 bits, for every sum over the components of products of two differences."""
    greatest = kept.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("x"), F.max(F.size("v")).alias("n")).first()
    if greatest["x"] is not None and greatest["n"] * (2 * greatest["x"]) ** 2 >= 1 << 61:
        raise ValueError(f"components up to {greatest['x']} are too large for exact distances in 64 bits")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


_STATE = "vec_id long, v array<long>, norm long, dots array<long>"


def _with_dots(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(first, SLICE_ROWS)
                v = _matrix(rows.column("v"))
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), _lists(v), pa.array((v * v).sum(1)), _lists(v @ centroids.T)], ["vec_id", "v", "norm", "dots"])

    return run


def _updated(change: np.ndarray):
    """Adds to the dot products what the changed components of each centroid make of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(first, SLICE_ROWS)
                v, dots = _matrix(rows.column("v")), _matrix(rows.column("dots")).copy()
                for k in np.flatnonzero(change.any(1)):
                    at = np.flatnonzero(change[k])
                    dots[:, k] += v[:, at] @ change[k, at]
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("v"), rows.column("norm"), _lists(dots)], ["vec_id", "v", "norm", "dots"])

    return run


def _nearest(dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the smaller number, and its squared distance less the row's own square."""
    score = (centroids * centroids).sum(1) - 2 * dots
    k = score.argmin(1)
    return k, score[np.arange(len(k)), k]


def _sums(centroids: np.ndarray):
    """Vectors and their sum for each cluster of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
            for first in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(first, SLICE_ROWS)
                k, _ = _nearest(_matrix(rows.column("dots")), centroids)
                counts += np.bincount(k, minlength=len(centroids))
                order = np.argsort(k, kind="stable")
                here, starts = np.unique(k[order], return_index=True)
                sums[here] += np.add.reduceat(_matrix(rows.column("v"))[order], starts)
            has = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(counts[has]), _lists(sums[has])], ["cluster", "n", "sums"])

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids as the floors of their vectors' means; empty ones stay. One row per cluster reaches the driver."""
    partial = state.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    whole = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(centroids.shape[1])]
    new = centroids.copy()
    for row in partial.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *whole).collect():
        new[row["cluster"]] = [int(row[f"s{k}"]) // int(row["n"]) for k in range(centroids.shape[1])]
    return new


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(first, SLICE_ROWS)
                k, score = _nearest(_matrix(rows.column("dots")), centroids)
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(k, pa.int32()), pa.array(score + rows.column("norm").to_numpy())], ["vec_id", "cluster", "distance"])

    return run


def cluster(kept: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Vectors (vec_id, v) and first centroids to vec_id, cluster and squared distance after so many rounds, and the final centroids.

    Each row is a vector of its own, also with a null or repeated vec_id. Without centroids, so without vectors, the result is empty."""
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state = written(kept.mapInArrow(_with_dots(centroids), _STATE), "dots")
    for _ in range(rounds):
        new = _moved(state, centroids)
        if not (new != centroids).any():
            break  # so will all later rounds
        state, centroids = written(state.mapInArrow(_updated(new - centroids), _STATE), "dots"), new
    return state.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), centroids


def _sha256_of(numbers: Column) -> Column:
    return F.sha2(F.array_join(numbers.cast("array<string>"), ","), 256)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Vectors (vec_id, embedding) to vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256, one row for each vector kept.

    Vectors that are null, of another length, or with a null or infinite component or one that is no number are left out. Equal vectors have equal
    distances, and each counts. With fewer vectors than ``clusters`` there are as many centroids as vectors. An empty table gives an empty result; other
    columns are ignored. Components are exact up to 2^26 or so; larger ones are an error."""
    kept = kept_vectors(vectors)
    check_range(kept)
    assigned, centroids = cluster(kept, first_centroids(kept, clusters, seed), rounds)
    spark = vectors.sparkSession
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(k, sums.get(k, 0), sum(sums.values()), c.tolist()) for k, c in enumerate(centroids)]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    facts = table.select("cluster", "cluster_inertia", "inertia", _sha256_of(F.col("centroid")).alias("centroid_sha256"))
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
