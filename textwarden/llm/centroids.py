"""Centroid clustering of integer-quantised vectors by scalar lookup tables.

Every kept vector is quantised once (component ``x`` becomes ``floor(256 * x)``, ``x`` as double) and written as a
table, so each round reads only that table. A round is one pass over it: inside a task, for every dimension, the
integer values that occur there are tabulated against every centroid as squared differences; a vector's distances to
all centroids are then gathers from those tables, summed over the dimensions. The task hands on, per centroid, the
number of its vectors and their component sums; Spark adds these partial sums (at most tasks x centroids rows), and the
driver turns the at most ``clusters`` rows into the new centroids. Only centroids travel to the tasks, never tables of
the data, and no vector, group or cluster is ever gathered in one place: a cluster that holds a third of all rows is
summed in every task first.

Defined cases:
* kept: vectors of exactly ``DIMS`` components, none null or non-finite, and each with ``|x| < LIMIT`` so that all
  arithmetic is exact in 64 bits (distances under 2^62). Other rows (null vector, other lengths, NaN, infinities, null
  components, larger magnitudes) take no part and are not returned.
* seeds: the ``clusters`` kept vectors with the smallest lowercase-hex sha256 of ``2:<vec_id>``, in ascending hash
  order; rows with a null ``vec_id`` are clustered but never seeds; equal hashes (a repeated id) are ordered by the
  quantised vector, then the id. With fewer kept vectors than ``clusters``, all of them are seeds. No kept vector: an
  empty result.
* repeated rows and ids are clustered as rows of their own and returned once each; equal seeds are allowed, and ties
  go to the smaller centroid number, so a later copy stays empty (and unchanged).
* extra columns are not read; names of the table cannot clash with the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.sources.scratch import materialise

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED_SALT = "2:"
# Components of at most this magnitude keep every sum of squared differences under 2^62.
LIMIT = float(1 << 19)


def quantised(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """``vec_id, q, seed_key`` of the kept vectors; ``q`` holds ``floor(256 * x)`` as longs."""
    vec = table[vec_col].cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(LIMIT)))
    kept = table.select(table[id_col].cast("long").alias("vec_id"), vec.alias("v")).where(
        (F.size("v") == dims) & fine
    )
    return kept.select(
        "vec_id",
        F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("q"),
        F.sha2(F.concat(F.lit(SEED_SALT), F.col("vec_id").cast("string")), 256).alias("seed_key"),
    )


def seeds(points: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The first centroids: a top-``clusters`` of the kept vectors by seed hash (at most ``clusters`` rows collected)."""
    first = (
        points.where(F.col("vec_id").isNotNull())
        .orderBy("seed_key", "q", "vec_id")
        .limit(clusters)
        .select("q")
        .collect()
    )
    return np.array([r.q for r in first], dtype=np.int64).reshape(len(first), len(first[0].q) if first else 0)


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances ``(rows, centroids)`` by one lookup table per dimension over the values that occur there."""
    total = np.zeros((len(q), len(centroids)), dtype=np.int64)
    for d in range(q.shape[1]):
        values, where = np.unique(q[:, d], return_inverse=True)
        table = (values[:, None] - centroids[None, :, d]) ** 2
        total += table[where.reshape(-1)]
    return total


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    flat = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(batch.num_rows, dims)


def _partial_sums(centroids: np.ndarray, dims: int):
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k, dtype=np.int64)
        sums = np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q = _vectors(batch, dims)
            nearest = distances(q, centroids).argmin(axis=1)
            counts += np.bincount(nearest, minlength=k)
            np.add.at(sums, nearest, q)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_pydict(
                {
                    "cluster": pa.array(used.astype(np.int32)),
                    "n": pa.array(counts[used]),
                    **{f"s{d}": pa.array(sums[used, d]) for d in range(dims)},
                }
            )

    return run


def _assigned(centroids: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            found = distances(_vectors(batch, dims), centroids)
            nearest = found.argmin(axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id"),
                    "cluster": pa.array(nearest.astype(np.int32)),
                    "distance": pa.array(found[np.arange(len(found)), nearest]),
                }
            )

    return run


def next_centroids(spark: SparkSession, points: DataFrame, centroids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """One round: assign every vector, then each non-empty centroid becomes the exact floor of its vectors' mean."""
    schema = "cluster int, n long, " + ", ".join(f"s{d} long" for d in range(dims))
    partial = points.select("q").mapInArrow(_partial_sums(centroids, dims), schema)
    summed = (
        partial.groupBy("cluster")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{d}").cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)])
        .collect()
    )
    moved = centroids.copy()
    for row in summed:
        moved[row.cluster] = [int(row[f"s{d}"]) // row.n for d in range(dims)]
    return moved


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id",
            vec_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    spark = table.sparkSession
    points = materialise(quantised(table, id_col, vec_col, dims), "centroids-points")
    centroids = seeds(points, clusters)
    out = "vec_id long, cluster int, distance long"
    if len(centroids) == 0:
        return spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = next_centroids(spark, points, centroids, dims)
    assigned = materialise(points.select("vec_id", "q").mapInArrow(_assigned(centroids, dims), out), "centroids-assigned")
    digests = spark.createDataFrame(
        [(i, ",".join(str(int(x)) for x in c)) for i, c in enumerate(centroids)], "cluster int, components string"
    ).select("cluster", F.sha2("components", 256).alias("centroid_sha256"))
    per_cluster = assigned.groupBy("cluster").agg(F.sum("distance").cast("long").alias("cluster_inertia"))
    summary = per_cluster.join(digests, "cluster").withColumn(
        "inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))).cast("long")
    )
    # The summary has at most ``clusters`` rows: a bounded broadcast.
    return assigned.join(F.broadcast(summary), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

