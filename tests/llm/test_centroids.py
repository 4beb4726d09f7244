from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from textwarden.llm.centroids import cluster, distances


def brute_force(rows, clusters, rounds, dims):
    """Plain k-means on floor(256 x), written without the lookup tables."""
    kept = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)
    ]
    seeded = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q, i) for i, q in kept if i is not None)
    cents = [list(q) for _, q, _ in seeded[:clusters]]

    def nearest(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in cents]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        members = {}
        for _, q in kept:
            members.setdefault(nearest(q)[0], []).append(q)
        for j, qs in members.items():
            cents[j] = [sum(col) // len(qs) for col in zip(*qs)]
    out = []
    for i, q in kept:
        j, d = nearest(q)
        out.append((i, j, d))
    per = {}
    for _, j, d in out:
        per[j] = per.get(j, 0) + d
    total = sum(per.values())
    digest = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(cents)}
    return sorted(((i, j, d, per[j], total, digest[j]) for i, j, d in out), key=_order)


def _order(row):
    return (row[0] is None, row[0] or 0, row[1:])


def got(df):
    columns = "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=_order)


def test_against_brute_force_with_awkward_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(60)]
    rows += [(3, rows[3][1]), (3, rows[3][1])]  # repeated rows and ids
    rows += [(None, rows[5][1]), (100, None), (101, [0.1] * 7), (102, [float("nan")] + [0.0] * 7)]
    rows += [(103, [float("inf")] + [0.0] * 7), (104, [None] + [0.0] * 7), (105, [1e9] + [0.0] * 7)]
    rows += [(106, [-0.001] * 8), (107, [0.0] * 8)]  # floors of negatives
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "7 AS cluster")
    df = df.selectExpr("*", "'x' AS distance", "'y' AS q").repartition(3)
    assert got(cluster(df, clusters=5, rounds=3, dims=8)) == brute_force(rows, 5, 3, 8)


def test_fewer_vectors_than_centroids_and_ties(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    result = got(cluster(df, clusters=40, rounds=5, dims=2))
    assert result == brute_force(rows, 40, 5, 2)
    assert len(result) == 3 and all(r[2] == 0 for r in result)


def test_empty_and_all_dropped(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cluster(empty).collect() == []
    bad = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert cluster(bad).collect() == []


def test_lookup_tables_equal_direct_distances():
    rng = np.random.default_rng(1)
    q = rng.integers(-300, 300, (500, 64))
    c = rng.integers(-300, 300, (40, 64))
    direct = ((q[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert np.array_equal(distances(q, c), direct)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_on_whole_table(spark, sf):
    from textwarden.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(QUERIES["op11_centroids"](spark, sf)) == brute_force(rows, 40, 5, 64)
