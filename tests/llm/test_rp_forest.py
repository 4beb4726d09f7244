from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textwarden.llm import rp_forest
from textwarden.llm.rp_forest import grow, nearest

SCHEMA = "vec_id long, embedding array<float>, rank string"


def plain(vectors, queries, k):
    ids = np.array(sorted(vectors))
    table = np.array([vectors[i] for i in ids], np.float32).astype(float)
    out = {}
    for q in queries:
        scores = table @ np.array(vectors[q], np.float32).astype(float)
        out[q] = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != q)[:k]
    return out


def collected(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_clusters_and_noise(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    points = np.concatenate([centres[rng.integers(0, 30, 2000)] + 0.3 * rng.normal(size=(2000, 16)), rng.normal(size=(1000, 16))])
    vectors = {i: p.tolist() for i, p in enumerate(points)}
    df = spark.createDataFrame([(i, v, "own") for i, v in vectors.items()], SCHEMA).repartition(5)
    found, want = collected(nearest(df, F.col("vec_id") % 20 == 0, 10)), plain(vectors, range(0, 3000, 20), 10)
    assert found.keys() == want.keys() and all(len(f) == 10 for f in found.values())
    hits = [len({i for _, i in want[q]} & {i for _, i in found[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    for q, rows in found.items():
        assert rows == sorted(rows)
        for score, i in rows:
            product = float(np.array(vectors[q], np.float32).astype(float) @ np.array(vectors[i], np.float32).astype(float))
            assert -score == pytest.approx(product, abs=1e-9)


def test_ties_and_a_third_of_all_rows_in_one_vector(spark):
    rng = np.random.default_rng(2)
    vectors = {i: ([1.0, 0.5, 0.0] if i % 3 == 0 else rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(900)}
    rows = [(i, v, "x") for i, v in vectors.items()]
    vectors = {i: v for i, v in vectors.items() if any(v)}
    found = collected(nearest(spark.createDataFrame(rows, SCHEMA).repartition(6), F.col("vec_id") % 20 == 0, 20, recall=1.0))
    want = plain(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert found.keys() == want.keys()
    for q in want:
        assert [i for _, i in found[q]] == [i for _, i in want[q]]


def test_unusable_vectors_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0], ""), (20, [0.5, 1.0], ""), (1, [2.0, 1.0], ""), (2, None, ""), (3, [0.0, 0.0], ""), (4, [1.0, None], ""),
        (5, [float("nan"), 1.0], ""), (6, [float("inf"), 1.0], ""), (7, [1.0], ""), (None, [1.0, 1.0], ""), (8, [], ""), (20, [0.5, 1.0], ""),
    ]
    found = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20)
    assert {i for rows in collected(found.dropDuplicates(["query_id", "vec_id"])).values() for _, i in rows} <= {0, 1, 20}
    first = [(r.vec_id, r.score) for r in found.where("query_id = 0").orderBy("rank").collect()]
    assert first[0] == (1, 2.0) and (20, 0.5) in first
    none = spark.createDataFrame([], SCHEMA)
    assert nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_queue_opens_leaves_by_violated_margin():
    rng = np.random.default_rng(4)
    sample = rng.normal(size=(2000, 8))
    longest = float(np.linalg.norm(sample, axis=1).max())
    forest = grow(sample, 2000, longest, trees=3, leaf=100)
    query = sample[7]
    order = forest.search(query, forest.trees << forest.depth)
    assert len(order) == len(set(order)) == forest.trees << forest.depth
    costs = []
    for tree, leaf in order:
        node, cost = (1 << forest.depth) - 1 + leaf, 0.0
        while node:
            parent = (node - 1) // 2
            margin = forest.directions[tree][parent] @ np.append(query, 0.0) - forest.medians[tree][parent]
            cost += margin**2 if (node == 2 * parent + 2) != (margin > 0) else 0.0
            node = parent
        costs.append(cost)
    assert costs == pytest.approx(sorted(costs))
    sizes = np.bincount(forest.leaves(sample)[0], minlength=1 << forest.depth)
    assert sizes.max() <= 3 * sizes.mean()


def test_slices_and_parts_of_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = {i: v.tolist() for i, v in enumerate(rng.normal(size=(900, 8)))}
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], SCHEMA).repartition(4)
    for name, value in {"SLICE": 60, "BLOCK": 150, "DEEPEST": 1}.items():
        monkeypatch.setattr(rp_forest, name, value)
    classes = df.selectExpr("vec_id AS class_id", "cast(embedding AS array<double>) AS vec")
    queries = classes.where("class_id % 3 = 0")
    sample = np.array([r.vec for r in classes.orderBy("class_id").collect()])
    forest = grow(sample, 900, float(np.linalg.norm(sample, axis=1).max()), trees=2)
    met = rp_forest._candidates(classes, queries, forest, 4, 900, 5)
    got = {(r["query"], r.class_id) for r in met.collect()}
    scores = sample[::3] @ sample.T
    for at, q in enumerate(range(0, 900, 3)):
        assert {(q, int(i)) for i in np.argsort(-scores[at])[:6]} <= got
    assert set(rp_forest.spread(pa.array([-3, 0, 5, 900]), 7)) <= set(range(7))
