"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the inner product; vectors are given one more component that makes all lengths equal, so that the nearest
by angle are the nearest by product. Each tree splits by random directions at the median. The forest is fitted on a
bounded sample of ``SAMPLE`` vectors; every vector is indexed. A query walks all trees through one shared priority queue:
the node whose half-spaces it violates least comes next, whatever its tree, until ``visits`` leaves have been opened.
The vectors of these leaves are the candidates; they are ranked exactly.

How many leaves must be opened depends on the data. ``visits`` is set by measurement: ``CALIBRATION`` queries are
compared with all vectors, and the leaves are counted that hold the wanted share of their true neighbours.

Equal vectors are one entry of the index with the smallest ids it stands for: with ``k`` neighbours wanted, only the
``k + 1`` smallest ids of a vector can ever be returned, so nothing is lost when a third of all rows are one vector.
Leaves and queries meet in blocks (a subtree each) of about ``BLOCK`` vectors, and a block hands on the best few of each
query. A block that is larger, as the depth is bounded, is dealt to parts; queries come in slices of about ``SLICE``, each
with its own copy of the block, and are multiplied in tiles. So no task's memory grows with the table. Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors whose length is not the
commonest one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.sources.scratch import materialise

SAMPLE = 16_384
CALIBRATION = 64
BLOCK = 16_384
LEAF = 128
TREES = 8
# Leaves of a tree at most: the sample still tells their medians.
DEEPEST = 10
# Queries that meet a block in one task, and the sides of a tile of products there.
SLICE = 65_536
TILE = 1_024
# Candidates of a block beyond those wanted, as products are summed in another order there.
SPARE = 8


@dataclass
class Forest:
    """Heap-ordered nodes: the children of node ``i`` are ``2 i + 1`` and ``2 i + 2``; leaves follow the nodes."""

    directions: np.ndarray
    medians: np.ndarray
    depth: int
    longest: float

    @property
    def trees(self) -> int:
        return len(self.directions)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree, trees first."""
        lifted = lift(vectors, self.longest)
        out = np.zeros((self.trees, len(vectors)), np.int64)
        for tree in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", lifted, self.directions[tree][node]) > self.medians[tree][node]
                node = 2 * node + 1 + side
            out[tree] = node - ((1 << self.depth) - 1)
        return out

    def search(self, query: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """``(tree, leaf)`` in the order in which the shared queue opens them."""
        lifted = np.append(query, 0.0)
        margins = [((d @ lifted) - m).tolist() for d, m in zip(self.directions, self.medians, strict=True)]
        inner = (1 << self.depth) - 1
        queue = [(0.0, tree, 0) for tree in range(self.trees)]
        heapify(queue)
        found = []
        while queue and len(found) < visits:
            cost, tree, node = heappop(queue)
            # Down the side the query is on; the other side waits in the queue.
            while node < inner:
                margin = margins[tree][node]
                near = 2 * node + 1 + (margin > 0)
                heappush(queue, (cost + margin * margin, tree, 4 * node + 3 - near))
                node = near
            found.append((tree, node - inner))
        return found


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    return np.concatenate([vectors, rest[:, None]], 1)


def grow(sample: np.ndarray, rows: int, longest: float, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(rows, 1) / leaf)))))
    trees = trees if depth else 1
    lifted = lift(sample, longest)
    inner = (1 << depth) - 1
    directions = rng.normal(size=(trees, inner, lifted.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    medians = np.zeros((trees, inner))
    for tree in range(trees):
        node = np.zeros(len(lifted), np.int64)
        for _ in range(depth):
            side = np.einsum("ij,ij->i", lifted, directions[tree][node])
            order = np.lexsort((side, node))
            starts = np.flatnonzero(np.diff(node[order], prepend=-1))
            middle = starts + np.diff(np.append(starts, len(order))) // 2
            medians[tree][node[order][starts]] = side[order][middle]
            node = 2 * node + 1 + (side > medians[tree][node])
    return Forest(directions, medians, depth, longest)


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vec``: vectors that take part, as doubles."""
    vec = F.col("vec")
    typed = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("vec"))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = typed.where(vec.isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(vec, lambda x: x != 0))
    common = kept.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.where(F.size("vec") == (common["n"] if common else 0))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))


def _sample(classes: DataFrame, rows: int, at_most: int, salt: str) -> np.ndarray:
    share = min(1.0, at_most / max(rows, 1))
    point = F.pmod(F.xxhash64("class_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    found = classes.where(point < share).orderBy("class_id").select("vec").toArrow()["vec"].combine_chunks()
    return _vectors(found)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row, in any order."""
    if scores.shape[1] <= k:
        return scores, ids
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)


def spread(ids: pa.Array, shares: int) -> np.ndarray:
    """Share of every id, the same on both sides of a block; ids that follow a pattern are mixed first."""
    mixed = ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(shares)).astype(np.int64)


def true_neighbours(classes: DataFrame, queries: np.ndarray, k: int) -> list[list[int]]:
    """Exact nearest classes of a few queries, among all; a batch hands on its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = queries @ _vectors(batch["vec"]).T
            ids = np.broadcast_to(batch["class_id"].to_numpy(), scores.shape)
            scores, ids = _best(scores, ids, k)
            owner = np.repeat(np.arange(len(queries)), scores.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner), pa.array(ids.reshape(-1)), pa.array(scores.reshape(-1))], names=["q", "id", "score"]
            )

    found = classes.select("class_id", "vec").mapInArrow(run, "q long, id long, score double")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")))
    out: list[list[int]] = [[] for _ in queries]
    for row in ranked.where(F.col("r") <= k).collect():
        out[row["q"]].append(row["id"])
    return out


def leaves_needed(forest: Forest, classes: DataFrame, queries: np.ndarray, k: int, recall: float) -> int:
    """Leaves to open so that the queries meet the wanted share of their true neighbours (and themselves)."""
    everything = forest.trees << forest.depth
    if not len(queries) or not forest.depth:
        return everything
    wanted = true_neighbours(classes, queries, k + 1)
    ids = sorted({i for row in wanted for i in row})
    rows = classes.where(F.col("class_id").isin(ids)).select("class_id", "vec").toArrow().combine_chunks()
    vectors = _vectors(rows["vec"].combine_chunks())
    leaf_of = dict(zip(rows["class_id"].to_pylist(), forest.leaves(vectors).T.tolist(), strict=True))
    opened = []
    for query, row in zip(queries, wanted, strict=True):
        rank = {place: r for r, place in enumerate(forest.search(query, everything), 1)}
        # The nearest is the query itself, as a rule; it is found at once and would flatter the figure.
        opened += [min(rank[tree, leaf] for tree, leaf in enumerate(leaf_of[i])) for i in row[1:]]
    return int(np.quantile(opened, recall, method="higher")) if opened else everything


def vector_classes(vectors: DataFrame, k: int) -> DataFrame:
    """``class_id, vec, ids``: distinct vectors with the smallest ids they stand for; a table."""
    numbered = vectors.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id")))
    few = numbered.where(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialise(few.select(F.get("ids", 0).alias("class_id"), "vec", "ids"), "vector-classes")


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.94,
    trees: int = TREES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row that meets ``is_query`` (a condition on
    ``vec_id``), nearest first, equals by id, the row itself left out."""
    vectors = usable(table, id_col, vector_col)
    classes = vector_classes(vectors, k)
    rows, longest = classes.agg(
        F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))
    ).first()
    if not rows:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = materialise(
        vectors.where(is_query).join(classes.select("class_id", "vec"), "vec").select("vec_id", "class_id"), "vector-queries"
    )
    queries = classes.join(asking.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "vec")
    forest = grow(_sample(classes, rows, SAMPLE, "forest"), rows, longest, trees)
    visits = leaves_needed(forest, classes, _sample(classes, rows, CALIBRATION, "calibration"), k, recall)
    found = _candidates(classes, queries, forest, visits, rows, k)
    return _ranked(found, classes, queries, asking, k)


def _candidates(
    classes: DataFrame, queries: DataFrame, forest: Forest, visits: int, rows: int, k: int
) -> DataFrame:
    """``query, class_id``: the best candidates of every query in every block."""
    bits = min(forest.depth, max(1, int(np.ceil(np.log2(rows / BLOCK)))) if forest.depth else 0)
    shift = forest.depth - bits
    parts = max(1, -(-rows // (BLOCK << bits)))
    slices = max(1, -(-queries.count() // SLICE))
    content = pickle.dumps(forest)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(content)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch["vec"])
            for tree, leaf in enumerate(own.leaves(vectors)):
                block = ((tree << bits) + (leaf >> shift)) * parts + spread(batch["class_id"], parts)
                for piece in range(slices):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block * slices + piece), pa.array(leaf), batch["class_id"], batch["vec"]],
                        names=["block", "leaf", "class_id", "vec"],
                    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(content)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                place, blocks, leaves = [], [], []
                for i, query in enumerate(_vectors(batch["vec"])):
                    by_block: dict[int, list[int]] = {}
                    for tree, leaf in own.search(query, visits):
                        by_block.setdefault((tree << bits) + (leaf >> shift), []).append(leaf)
                    place += [i] * len(by_block)
                    blocks += by_block
                    leaves += by_block.values()
                took = batch.take(pa.array(place, pa.int64()))
                lists, own_slice = pa.array(leaves, pa.list_(pa.int64())), spread(took["class_id"], slices)
                for part in range(parts):
                    block = (np.array(blocks, np.int64) * parts + part) * slices + own_slice
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block), took["class_id"], took["vec"], lists], names=["block", "query", "vec", "leaves"]
                    )

    def meet(held: pa.Table, asked: pa.Table) -> pa.Table:
        wanted = k + 1 + SPARE
        empty = pa.table({"query": pa.array([], pa.int64()), "class_id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
        if not held.num_rows or not asked.num_rows:
            return empty
        held, asked = held.sort_by("leaf").combine_chunks(), asked.combine_chunks()
        vectors, ids = _vectors(held["vec"].combine_chunks()), held["class_id"].to_numpy()
        leaf = held["leaf"].to_numpy()
        query = _vectors(asked["vec"].combine_chunks())
        lists = asked["leaves"].combine_chunks()
        visited = lists.flatten().to_numpy()
        visitor = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        order = np.argsort(visited, kind="stable")
        visited, visitor = visited[order], visitor[order]
        scores, best = np.full((len(query), wanted), -np.inf), np.full((len(query), wanted), -1, np.int64)
        for number in np.unique(leaf):
            a, b = np.searchsorted(leaf, [number, number + 1])
            c, d = np.searchsorted(visited, [number, number + 1])
            for at in range(c, d, TILE):
                who = visitor[at : min(at + TILE, d)]
                for low in range(a, b, TILE):
                    high = min(low + TILE, b)
                    new = query[who] @ vectors[low:high].T
                    both = np.concatenate([scores[who], new], 1)
                    names = np.concatenate([best[who], np.broadcast_to(ids[low:high], new.shape)], 1)
                    scores[who], best[who] = _best(both, names, wanted)
        found = best >= 0
        return pa.table(
            {
                "query": pa.array(asked["query"].to_numpy()[np.nonzero(found)[0]]),
                "class_id": pa.array(best[found]),
                "near": pa.array(scores[found]),
            }
        )

    index_rows = classes.select("class_id", "vec").mapInArrow(
        index, "block long, leaf long, class_id long, vec array<double>"
    )
    probes = queries.select("class_id", "vec").mapInArrow(
        probe, "block long, query long, vec array<double>, leaves array<long>"
    )
    met = index_rows.groupBy("block").cogroup(probes.groupBy("block")).applyInArrow(
        meet, "query long, class_id long, near double"
    )
    best = met.groupBy("query", "class_id").agg(F.max("near").alias("near"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "class_id"))
    return best.withColumn("r", place).where(F.col("r") <= k + 1 + SPARE).select("query", "class_id")


def _ranked(found: DataFrame, classes: DataFrame, queries: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """Exact products of the candidates, spread to the ids of both sides."""
    product = F.aggregate(F.zip_with("qvec", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = (
        found.join(queries.select(F.col("class_id").alias("query"), F.col("vec").alias("qvec")), "query")
        .join(classes, "class_id")
        .select("query", product.alias("score"), F.explode("ids").alias("vec_id"))
    )
    # A query leaves out its own id, so one more is kept for each vector asked.
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    few = scored.withColumn("r", place).where(F.col("r") <= k + 1)
    lists = few.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    each = asking.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query")).join(lists, "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"
    )
