from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textwarden.llm.sharding import capacities, ring_point, runs_of_arcs, shard_rows, virtual_nodes


def slots_are_gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows(awkward):
    rows = awkward.collect()
    found = shard_rows(awkward, shards=5).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    counts = Counter(r.shard for r in found)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(5)) <= 1 and slots_are_gapless(found)


def test_one_row_repeated_fills_all_shards(spark):
    df = spark.range(1000).selectExpr("CAST(if(id < 700, 7, id) AS long) AS doc_id", "if(id < 700, 'x', 'y') AS text")
    found = shard_rows(df, shards=9).collect()
    assert len(found) == 1000 and slots_are_gapless(found)
    assert set(Counter(r.shard for r in found).values()) == {111, 112}


@pytest.mark.parametrize("epsilon", [0.0, 0.25])
def test_each_row_goes_to_the_next_shard_with_room(spark, epsilon):
    """The plan in runs against a walk round the ring, row by row, in the same rounds."""
    n, shards = 2000, 6
    df = spark.range(n).selectExpr("id AS doc_id", "'t' AS text")
    nodes = virtual_nodes(spark, shards, 16)
    points = {r.id: r.p for r in spark.range(n).select("id", ring_point(F.col("id")).alias("p")).collect()}
    own = {i: next((k for k, (p, _) in enumerate(nodes) if p >= at), 0) for i, at in points.items()}
    order = sorted(points, key=lambda i: (own[i], points[i], i))
    limit, taken, place = capacities(n, shards, epsilon), [0] * shards, {}
    pending = [(i, own[i]) for i in order]
    while pending:
        room, left = [t < c for t, c in zip(taken, limit)], []
        for i, node in pending:
            while not room[nodes[node][1]]:
                node = (node + 1) % len(nodes)
            shard = nodes[node][1]
            if taken[shard] < limit[shard]:
                place[i], taken[shard] = (shard, taken[shard]), taken[shard] + 1
            else:
                left.append((i, node))
        pending = left
    found = shard_rows(df, shards, 16, epsilon).collect()
    assert {r.doc_id: r.shard for r in found} == {i: s for i, (s, _) in place.items()}
    assert max(taken) <= max(limit) and slots_are_gapless(found)


def test_looser_bounds_move_fewer_rows(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "'t' AS text")

    def moved(epsilon):
        before, after = ({r.doc_id: r.shard for r in shard_rows(df, s, 64, epsilon).collect()} for s in (10, 11))
        return sum(before[i] != after[i] for i in before) / len(before)

    assert moved(1.0) < 0.2 and moved(1.0) < moved(0.0) < 0.9


def test_runs_cover_every_arc():
    counts, owners = [5, 0, 7, 1, 9], [0, 1, 0, 2, 1]
    runs = runs_of_arcs(counts, owners, capacities(22, 3, 0.0))
    for arc, n in enumerate(counts):
        assert sorted(x for a, first, end, _, _ in runs if a == arc for x in range(first, end)) == list(range(n))
    slots = Counter((s, slot + x) for _, first, end, s, slot in runs for x in range(end - first))
    assert max(slots.values(), default=0) == 1 and len(slots) == 22


def test_empty_table(empty):
    assert shard_rows(empty).count() == 0
