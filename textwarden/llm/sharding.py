"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A row's key hashes to one of ``POINTS`` points of the ring and belongs to the first virtual node clockwise from there.
A shard takes at most its capacity; keys that overflow a full shard go on clockwise to the next virtual node whose
shard has room. With ``epsilon`` 0 the capacities are the row count dealt out evenly, so any two shards differ by one
row at most; a larger ``epsilon`` moves fewer rows when a shard is added or removed.

Who overflows depends on counts alone, so the plan is made on one count per arc between virtual nodes
(``shards * vnodes`` numbers, whatever the size of the table): rows of an arc are numbered, and runs of numbers go to
shards. Everything that touches rows is a DataFrame expression:

* equal rows (same id, size and checksum) are counted before they are moved, so a key repeated without end is one row
  until it is dealt out;
* rows are numbered within ring points, of which there are 65,536, and points are added up within arcs;
* the joins are with the ring points and the runs, both of fixed size, and are broadcast.

Null texts have no bytes; null ids are a key like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.llm.columns import whole_text

POINTS = 1 << 16
ROW_BYTES = 8


def ring_point(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(POINTS)).cast("int")


def virtual_nodes(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """``(point, shard)`` clockwise. Adding a shard adds its nodes and moves no other; a point taken twice goes to the
    lower shard."""
    nodes = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("copy"))
        .select(ring_point(F.lit("node"), "shard", "copy").alias("point"), "shard")
        .groupBy("point")
        .agg(F.min("shard").alias("shard"))
    )
    return sorted((r["point"], r["shard"]) for r in nodes.collect())


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    """Most rows of each shard: the even deal, or that much more than the mean."""
    if epsilon:
        return [-int(-rows * (1 + epsilon) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def runs_of_arcs(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """``(arc, first, end, shard, slot)``: rows ``first`` to ``end`` of an arc take the slots of a shard from ``slot``.

    In rounds: all rows that still need a place stand at their next node whose shard has room, and a shard takes them
    in clockwise order of their arcs until it is full. Each round but the last fills a shard, so there are no more
    rounds than shards.
    """
    taken = [0] * len(capacity)
    pending = [(arc, 0, n, arc) for arc, n in enumerate(counts) if n]
    runs = []
    while pending:
        open_shards = [t < c for t, c in zip(taken, capacity, strict=True)]
        # The next node with room, for every node, by going round twice against the clock.
        onward, at = [0] * len(owners), 0
        for node in range(2 * len(owners) - 1, -1, -1):
            if open_shards[owners[node % len(owners)]]:
                at = node % len(owners)
            onward[node % len(owners)] = at
        left = []
        for arc, first, end, node in pending:
            node = onward[node]
            shard = owners[node]
            n = min(end - first, capacity[shard] - taken[shard])
            if n:
                runs.append((arc, first, first + n, shard, taken[shard]))
                taken[shard] += n
            if first + n < end:
                left.append((arc, first + n, end, node))
        pending = left
    return runs


def _values(spark: SparkSession, names: str, rows: list[tuple[int, ...]]) -> DataFrame:
    """A small table of whole numbers as literals."""
    if not rows:
        rows = [(-1,) * len(names.split())]
    text = ", ".join(f"({', '.join(map(str, r))})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names.split())})")


def shard_rows(
    docs: DataFrame,
    shards: int = 24,
    vnodes: int = 64,
    epsilon: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``; slots of a shard count from 0 without gaps."""
    spark = docs.sparkSession
    nodes = virtual_nodes(spark, shards, vnodes)
    places, owners = [p for p, _ in nodes], [s for _, s in nodes]
    # Points after the last node belong to the first: arc 0.
    arcs = [bisect_left(places, p) % len(places) for p in range(POINTS)]
    arc_of = F.get(F.split(F.lit(",".join(map(str, arcs))), ",").cast("array<int>"), F.col("point"))

    key = docs[id_col].cast("long")
    points = docs.select(ring_point(key).alias("point")).groupBy("point").count()
    in_arc = Window.partitionBy("arc").orderBy("point").rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("arc", arc_of).select(
        "point", "arc", "count", F.coalesce(F.sum("count").over(in_arc), F.lit(0)).alias("before")
    )
    totals = {r["arc"]: r["n"] for r in points.groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    counts = [totals.get(a, 0) for a in range(len(owners))]
    runs = runs_of_arcs(counts, owners, capacities(sum(counts), shards, epsilon))
    run_table = _values(spark, "run_arc first end shard base", runs)

    text = whole_text(docs, text_col)
    rows = docs.select(
        ring_point(key).alias("point"),
        key.alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Equal rows are told apart by nothing, so they are numbered as one.
    same = rows.groupBy("point", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    in_point = (
        Window.partitionBy("point").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = same.withColumn("rank", F.coalesce(F.sum("n").over(in_point), F.lit(0)))
    placed = numbered.join(F.broadcast(points.select("point", "arc", "before")), "point").withColumn(
        "begin", F.col("before") + F.col("rank")
    )
    # A row with many copies may reach over several runs.
    reached = placed.join(
        F.broadcast(run_table),
        (F.col("arc") == F.col("run_arc"))
        & (F.col("begin") < F.col("end"))
        & (F.col("begin") + F.col("n") > F.col("first")),
    )
    low = F.greatest("begin", "first")
    high = F.least(F.col("begin") + F.col("n"), F.col("end"))
    copies = reached.select(
        "doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(low, high - 1)).alias("at"), "base", "first"
    )
    slot = (F.col("base") + F.col("at") - F.col("first")).cast("long")
    return copies.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), slot.alias("slot"))
