"""The hash chain of the audit log: appending and checking.

Every entry's hash covers the hash of the entry before it, so a chain is computed in order, whatever its length; a
log spreads over the cluster by having many chains. The one task of a chain streams through it and does nothing
but hash: texts are escaped before they get there. A chain of more than ``LONG_ROWS`` entries is sorted by all tasks and
hashed run after run, each from the hash that the one before ended with; only what is hashed goes there, and the other
columns are joined with the hashes afterwards. Checking needs no order at all: it compares neighbours.

A chain that must be hashed by several tasks can be cut into segments of ``segment_rows`` entries, if the caller asks
for it: each segment then starts from a seed that depends on the chain and the segment's number. As anybody can
compute such a seed, neighbours do not tell whether a whole segment was replaced. The ends of all segments are
therefore recorded (``segment_ends``), sealed by a chain of their own (``seals``), and compared (``check_segments``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.canonical import GENESIS, entry_hash, hash_head, hash_tail
from textwarden.sources.scratch import materialise, new_path

# Neighbours are found inside blocks of this many entries; only the last entry of each block crosses over.
BLOCK_ROWS = 100_000
# Unbroken chains of more new entries are sorted by range, in parts of about ``PART_ROWS``, and so many are hashed at once.
LONG_ROWS, PART_ROWS = 800_000, 100_000
# Lists of chains or entries are broadcast if their rows and texts together stay below this, else joined by a
# shuffle.
BROADCAST_BYTES = 16 * 1024 * 1024
ROW_BYTES = 64

MAIN_CHAIN = "main"
HASHED = ("action_taken", "event_type", "original_text", "timestamp")


def segment_of(segment_rows: int | None) -> Column:
    """Number, from 0, of the run of ``segment_rows`` entries that ``seq`` falls in; 0 for an unbroken chain."""
    if segment_rows is None:
        return F.lit(0).cast("long")
    return F.expr(f"(seq - 1) div {segment_rows}L")


def begins_segment(segment_rows: int | None) -> Column:
    seq = F.col("seq")
    return seq == 1 if segment_rows is None else (seq - 1) % segment_rows == 0


def segment_seed(chain_id: Column, segment: Column) -> Column:
    """What the first entry of a segment links to."""
    return F.when(segment == 0, F.lit(GENESIS)).otherwise(
        F.sha2(F.concat_ws(":", F.lit(GENESIS), chain_id, segment.cast("string")), 256)
    )


def append_chain(
    entries: DataFrame,
    heads: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    order_by: Sequence[str] = ("timestamp",),
    segment_rows: int | None = None,
) -> DataFrame:
    """Number and hash new entries, continuing each chain from its head.

    ``entries`` needs ``chain_id``, ``timestamp``, ``event_type``, ``original_text`` and ``action_taken``;
    ``order_by`` must order the new entries of a chain totally. ``heads`` holds ``chain_id, last_seq,
    last_hash``, or gives them for the written entries. Adds ``seq``, ``prev_hash`` and ``hash``.

    The entries are written once before they are counted and hashed, so that what produced them runs once. Every
    chain is unbroken unless ``segment_rows`` is given: then chains with more new entries than that are numbered by a
    distributed rank, and no task hashes more than a segment. Unbroken chains with more than ``LONG_ROWS`` new entries are
    hashed in runs, one after another.
    """
    if segment_rows is not None and segment_rows < 1:
        raise ValueError("segment_rows must be positive")
    entries = materialise(
        entries.withColumns(
            {
                "chain_id": F.coalesce(F.col("chain_id"), F.lit(MAIN_CHAIN)),
                "_entry": F.monotonically_increasing_id(),
            }
        ),
        "entries",
    )
    heads = heads(entries) if callable(heads) else heads
    if heads is not None:
        heads = heads.select("chain_id", "last_seq", "last_hash")
    stored = entries
    # Escaped where the entries are read, by all cores, and not in the task of a chain.
    entries = _escaped(stored)
    most = LONG_ROWS if segment_rows is None else segment_rows
    total = stored.count()
    if total <= most:
        return _hash_small(entries, heads, order_by, segment_rows)
    large = materialise(
        entries.groupBy("chain_id").count().filter(F.col("count") > most).select("chain_id", "count"), "large"
    )
    if large.isEmpty():
        return _hash_small(entries, heads, order_by, segment_rows)
    rows = large.agg(F.sum("count")).first()[0]
    large = large.select("chain_id")
    listed = _broadcast_if_small(large)
    small = _hash_small(entries.join(listed, "chain_id", "left_anti"), heads, order_by, segment_rows)
    if heads is not None:
        # Heads of large chains only; as few as those.
        heads = _broadcast_if_small(materialise(large.join(heads, "chain_id"), "large-heads"))
    if segment_rows is not None:
        hashed = _hash_large(entries.join(listed, "chain_id", "left_semi"), heads, order_by, segment_rows)
    elif rows < total:
        hashed = _hash_unbroken(stored.join(listed, "chain_id", "left_semi"), rows, heads, order_by)
    else:
        return _hash_unbroken(stored, rows, heads, order_by)
    return small.unionByName(hashed)


def _escaped(entries: DataFrame) -> DataFrame:
    head, tail = hash_head("action_taken", "event_type", "original_text"), hash_tail("timestamp")
    return entries.withColumns({"_head": F.expr(head), "_tail": F.expr(tail)})


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    texts = [F.sum(F.octet_length(c)) for c, t in df.dtypes if t == "string"]
    rows, *sizes = df.agg(F.count(F.lit(1)), *texts).first()
    size = rows * ROW_BYTES + sum(s or 0 for s in sizes)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _with_heads(entries: DataFrame, heads: DataFrame | None) -> DataFrame:
    if heads is None:
        return entries.withColumns(
            {"last_seq": F.lit(None).cast("long"), "last_hash": F.lit(None).cast("string")}
        )
    return entries.join(heads, "chain_id", "left")


def _hash_small(entries: DataFrame, heads: DataFrame | None, order_by: Sequence[str], segment_rows: int | None) -> DataFrame:
    # One shuffle by chain serves the join with the heads, the numbering and the hashing.
    w = Window.partitionBy("chain_id").orderBy(*order_by, "_entry")
    numbered = _with_heads(entries, heads).withColumn("_n", F.row_number().over(w).cast("long"))
    return _fold(_seeded(numbered, segment_rows).sortWithinPartitions("chain_id", *order_by, "_entry"))


def _hash_large(entries: DataFrame, heads: DataFrame | None, order_by: Sequence[str], segment_rows: int) -> DataFrame:
    ranks = _rank(entries.select("chain_id", *order_by, "_entry"), order_by)
    numbered = _with_heads(entries.join(ranks, "_entry"), heads)
    return _fold(
        _seeded(numbered, segment_rows)
        .repartition("chain_id", segment_of(segment_rows))
        .sortWithinPartitions("chain_id", "seq")
    )


def _hash_unbroken(entries: DataFrame, rows: int, heads: DataFrame | None, order_by: Sequence[str]) -> DataFrame:
    """Long chains: what is hashed is sorted by range, and the runs of parts of a chain are hashed one after another."""
    spark = entries.sparkSession
    columns = ["chain_id", *order_by, "_entry"]
    parts = -(-rows // PART_ROWS)
    given = entries.select(*dict.fromkeys([*columns, *HASHED])).repartitionByRange(parts, *columns)
    # Escaped behind the shuffle, as what is before it runs twice, the first time for the bounds of the ranges.
    ranked = _escaped(_ranked(given, columns, HASHED)).drop(*HASHED)
    path = new_path(spark, "parts")
    ranked.write.partitionBy("_part").parquet(path)
    ranked = spark.read.schema(ranked.schema).parquet(path)
    runs = materialise(_with_heads(_runs(ranked), heads), "runs")

    def hashed(run: list[int], start: str) -> tuple[str, list[str]]:
        """The last hash of a run of parts and the files with all of them; the first entry links to ``start`` if its chain
        began earlier."""
        here = F.col("_part").between(run[0], run[-1])
        numbered = ranked.filter(here).coalesce(1).join(F.broadcast(runs.filter(here)), ["chain_id", "_part"])
        ordered = _seeded(numbered.withColumn("_n", _place()), None).sortWithinPartitions("_at")
        links = materialise(_fold(ordered, start, ("_entry", "seq", "_at")), "hashes")
        return links.agg(F.max_by("hash", "_at")).first()[0], links.inputFiles()

    # Runs that a chain goes through wait for each other; others do not.
    queues: list[list[list[int]]] = []
    for part, before in runs.groupBy("_part").agg(F.max("_before")).orderBy("_part").collect():
        if not before:
            queues.append([[part]])
        elif len(queues[-1][-1]) * PART_ROWS < LONG_ROWS:
            queues[-1][-1].append(part)
        else:
            queues[-1].append([part])

    def in_turn(queue: list[list[int]]) -> list[str]:
        current, files = GENESIS, []
        for run in queue:
            current, written = hashed(run, current)
            files += written
        return files

    with ThreadPoolExecutor(max_workers=min(len(queues), spark.sparkContext.defaultParallelism)) as pool:
        files = [f for found in pool.map(inheritable_thread_target(spark)(in_turn), queues) for f in found]
    links = spark.read.schema("_entry long, seq long, prev_hash string, hash string").parquet(*files)
    return entries.drop("seq").join(links, "_entry").drop("_entry")


def _rank(keys: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """``_entry, _n``: the place of each entry in its chain, with no chain in one task.

    Sort the keys by range, which splits a chain over partitions; place = entries of the chain in earlier
    partitions + place in the own partition. Written once, as range boundaries are sampled anew in every run.
    """
    columns = ["chain_id", *order_by, "_entry"]
    ranked = materialise(_ranked(keys.repartitionByRange(*columns), columns), "ranked")
    return ranked.join(_runs(ranked), ["chain_id", "_part"]).select("_entry", _place().alias("_n"))


def _ranked(by_range: DataFrame, columns: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """Every partition sorted and numbered: ``_at`` rises with ``_part`` and with the place in it."""
    numbers = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    return by_range.sortWithinPartitions(*columns).select("chain_id", "_entry", *carried, *numbers)


def _runs(ranked: DataFrame) -> DataFrame:
    """``chain_id, _part, _first, _before``: where the entries of a chain begin in a part, and how many lie before it."""
    runs = ranked.groupBy("chain_id", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("chain_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(
        "chain_id", "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )


def _place() -> Column:
    return F.col("_before") + F.col("_at") - F.col("_first") + 1


def _seeded(numbered: DataFrame, segment_rows: int | None) -> DataFrame:
    seq = F.coalesce(F.col("last_seq"), F.lit(0)) + F.col("_n")
    # The link of an entry that does not follow another one of this batch and segment.
    seed = F.when(begins_segment(segment_rows), segment_seed(F.col("chain_id"), segment_of(segment_rows)))
    return numbered.withColumn("seq", seq).withColumn("_seed", seed.when(F.col("_n") == 1, F.col("last_hash")))


def _fold(ordered: DataFrame, start: str = GENESIS, only: Sequence[str] | None = None) -> DataFrame:
    """The rows, or their columns ``only``, with their links; the first row links to ``start`` if it has no seed."""
    dropped = {"_entry", "_n", "last_seq", "last_hash", "_seed", "_head", "_tail"}
    kept = [f for f in ordered.schema.fields if (f.name not in dropped if only is None else f.name in only)]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["prev_hash string", "hash string"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the running hash is kept from batch to batch.
        current = start
        for batch in batches:
            links, hashes = [], []
            columns = (batch.column(c).to_pylist() for c in ("_head", "_tail", "_seed"))
            for head, tail, seed in zip(*columns):
                previous = current if seed is None else seed
                current = hashlib.sha256(f'{head}"{previous}"{tail}'.encode()).hexdigest()
                links.append(previous)
                hashes.append(current)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(links, pa.string()), pa.array(hashes, pa.string())],
                names=[*names, "prev_hash", "hash"],
            )

    return ordered.mapInArrow(link, schema)


def chain_heads(audit: DataFrame) -> DataFrame:
    """``chain_id, last_seq, last_hash`` of every chain."""
    return audit.groupBy("chain_id").agg(
        F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("last_hash")
    )


def check_chain(
    audit: DataFrame,
    segment_rows: int | None = None,
    anchors: DataFrame | None = None,
    limit: int | None = None,
    newest: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Check entries against their neighbours; one row ``chain_id, seq, expected_hash, actual_hash, hash_ok,
    link_ok, gap`` per entry.

    ``expected_hash`` links the entry to the *stored* hash of its predecessor, so a changed hash flags its
    entry and the next. ``link_ok`` compares the stored link, ``gap`` tells that the numbers jump. ``anchors``
    (``chain_id, anchor_seq, anchor_hash``) stand in for purged predecessors, wherever they were. ``limit`` keeps the first
    entries by number, or the last ones if ``newest``; None or 0 keeps all.

    Texts are read once and not shuffled: each entry is hashed with its own stored link where it is read, and
    only numbers and hashes are compared with the neighbours. Where a stored link is wrong the entry is read
    and hashed again with the right one.
    """
    narrow = audit.select(
        "chain_id",
        "seq",
        "prev_hash",
        "hash",
        segment_of(block_rows).alias("_block"),
        F.expr(entry_hash(*HASHED, "prev_hash")).alias("_own"),
    )
    if limit and not newest:
        narrow = narrow.orderBy("seq", "chain_id").limit(limit)
    in_block = Window.partitionBy("chain_id", "_block").orderBy("seq")
    narrow = materialise(
        narrow.withColumns(
            {
                "_before_seq": F.lag("seq").over(in_block),
                "_before_hash": F.lag("hash").over(in_block),
                "_last": F.lead("seq").over(in_block).isNull(),
            }
        ),
        "links",
    )
    # The first entry of a block follows the last one of the block before it; one row per block each.
    by_block = Window.partitionBy("chain_id").orderBy("_block")
    carried = narrow.filter("_last").select(
        "chain_id",
        "_block",
        F.lag("seq").over(by_block).alias("_before_seq"),
        F.lag("hash").over(by_block).alias("_before_hash"),
    )
    firsts = narrow.filter("_before_seq IS NULL").drop("_before_seq", "_before_hash")
    firsts = firsts.join(carried, ["chain_id", "_block"], "left")
    linked = narrow.filter("_before_seq IS NOT NULL").unionByName(firsts)
    if anchors is not None:
        follows = F.col("_before_seq").eqNullSafe(F.col("seq") - 1)
        stand_ins = anchors.select("chain_id", (F.col("anchor_seq") + 1).alias("seq"), "anchor_hash").dropDuplicates(
            ["chain_id", "seq"]
        )
        jumps = linked.filter(~follows).join(stand_ins, ["chain_id", "seq"], "left")
        found = F.col("anchor_hash").isNotNull()
        jumps = jumps.withColumns(
            {
                "_before_seq": F.when(found, F.col("seq") - 1).otherwise(F.col("_before_seq")),
                "_before_hash": F.coalesce("anchor_hash", "_before_hash"),
            }
        ).drop("anchor_hash")
        linked = linked.filter(follows).unionByName(jumps)

    seed = segment_seed(F.col("chain_id"), segment_of(segment_rows))
    before = F.when(begins_segment(segment_rows), seed).otherwise(F.coalesce(F.col("_before_hash"), F.lit(GENESIS)))
    links = linked.select(
        "chain_id",
        "seq",
        "hash",
        "_own",
        before.alias("_before"),
        F.col("prev_hash").eqNullSafe(before).alias("link_ok"),
        (F.coalesce(F.col("_before_seq"), F.lit(0)) != F.col("seq") - 1).alias("gap"),
    )
    if limit and newest:
        links = materialise(links.orderBy(F.desc("seq"), "chain_id").limit(limit), "newest")

    # Numbers should be unique; the own hash and the right link keep duplicates apart where they are not.
    key = ["chain_id", "seq", "_own", "_before"]
    broken = materialise(links.filter(~F.col("link_ok")).select("chain_id", "seq", "_before"), "broken")
    expected = F.col("_own")
    if not broken.isEmpty():
        again = audit.join(_broadcast_if_small(broken), ["chain_id", "seq"]).select(
            "chain_id",
            "seq",
            F.expr(entry_hash(*HASHED, "prev_hash")).alias("_own"),
            "_before",
            F.expr(entry_hash(*HASHED, "_before")).alias("_again"),
        )
        links = links.join(again.dropDuplicates(key), key, "left")
        expected = F.when(F.col("link_ok"), expected).otherwise(F.col("_again"))
    return links.select(
        "chain_id",
        "seq",
        expected.alias("expected_hash"),
        F.col("hash").alias("actual_hash"),
        F.col("hash").eqNullSafe(expected).alias("hash_ok"),
        "link_ok",
        "gap",
    )


def invalid_entries(checked: DataFrame, links: bool = False) -> DataFrame:
    """Entries whose hash is wrong; with ``links`` also those with a wrong stored link or a gap before them."""
    bad = ~F.col("hash_ok")
    if links:
        bad = bad | ~F.col("link_ok") | F.col("gap")
    return checked.filter(bad)


def chain_report(checked: DataFrame) -> DataFrame:
    """One row: ``valid, entries_checked, invalid_count, broken_links, gaps, message``."""
    counts = checked.agg(
        F.count(F.lit(1)).alias("entries_checked"),
        F.count_if(~F.col("hash_ok")).alias("invalid_count"),
        F.count_if(~F.col("link_ok")).alias("broken_links"),
        F.count_if(F.col("gap")).alias("gaps"),
    )
    valid = F.col("invalid_count") == 0
    return counts.select(
        valid.alias("valid"),
        "entries_checked",
        "invalid_count",
        "broken_links",
        "gaps",
        F.when(valid, F.lit("Hash chain is intact"))
        .otherwise(F.concat(F.lit("Found "), F.col("invalid_count").cast("string"), F.lit(" invalid entries")))
        .alias("message"),
    )


def segment_ends(audit: DataFrame, segment_rows: int) -> DataFrame:
    """``chain_id, segment, last_seq, last_hash``: where each segment of a cut chain ends."""
    return audit.groupBy("chain_id", segment_of(segment_rows).alias("segment")).agg(
        F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("last_hash")
    )


def seals(ends: DataFrame) -> DataFrame:
    """``chain_id, segments, seal``: one hash over the ends of all segments of a chain, each linked to the one before."""
    ordered = F.sort_array(F.collect_list(F.struct("segment", "last_hash")))
    link = F.aggregate(
        ordered,
        F.lit(GENESIS),
        lambda acc, end: F.sha2(F.concat_ws(":", acc, end["segment"].cast("string"), end["last_hash"]), 256),
    )
    # One row per segment, that is per ``segment_rows`` entries.
    return ends.groupBy("chain_id").agg(F.count(F.lit(1)).alias("segments"), link.alias("seal"))


def check_segments(audit: DataFrame, recorded: DataFrame, segment_rows: int) -> DataFrame:
    """Segments whose end is not the recorded one: ``chain_id, segment, recorded_hash, found_hash``."""
    found = segment_ends(audit, segment_rows).select("chain_id", "segment", F.col("last_hash").alias("found_hash"))
    kept = recorded.select("chain_id", "segment", F.col("last_hash").alias("recorded_hash"))
    both = kept.join(found, ["chain_id", "segment"], "full")
    return both.filter(~F.col("recorded_hash").eqNullSafe(F.col("found_hash"))).select(
        "chain_id", "segment", "recorded_hash", "found_hash"
    )


def cut_tails(audit: DataFrame, heads: DataFrame) -> DataFrame:
    """Chains whose end differs from their recorded head: what a check of neighbours cannot see."""
    ends = chain_heads(audit).select(
        "chain_id", F.col("last_seq").alias("found_seq"), F.col("last_hash").alias("found_hash")
    )
    return (
        heads.join(ends, "chain_id", "left")
        .filter(
            ~F.col("last_seq").eqNullSafe(F.col("found_seq")) | ~F.col("last_hash").eqNullSafe(F.col("found_hash"))
        )
        .select("chain_id", "last_seq", "found_seq")
    )
