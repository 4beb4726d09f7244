"""Exact duplicates by Grace hashing.

1. Every task folds the equal texts of each of its Arrow batches with an open-addressing table and spills one record
   per distinct text, with the ids it stands for, to the shared folder. A text that makes up a third of the corpus
   is down to one record per batch here.
2. The spill is partitioned by hash bits, recursively: a bucket over ``bucket_bytes`` is split by its next bit until
   it fits or holds a single hash. Exact sizes come from the narrow columns of the spill, so every record moves once,
   to its final bucket, and not once per level.
3. A task reads its bucket into an open-addressing table that compares complete contents. Nothing relies on hashes
   being unique.

Null texts count as empty. Of equal texts the row with the largest id stays (null ids are the smallest; of repeated
ids the first record spilled). An empty table gives an empty result; other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.llm.columns import whole_text
from textwarden.sources.scratch import materialise

BUCKET_BYTES = 16 << 20
# Sizes are known for this many leading hash bits; a bucket is split no further.
HASH_BITS = 16


class ContentTable:
    """Open addressing with linear probing; entries are numbered in the order they came."""

    def __init__(self) -> None:
        self.mask = 1023
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []

    def entry(self, hashed: int, text: bytes) -> tuple[int, bool]:
        """Number of the entry with exactly this text, and whether it is new."""
        at = hashed & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == hashed and self.texts[e] == text:
                return e, False
            at = (at + 1) & self.mask
        self.slots[at] = e = len(self.texts)
        self.hashes.append(hashed)
        self.texts.append(text)
        if 2 * len(self.texts) > self.mask:
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.mask = 4 * self.mask + 3
        self.slots = [-1] * (self.mask + 1)
        for e, hashed in enumerate(self.hashes):
            at = hashed & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = e


@dataclass
class Entry:
    """What is known of one text: the record that stays, its id and place, and how many rows there are."""

    keep_id: int | None
    keep_rid: int
    rows: int = 0

    def add(self, doc_id: int | None, rid: int, rows: int) -> bool:
        """True if this record takes over as the one that stays."""
        self.rows += rows
        new, old = doc_id is not None, self.keep_id is not None
        if (new, doc_id or 0, -rid) > (old, self.keep_id or 0, -self.keep_rid):
            self.keep_id, self.keep_rid = doc_id, rid
            return True
        return False


def _contents(column: pa.Array) -> Iterable[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, the row with the largest id of every distinct text and the ids of all its rows."""
    from pyspark import TaskContext

    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        if not batch.num_rows:
            continue
        table, winners, members, best = ContentTable(), [], [], []
        ids, hashes = batch["__id"].to_pylist(), batch["__hash"].to_pylist()
        for i, (doc_id, hashed, text) in enumerate(zip(ids, hashes, _contents(batch["__text"]), strict=True)):
            e, new = table.entry(hashed, text)
            if new:
                winners.append(i)
                members.append([doc_id])
                best.append(0)
                continue
            held = ids[winners[e]]
            if doc_id is not None and (held is None or doc_id > held):
                winners[e], best[e] = i, len(members[e])
            members[e].append(doc_id)
        kept = batch.take(pa.array(winners, pa.int64()))
        n = len(winners)
        yield pa.RecordBatch.from_arrays(
            [
                *kept.columns,
                pa.array(range(rid, rid + n), pa.int64()),
                pa.array(members, pa.list_(pa.int64())),
                pa.array(best, pa.int32()),
            ],
            names=[*kept.schema.names, "__rid", "__ids", "__best"],
        )
        rid += n


def spill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The folded records as a table in the shared folder: the columns of ``docs`` without the text, and ``__id,
    __text, __null, __hash, __rid, __ids, __best``. Names that begin with two underscores are kept for this."""
    keyed = docs.select(
        *[docs[c] for c in docs.columns if c != text_col],
        docs[id_col].cast("long").alias("__id"),
        whole_text(docs, text_col).alias("__text"),
        docs[text_col].isNull().alias("__null"),
    ).withColumn("__hash", F.xxhash64("__text"))
    schema = T.StructType(
        [
            *keyed.schema.fields,
            T.StructField("__rid", T.LongType()),
            T.StructField("__ids", T.ArrayType(T.LongType())),
            T.StructField("__best", T.IntegerType()),
        ]
    )
    return materialise(keyed.mapInArrow(_folded, schema), "grace-spill")


def plan_buckets(sizes: dict[int, int], limit: int, bits: int = HASH_BITS) -> tuple[list[int], list[int], int]:
    """First bucket and number of buckets of each value of the leading hash bits, and how many buckets there are.

    The whole range is halved until a part fits. A single value over ``limit`` goes on by the bits that follow.
    """
    base, parts, buckets = [0] * (1 << bits), [1] * (1 << bits), 0
    before = [0]
    for v in range(1 << bits):
        before.append(before[-1] + sizes.get(v, 0))
    pending = [(0, 1 << bits)]
    while pending:
        low, high = pending.pop()
        total = before[high] - before[low]
        if total > limit and high - low > 1:
            middle = (low + high) // 2
            pending += [(middle, high), (low, middle)]
            continue
        n = max(1, -(-total // limit))
        base[low:high], parts[low:high] = [buckets] * (high - low), [n] * (high - low)
        buckets += n
    return base, parts, buckets


def _bucketed(records: DataFrame, bucket_bytes: int) -> DataFrame:
    """The spill with every bucket in a partition of its own."""
    spark = records.sparkSession
    lead = F.shiftrightunsigned("__hash", 64 - HASH_BITS).cast("int")
    # One row for each value of the leading bits: at most 65,536.
    found = (
        records.groupBy(lead.alias("lead"))
        .agg(F.sum(F.octet_length("__text") + F.lit(64)).alias("bytes"))
        .collect()
    )
    sizes = {r["lead"]: r["bytes"] for r in found}
    # Small inputs still use all cores.
    spread = sum(sizes.values()) // int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    base, parts, n = plan_buckets(sizes, min(bucket_bytes, spread))

    def by_lead(values: list[int]) -> Column:
        return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), lead)

    # The 16 bits after the leading ones.
    following = F.shiftrightunsigned("__hash", 64 - 2 * HASH_BITS).bitwiseAND((1 << HASH_BITS) - 1)
    bucket = by_lead(base) + F.pmod(following, by_lead(parts)).cast("int")
    return records.withColumn("__bucket", bucket).repartitionById(n, F.col("__bucket"))


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: the records' numbers and the entry each belongs to, when all of the bucket has been read."""
    table, entries, rids, members = ContentTable(), [], [], []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("__id", "__rid", "__rows", "__hash")]
        for doc_id, rid, rows, hashed, text in zip(*columns, _contents(batch["__text"]), strict=True):
            e, new = table.entry(hashed, text)
            if new:
                entries.append(Entry(doc_id, rid))
            entries[e].add(doc_id, rid, rows)
            rids.append(rid)
            members.append(e)
    for at in range(0, len(rids), 65_536):
        found = [entries[e] for e in members[at : at + 65_536]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rids[at : at + 65_536], pa.int64()),
                pa.array([x.keep_id for x in found], pa.int64()),
                pa.array([x.keep_rid for x in found], pa.int64()),
                pa.array([x.rows for x in found], pa.int64()),
            ],
            names=["__rid", "keep_id", "keep_rid", "group_size"],
        )


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: the whole record that stays of every text. Losers are let go as soon as they outnumber winners."""
    table, entries, place, held, rows = ContentTable(), [], [], [], 0

    def compacted() -> pa.Table:
        return pa.Table.from_batches(held).take(pa.array(place, pa.int64()))

    for batch in batches:
        held.append(batch)
        columns = [batch[c].to_pylist() for c in ("__id", "__rid", "__hash")]
        for i, (doc_id, rid, hashed, text) in enumerate(zip(*columns, _contents(batch["__text"]), strict=True)):
            e, new = table.entry(hashed, text)
            if new:
                entries.append(Entry(doc_id, rid))
                place.append(rows + i)
            elif entries[e].add(doc_id, rid, 0):
                place[e] = rows + i
        rows += batch.num_rows
        if rows > 2 * len(place) + 10_000:
            held, rows = compacted().to_batches(), len(place)
            place[:] = range(rows)
    if place:
        yield from compacted().combine_chunks().to_batches(max_chunksize=4096)


def classes(records: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``__rid, keep_id, keep_rid, group_size`` of every spilled record."""
    narrow = records.select("__id", "__rid", F.size("__ids").cast("long").alias("__rows"), "__hash", "__text")
    return _bucketed(narrow, bucket_bytes).mapInArrow(
        _resolve, "__rid long, keep_id long, keep_rid long, group_size long"
    )


def duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    records = spill(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    found = materialise(classes(records, bucket_bytes), "grace-classes")
    members = records.select("__rid", "__ids", "__best", F.sha2("__text", 256).alias("text_sha256")).select(
        "__rid", F.posexplode("__ids").alias("at", "doc_id"), "__best", "text_sha256"
    )
    stays = (F.col("__rid") == F.col("keep_rid")) & (F.col("at") == F.col("__best"))
    return members.join(found, "__rid").select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    records = spill(docs, id_col, text_col).drop("__ids", "__best")
    bucketed = _bucketed(records, bucket_bytes)
    stay = bucketed.mapInArrow(_survivors, bucketed.schema)
    text = F.when(~stay["__null"], stay["__text"]).alias(text_col)
    return stay.select(*[text if c == text_col else stay[c] for c in docs.columns])
