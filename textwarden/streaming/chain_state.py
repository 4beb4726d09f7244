"""The audit chain as a stateful stream: each chain's head lives in the state store.

Entries are grouped by ``chain_id`` and handed to ``transformWithStateInPandas``. For every chain that a micro-batch
touches, the processor reads the chain's last ``seq`` and ``hash`` from its value state, numbers and hashes the new
entries in ``order_by`` order (texts were escaped before the shuffle, by all cores, as the batch chain does), and stores
the new head. Exactly-once comes from the checkpoint: state and sink commit with the batch, a replayed batch starts
from the state of the batch before. Only chains that receive entries are touched; nothing is re-read from the log.
Time within a stream: entries of a later micro-batch follow those of earlier ones; ``order_by`` orders one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textwarden.functions.canonical import GENESIS, hash_head, hash_tail
from textwarden.operators.chain import MAIN_CHAIN

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEAD = StructType([StructField("seq", LongType()), StructField("hash", StringType())])


class ChainHeads(StatefulProcessor):
    """Numbers and links the entries of one chain, continuing from the head kept in state."""

    def __init__(self, order_by: Sequence[str], out: Sequence[str]):
        self.order_by = list(order_by)
        self.out = list(out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order_by, kind="stable")
        seq, current = self.head.get() if self.head.exists() else (0, GENESIS)
        links, hashes = [], []
        for head, tail in zip(batch["hashed_head"], batch["hashed_tail"]):
            links.append(current)
            current = hashlib.sha256(f'{head}"{current}"{tail}'.encode()).hexdigest()
            hashes.append(current)
        batch = batch.assign(seq=range(seq + 1, seq + 1 + len(batch)), prev_hash=links, hash=hashes)
        self.head.update((int(seq + len(batch)), current))
        yield batch[self.out]

    def close(self) -> None:
        pass


def chained_stream(entries: DataFrame, order_by: Sequence[str] = ("timestamp",), keep: Sequence[str] = ()) -> DataFrame:
    """``chain_id, seq, timestamp, event_type, original_text, action_taken, prev_hash, hash`` and ``keep`` columns
    of a stream of audit entries; a null ``chain_id`` is the main chain."""
    prepared = entries.select(
        F.coalesce(F.col("chain_id"), F.lit(MAIN_CHAIN)).alias("chain_id"),
        *{c: None for c in [*order_by, *keep, "timestamp", "event_type", "original_text", "action_taken"]},
        F.expr(hash_head("action_taken", "event_type", "original_text")).alias("hashed_head"),
        F.expr(hash_tail("timestamp")).alias("hashed_tail"),
    )
    names = ["chain_id", "seq", "timestamp", "event_type", "original_text", "action_taken", "prev_hash", "hash"]
    names += [c for c in keep if c not in names]
    fields = [
        StructField(c, LongType() if c == "seq" else StringType() if c in ("prev_hash", "hash") else prepared.schema[c].dataType)
        for c in names
    ]
    return prepared.groupBy("chain_id").transformWithStateInPandas(
        statefulProcessor=ChainHeads(order_by, names),
        outputStructType=StructType(fields),
        outputMode="Append",
        timeMode="None",
    )


def run_in_parts(spark, source: DataFrame, order_col: str, parts: int, to_entries, order_by: Sequence[str],
                 keep: Sequence[str], folder: str) -> DataFrame:
    """Feed ``source`` to the chained stream in ``parts`` deliveries by ranges of ``order_col``; after each delivery
    the stream is started again from its checkpoint and runs one micro-batch. Returns what the sink holds."""
    # Ranges of the order as microseconds (for any numeric or time type); only where a part ends, so approximate.
    position = F.col(order_col).cast("timestamp").cast("double") if dict(source.dtypes)[order_col].startswith("timestamp") \
        else F.col(order_col).cast("double")
    ranked = source.select(position.alias("_position"))
    bounds = ranked.approxQuantile("_position", [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    edges = [None, *sorted(set(bounds)), None]
    schema = source.schema
    inbox, sink, checkpoint = f"{folder}/inbox", f"{folder}/sink", f"{folder}/checkpoint"

    def deliver(i: int) -> None:
        low, high = edges[i], edges[i + 1]
        part = source
        if low is not None:
            part = part.where(position >= F.lit(low))
        if high is not None:
            part = part.where(position < F.lit(high))
        part.write.mode("append").parquet(inbox)

    def run() -> None:
        stream = spark.readStream.schema(schema).parquet(inbox)
        previous = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        try:
            query = (
                chained_stream(to_entries(stream), order_by, keep)
                .writeStream.format("parquet")
                .option("path", sink)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start()
            )
        finally:
            if previous is None:
                spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
            else:
                spark.conf.set("spark.sql.streaming.stateStore.providerClass", previous)
        query.awaitTermination()

    for i in range(len(edges) - 1):
        deliver(i)
        run()
    return spark.read.parquet(sink)
