"""Corpus pipeline: documents in, packed training sequences out.

Every stage applies one operator of ``textwarden.llm`` to all rows of the stage before; its result is written and read
again. All stages but the last return the columns of ``documents``. Rows without an id are told apart by their text
where the stage looks at texts; the near-duplicate stage cannot tell them apart and treats them as one document.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import langid
from textwarden.llm.exact_dedup import deduplicate
from textwarden.llm.packing import pack_documents
from textwarden.llm.secrets import redacted, scan_secrets
from textwarden.llm.ship import ship
from textwarden.llm.simhash import near_duplicates
from textwarden.sources.scratch import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"
SIMHASH_WORDS, SIMHASH_BITS = 4, 4


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null or without a letter, or scored under the calibrated limit."""
    ship(spark)
    found = langid.identify(docs.select(F.struct(*docs.columns).alias("doc"), docs["text"]), langid.fit(docs))
    return found.where(~F.col("rejected")).select("doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts only the row with the largest id goes on."""
    ship(spark)
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints of 4-word shingles link at 4 or fewer differing bits, only the one with
    the smallest id goes on (op1's operator with op1's contract)."""
    ship(spark)
    found = near_duplicates(docs, distance=SIMHASH_BITS, words=SIMHASH_WORDS)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay"]), "left_semi")


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and the number of characters follows; every document goes on."""
    found = scan_secrets(docs, spans_col="__spans")
    masked = found.withColumn("text", F.expr(redacted("text", "__spans")))
    return masked.withColumn(
        "n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    ship(spark)
    return pack_documents(docs, Path(public_tokenizers.path(TOKENIZER)).read_text(encoding="utf-8"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secrets_masked),
    ("packing", packed),
]

# Fingerprint components, a trained model and a tokenizer are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
