"""One query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.bootstrap_pii import KINDS, find_pii
from textwarden.llm.centroids import cluster
from textwarden.llm.collocations import collocations
from textwarden.llm.chosen_path import near_duplicates as set_near_duplicates
from textwarden.llm.columns import documents
from textwarden.llm.exact_dedup import duplicate_classes
from textwarden.llm.langid import fit, held_out, identify
from textwarden.llm.lm_scoring import score_documents
from textwarden.llm.packing import pack_documents
from textwarden.llm.rp_forest import nearest
from textwarden.llm.secrets import BASE_RULES, RULES, scan_secrets
from textwarden.llm.sentencepiece import encode_documents
from textwarden.llm.sharding import shard_rows
from textwarden.llm.ship import ship
from textwarden.llm.simhash import near_duplicates
from textwarden.llm.spans import how_many, written


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacities dealt out evenly, so the law of row counts holds."""
    return shard_rows(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(find_pii(documents(spark, sf_dir)), list(KINDS), len(KINDS))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(documents(spark, sf_dir))


def _span_digest(found: DataFrame, kinds: list[str], base: int) -> DataFrame:
    """Counts and digest of the spans of the first ``base`` kinds, and all spans written out."""
    own = "base_spans" if "base_spans" in found.columns else f"filter(spans, s -> s.kind < {base})"
    return found.selectExpr(
        "doc_id",
        *[f"{how_many(own, i)} AS n_{kind}" for i, kind in enumerate(kinds[:base])],
        f"sha2({written(own, kinds)}, 256) AS base_sha256",
        f"{written('spans', kinds)} AS spans",
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(scan_secrets(documents(spark, sf_dir).select("doc_id", "text")), [r.kind for r in RULES], len(BASE_RULES))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    content = Path(public_tokenizers.path(model)).read_bytes()
    return encode_documents(documents(spark, sf_dir), content).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, F.col("vec_id") % 20 == 0)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs.where(~out))
    found = identify(docs.select("doc_id", "text", out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    content = Path(public_tokenizers.path(tokenizer)).read_text(encoding="utf-8")
    return pack_documents(documents(spark, sf_dir), content).drop("ids")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = held_out(F.col("doc_id"), 10, 0)
    found = score_documents(docs, ~out)
    return found.withColumn("held_out", out)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_near_duplicates(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


Query = Callable[[SparkSession, str], DataFrame]


def _on_workers(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: _on_workers(f)
    for f in (
        op1_simhash,
        op2_bounded_ring,
        op3_pii,
        op4_exact_dedup,
        op5_secrets,
        op6_sentencepiece,
        op7_rp_forest,
        op8_langid,
        op9_packing,
        op10_lm_scoring,
        op11_centroids,
        op12_chosen_path,
        op13_collocations,
    )
}
