"""Taking what an operator needs from a table under names that cannot clash with the table's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(docs: DataFrame, name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text``: the id as long, the whole text with null as empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(docs, text_col).alias("text"))
