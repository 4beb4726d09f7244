from __future__ import annotations

import pytest

from textwarden.llm.ship import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    None, "", " ", "\n\t ", "plain words in a row", "plain words in a row", "A", "é" * 300, "x" * 50_000,
    "many words " * 6_000, "the same text again and again", "the same text again and again", "日本語 текст 😀 ́",
]


@pytest.fixture(autouse=True)
def on_workers(spark):
    ship(spark)


@pytest.fixture()
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like those of the results."""
    rows = [(i, t, "en") for i, t in enumerate(AWKWARD)]
    rows += [(4, AWKWARD[4], "en"), (4, AWKWARD[4], "en"), (None, "no id", None), (None, None, None)]
    schema = "doc_id long, text string, lang string"
    clash = "spans", "kept", "score", "shard", "fp", "ids", "rules", "key", "word", "size"
    return spark.createDataFrame(rows, schema).selectExpr("*", *[f"'own' AS {c}" for c in clash]).repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOCS)
