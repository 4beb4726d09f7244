from __future__ import annotations

from collections import defaultdict

import corpus_pipeline as P
import duckdb
import pytest
import __spark_entry__ as contract
from compare import difference, duck
from conftest import SF_DIR

from textwarden.llm.oracles import ORACLE_SQL
from textwarden.llm.queries import QUERIES
from textwarden.llm.secrets import scan_secrets
from textwarden.llm.simhash import fingerprint


def stage(name):
    return dict(P.STAGES)[name]


def test_registration():
    assert [n for n, _ in P.STAGES] == ["language", "exact_dedup", "near_dedup", "secrets", "packing"]
    names = set(contract.queries())
    assert {*QUERIES, "pipeline"} <= names and {n.split("_")[0] for n in QUERIES} >= {f"op{i}" for i in range(1, 11)}
    assert set(ORACLE_SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    try:
        con = duck(SF_DIR)
    except duckdb.Error as error:
        pytest.skip(str(error))
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLE_SQL[name]) == ""


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    known = stage("language")(spark, docs, SF_DIR)
    assert known.columns == columns
    gone = docs.join(known, "doc_id", "left_anti").collect()
    assert len(gone) <= 0.02 * docs.count()

    rows = known.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    unique = stage("exact_dedup")(spark, known, SF_DIR)
    assert unique.columns == columns and sorted(unique.collect()) == sorted(r for r in rows if r.doc_id == max(groups[r.text or ""]))

    rows = unique.collect()
    marks = {r.doc_id: fingerprint(r.text) for r in rows}
    root = {i: i for i in marks}
    ids = sorted(marks)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (marks[i] ^ marks[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    one = stage("near_dedup")(spark, unique, SF_DIR)
    assert one.columns == columns and sorted(one.collect()) == sorted(r for r in rows if find(r.doc_id) == r.doc_id)

    masked = stage("secrets")(spark, one, SF_DIR)
    assert masked.columns == columns
    before, after = ({r.doc_id: r for r in x.collect()} for x in (one, masked))
    assert before.keys() == after.keys()
    holding = {r.doc_id for r in scan_secrets(one).where("size(spans) > 0").collect()}
    assert {i for i in before if before[i].text != after[i].text} == holding
    assert all(before[i] == after[i] for i in before if i not in holding)
    assert all(after[i].n_chars == len(after[i].text) and "[SECRET]" in after[i].text for i in holding)

    pieces = stage("packing")(spark, masked, SF_DIR).collect()
    assert {r.doc_id for r in pieces} == set(after)
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(tokens.values()) == sum(r.length for r in pieces)


def test_pipeline_query(spark):
    assert contract.queries()["pipeline"](spark, SF_DIR).count() > 0


def test_stages_take_empty_and_awkward_tables(spark, empty):
    for _, made in P.STAGES:
        assert made(spark, empty, SF_DIR).count() == 0
    docs = spark.createDataFrame(
        [(1, None, "en", None, 0), (2, "", None, "s", 0), (None, "kept words here", "en", "s", 15), (3, "kept words here", "en", "s", 15)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    rows = docs
    for _, made in P.STAGES[:-1]:
        rows = made(spark, rows, SF_DIR)
        assert rows.columns == docs.columns
    assert [r.doc_id for r in rows.collect()] == [3]
