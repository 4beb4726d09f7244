from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from textwarden.functions.canonical import entry_hash, iso_timestamp
from textwarden.operators import chain as C

SCHEMA = "chain_id string, timestamp string, n int, event_type string, original_text string, action_taken string"


def digest(entry, previous):
    keys = ("timestamp", "event_type", "original_text", "action_taken")
    data = {k: entry[k] for k in keys} | {"prev_hash": previous}
    return hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()


def entries(sizes):
    rng = random.Random(5)
    rows = [
        {
            "chain_id": chain, "timestamp": f"2024-01-01T00:{i // 60 % 60:02}:{i % 60:02}", "n": i, "event_type": "scan",
            "original_text": f'text {chain} {i} "é\\\n😀"', "action_taken": rng.choice(["allowed", "warned", None]),
        }
        for chain, size in sizes.items()
        for i in range(size)
    ]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, partitions=8):
    data = [tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


def seed(chain, segment):
    return "genesis" if segment == 0 else hashlib.sha256(f"genesis:{chain}:{segment}".encode()).hexdigest()


def chained(rows, segment_rows=None):
    segment_rows = segment_rows or 10**9
    out = {}
    for chain in {r["chain_id"] for r in rows}:
        previous = None
        for seq, r in enumerate(sorted((r for r in rows if r["chain_id"] == chain), key=lambda r: r["n"]), 1):
            if (seq - 1) % segment_rows == 0:
                previous = seed(chain, (seq - 1) // segment_rows)
            current = digest(r, previous)
            out[chain, seq] = (r["n"], previous, current)
            previous = current
    return out


def collected(df):
    return {(r.chain_id, r.seq): (r.n, r.prev_hash, r.hash) for r in df.collect()}


SIZES = {"a": 700, "b": 1, "c": 40, "d": 99, 'odd "name"': 130}


def test_hash_of_awkward_texts(spark):
    texts = [
        None, "", "plain ~!", 'quote " back \\ slash /', "\n\r\t\b\f\x00\x01\x02\x1f\x7f", "é ß ñ", "😀𝔘 mixed é", "  ",
        "﷐￿", "\\u0041", "a" * 5000 + "é" * 5000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = df.select(F.expr(entry_hash("t", "'scan'", "t", "'2024'", "t")).alias("h"), "t").collect()
    for row in got:
        entry = {"timestamp": "2024", "event_type": "scan", "original_text": row.t, "action_taken": row.t}
        assert row.h == digest(entry, row.t), row.t


def test_iso_timestamp(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.120000' AS a, timestamp_ntz'2024-01-02 03:04:05' AS b")
    row = df.select(F.expr(iso_timestamp("a")), F.expr(iso_timestamp("b"))).first()
    assert tuple(row) == ("2024-01-02T03:04:05.120000", "2024-01-02T03:04:05")


@pytest.mark.parametrize("segment_rows", [None, 10**9, 100, 7])
def test_append_against_brute_force(spark, segment_rows):
    rows = entries(SIZES)
    got = C.append_chain(frame(spark, rows), None, ("n",), segment_rows)
    assert collected(got) == chained(rows, segment_rows)


def test_result_does_not_depend_on_partitioning(spark):
    rows = entries({"hot": 900, "x": 20})
    results = [collected(C.append_chain(frame(spark, rows, p), None, ("n",), 50)) for p in (1, 3, 16)]
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("segment_rows", [None, 64])
def test_batches_continue_chains(spark, segment_rows):
    rows = entries(SIZES)
    parts = [[r for r in rows if r["n"] < 30], [r for r in rows if 30 <= r["n"] < 95], [r for r in rows if r["n"] >= 95]]
    got, heads = {}, None
    for part in parts:
        appended = C.append_chain(frame(spark, part), heads, ("n",), segment_rows)
        got |= collected(appended)
        ends = C.chain_heads(appended)
        heads = ends if heads is None else heads.join(ends, "chain_id", "left_anti").unionByName(ends)
        heads = spark.createDataFrame(heads.collect(), heads.schema)
    assert got == chained(rows, segment_rows)


def test_missing_chain_and_wrong_segment(spark):
    rows = [dict(entries({"main": 1})[0], chain_id=None)]
    assert C.append_chain(frame(spark, rows)).first().chain_id == "main"
    with pytest.raises(ValueError):
        C.append_chain(frame(spark, rows), segment_rows=0)


def log(spark, segment_rows=None, sizes=SIZES):
    rows = entries(sizes)
    data = C.append_chain(frame(spark, rows), None, ("n",), segment_rows)
    return spark.createDataFrame(data.collect(), data.schema)


def flagged(df, **options):
    return {(r.chain_id, r.seq) for r in C.invalid_entries(C.check_chain(df, **options), links=True).collect()}


@pytest.mark.parametrize("block_rows", [3, 50, 10**6])
def test_valid_chain(spark, block_rows):
    for segment_rows in (None, 33):
        checked = C.check_chain(log(spark, segment_rows), segment_rows, block_rows=block_rows)
        report = C.chain_report(checked).first()
        assert report.valid and report.entries_checked == sum(SIZES.values())
        assert (report.broken_links, report.gaps, report.message) == (0, 0, "Hash chain is intact")


def test_changed_text_is_found(spark):
    bad = log(spark).withColumn("original_text", F.when(F.col("n") % 50 == 7, "x").otherwise(F.col("original_text")))
    want = {(c, i + 1) for c, size in SIZES.items() for i in range(size) if i % 50 == 7}
    assert flagged(bad, block_rows=10) == want


def test_changed_hash_flags_the_next_entry_too(spark):
    bad = log(spark).withColumn("hash", F.when((F.col("n") == 9) & (F.col("chain_id") == "a"), "0").otherwise(F.col("hash")))
    checked = C.check_chain(bad, block_rows=10)
    assert {(r.chain_id, r.seq) for r in C.invalid_entries(checked).collect()} == {("a", 10), ("a", 11)}
    by_seq = {r.seq: r for r in checked.filter("chain_id = 'a'").collect()}
    row = next(r for r in entries(SIZES) if r["chain_id"] == "a" and r["n"] == 10)
    assert by_seq[11].expected_hash == digest(row, "0")
    report = C.chain_report(checked).first()
    assert (report.valid, report.message) == (False, "Found 2 invalid entries")


def test_removed_repeated_and_relinked_entries_are_found(spark):
    good = log(spark)
    assert flagged(good.filter("NOT (chain_id = 'a' AND seq IN (5, 6))")) == {("a", 7)}
    assert flagged(good.unionByName(good.filter("chain_id = 'c' AND seq = 4"))) == {("c", 4)}
    relinked = good.withColumn("prev_hash", F.when(F.col("seq") == 3, "x").otherwise(F.col("prev_hash")))
    assert flagged(relinked) == {(c, 3) for c in ("a", "c", "d", 'odd "name"')}


def test_segment_removed_whole_is_found(spark):
    bad = log(spark, 50).filter("NOT (chain_id = 'a' AND seq BETWEEN 51 AND 100)")
    assert flagged(bad, segment_rows=50) == {("a", 101)}


def test_forged_segment_is_found_by_its_recorded_end(spark):
    good = log(spark, 50, {"a": 120})
    names = [c for c in good.columns if c not in ("seq", "prev_hash", "hash")]
    fresh = C.append_chain(good.filter("seq <= 50").withColumn("original_text", F.lit("x")).select(*names), None, ("n",), 50)
    forged = fresh.unionByName(good.filter("seq > 50"))
    recorded = C.segment_ends(good, 50)
    assert flagged(forged, segment_rows=50) == set()
    assert [(r.chain_id, r.segment) for r in C.check_segments(forged, recorded, 50).collect()] == [("a", 0)]
    assert C.check_segments(good, recorded, 50).isEmpty()
    before, after = (C.seals(C.segment_ends(x, 50)).first() for x in (good, forged))
    assert (before.segments, before.seal != after.seal) == (3, True)


def test_limit_checks_oldest_or_newest(spark):
    bad = log(spark, sizes={"main": 60})
    bad = bad.withColumn("original_text", F.when(F.col("seq").isin(5, 58), "x").otherwise(F.col("original_text")))
    assert C.chain_report(C.check_chain(bad, limit=10)).first().entries_checked == 10
    assert flagged(bad, limit=10) == {("main", 5)}
    assert flagged(bad, limit=10, newest=True) == {("main", 58)}
    assert flagged(bad, limit=0) == {("main", 5), ("main", 58)}


def test_anchors_and_cut_tails(spark):
    full = log(spark)
    kept = full.filter("seq > 20")
    anchors = full.filter("seq = 20").selectExpr("chain_id", "seq AS anchor_seq", "hash AS anchor_hash")
    assert flagged(kept, anchors=anchors) == set()
    assert flagged(kept) == {(c, 21) for c, size in SIZES.items() if size > 20}
    cut = C.cut_tails(full.filter("NOT (chain_id = 'a' AND seq > 690) AND chain_id <> 'b'"), C.chain_heads(full))
    assert {(r.chain_id, r.last_seq, r.found_seq) for r in cut.collect()} == {("a", 700, 690), ("b", 1, None)}


def test_long_unbroken_chains_are_hashed_in_parts(spark, monkeypatch):
    """A task that hashes gets a part of a long chain, and only what is hashed, not the chain with all its columns."""
    monkeypatch.setattr(C, "LONG_ROWS", 90)
    monkeypatch.setattr(C, "PART_ROWS", 40)
    rows = entries(SIZES | {"e": 400, "f": 95})
    parts = [[r for r in rows if r["n"] < 30], [r for r in rows if r["n"] >= 30]]
    given, fold = [], C._fold

    def recorded(ordered, *args):
        given.append(({"original_text", "n"} & set(ordered.columns), ordered.groupBy("chain_id").count().collect()))
        return fold(ordered, *args)

    monkeypatch.setattr(C, "_fold", recorded)
    got, heads = {}, None
    for part in parts:
        appended = C.append_chain(frame(spark, part), heads, ("n",))
        got |= collected(appended)
        heads = spark.createDataFrame(C.chain_heads(appended).collect(), "chain_id string, last_seq long, last_hash string")
    assert got == chained(rows)
    assert max(r["count"] for _, counts in given for r in counts) < 250
    long = [texts for texts, counts in given if {r.chain_id for r in counts} & {"a", "e"} and max(r["count"] for r in counts) > 30]
    assert len(long) > 5 and not any(long)
