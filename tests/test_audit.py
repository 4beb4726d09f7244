from __future__ import annotations

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from textwarden.config import ScanConfig
from textwarden.operators import stats as S
from textwarden.operators.audit import (
    audit_entries,
    export_logs,
    query_audit,
    rate_breaches,
    rate_limit_report,
    scan_and_log,
)
from textwarden.operators.chain import chain_report, invalid_entries, seals
from textwarden.operators.scan import scan_table
from textwarden.sources.audit_table import AuditTable

START = dt.datetime(2024, 1, 1)


def entries(spark, first, count, minutes=60, **options):
    texts = ["Plums are ripe", "Mail ada@orchard.example", "Good medical advice"]
    rows = [(first + i, START + dt.timedelta(minutes=minutes * (first + i)), f"u{(first + i) % 4}", texts[(first + i) % 3]) for i in range(count)]
    df = spark.createDataFrame(rows, "n int, ts timestamp_ntz, user string, text string")
    options = {"chain_id": "user", **options}
    return audit_entries(scan_table(df), ts="ts", user_id="user", metadata="map('n', CAST(n AS string))", keep=("n",), **options)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("audit") / "log"
    log = AuditTable(spark, str(path), segment_rows=20)
    assert log.entries().isEmpty() and log.heads().isEmpty()
    assert log.append(entries(spark, 0, 100), 0, ("n",))
    assert log.append(entries(spark, 100, 50), 1, ("n",))
    return path


@pytest.fixture()
def table(spark, written, tmp_path):
    shutil.copytree(written, tmp_path / "log")
    return AuditTable(spark, str(tmp_path / "log"), segment_rows=20)


def test_append_is_checked_and_counted(table):
    report = chain_report(table.check()).first()
    assert (report.valid, report.entries_checked, report.broken_links, report.gaps) == (True, 150, 0, 0)
    assert table.cut_tails().isEmpty()
    totals = table.statistics().agg(*[F.sum(c).alias(c) for c in S.COUNTERS]).first()
    assert tuple(totals) == (150, 50, 50, 50)
    row = table.entries().filter("chain_id = 'u1'").orderBy("seq").first()
    assert (row.timestamp, row.prev_hash, row.metadata, row.event_type) == ("2024-01-01T01:00:00", "genesis", {"n": "1"}, "scan")
    assert row.created_at is not None


def test_replayed_batch_changes_nothing(spark, table):
    before = {tuple(r) for r in table.entries().select("chain_id", "seq", "hash").collect()}
    assert not table.append(entries(spark, 100, 50), 1, ("n",))
    assert {tuple(r) for r in table.entries().select("chain_id", "seq", "hash").collect()} == before


def hashes(table):
    return {tuple(r) for r in table.entries().select("chain_id", "seq", "hash").collect()}


def test_uncommitted_version_is_not_seen_and_written_over(spark, table, monkeypatch):
    from textwarden.sources import audit_table

    before = hashes(table)
    monkeypatch.setattr(audit_table, "_digest", lambda entries: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.append(entries(spark, 150, 8), 2, ("n",))
    assert hashes(table) == before and table.statistics().agg(F.sum("total_scans")).first()[0] == 150
    monkeypatch.undo()
    assert table.append(entries(spark, 150, 8), 2, ("n",))
    report = chain_report(table.check()).first()
    assert (report.valid, report.entries_checked, report.broken_links, report.gaps) == (True, 158, 0, 0)


def test_only_one_appender_commits_a_version(spark, table, monkeypatch):
    last = table._committed()
    assert table.append(entries(spark, 150, 8), 2, ("n",))
    monkeypatch.setattr(table, "_committed", lambda: last)
    with pytest.raises(Exception, match="(?i)exist"):
        table.append(entries(spark, 158, 8), 3, ("n",))


def test_append_leaves_no_intermediate_tables(spark, tmp_path):
    from textwarden.sources.scratch import new_path, shared_dir

    log = AuditTable(spark, str(tmp_path / "log"))
    mark = new_path(spark, "mark")
    folder = mark.removeprefix("file:").rpartition("/")[0]
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert log.append(entries(spark, 0, 30), 0, ("n",)) and log.purge(START + dt.timedelta(hours=5)) == 5
    assert set(os.listdir(folder)) == before and shared_dir(spark) in mark


def test_empty_batches(spark, tmp_path):
    log = AuditTable(spark, str(tmp_path / "log"))
    assert log.append(entries(spark, 0, 0), 0, ("n",)) and log.entries().isEmpty()
    assert log.append(entries(spark, 0, 5), 1, ("n",)) and not log.append(entries(spark, 0, 0), 0, ("n",))
    assert chain_report(log.check()).first().entries_checked == 5


def test_writers_count_their_own_batches(spark, table):
    assert table.append(entries(spark, 150, 8), 0, ("n",), writer="other")
    assert not table.append(entries(spark, 150, 8), 0, ("n",), writer="other")
    with pytest.raises(ValueError, match="another batch"):
        table.append(entries(spark, 158, 8), 0, ("n",), writer="other")
    assert table.append(entries(spark, 158, 8), 7, ("n",))
    with pytest.raises(ValueError, match="after 5 already"):
        table.append(entries(spark, 166, 8), 5, ("n",))
    report = chain_report(table.check()).first()
    assert (report.valid, report.entries_checked, report.gaps) == (True, 166, 0)


def test_append_reads_and_rewrites_the_touched_heads_only(spark, table, tmp_path):
    def folders():
        return {p.name: {q.name for q in p.glob("version=*")} for p in (tmp_path / "log/heads").glob("bucket=*")}

    before = folders()
    assert table.append(entries(spark, 152, 1, chain_id="'u0'"), 2, ("n",))
    after = folders()
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(changed) == 1 and after[changed.pop()] == {"version=2"}
    plan = table.heads([3])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_a_bucket_of_heads_is_one_file(spark, tmp_path):
    # Small tables would be gathered into one task otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    log = AuditTable(spark, str(tmp_path / "log"))
    rows = spark.range(600).selectExpr("CAST(id AS int) AS n", "localtimestamp() AS ts", "concat('c', id) AS user", "'Plums' AS text")
    try:
        for batch in range(2):
            log.append(audit_entries(scan_table(rows), ts="ts", chain_id="user", keep=("n",)), batch, ("n",))
            files = [f.parent.parent.name for f in (tmp_path / "log" / "heads").rglob("*.parquet")]
            assert len(files) == len(set(files))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    heads = {(r.chain_id, r.last_seq) for r in log.heads().collect()}
    assert heads == {(f"c{i}", 2) for i in range(600)}
    assert log.cut_tails().isEmpty() and chain_report(log.check()).first().valid


def test_segment_size_is_kept_with_the_log(spark, table):
    assert AuditTable(spark, table.path).segment_rows == 20
    with pytest.raises(ValueError, match="segment_rows=20"):
        AuditTable(spark, table.path, segment_rows=30)
    assert table.check_segments().isEmpty()
    assert seals(table.recorded_segments()).count() == 4


def test_purge_keeps_the_rest_checkable(table):
    cutoff = START + dt.timedelta(days=2, hours=5, minutes=30)
    assert table.purge(cutoff) == 54
    assert table.purge(cutoff) == 0
    left = table.entries().agg(F.count(F.lit(1)), F.min("ts")).first()
    assert tuple(left) == (96, START + dt.timedelta(hours=54))
    report = chain_report(table.check()).first()
    assert (report.valid, report.broken_links, report.gaps) == (True, 0, 0)
    assert table.statistics().agg(F.sum("total_scans")).first()[0] == 150
    assert table.cut_tails().isEmpty()


def test_purge_cut_off_before_its_last_step(table, tmp_path):
    cutoff = START + dt.timedelta(days=2, hours=5, minutes=30)
    assert table.purge(cutoff) == 54
    log = tmp_path / "log"
    (log / "entries/dt=2024-01-03").rename(log / "purge/2024-01-03")
    (log / "purge/2024-01-03/_SUCCESS").touch()
    assert table.entries().count() == 78
    assert table.purge(cutoff) == 0
    assert table.entries().count() == 96
    assert chain_report(table.check()).first().valid


def test_purge_with_late_entries(spark, tmp_path):
    log = AuditTable(spark, str(tmp_path / "log"))
    log.append(entries(spark, 0, 40), 0, ("n",))
    log.append(entries(spark, 4, 12), 1, ("n",))
    log.append(entries(spark, 40, 20), 2, ("n",))
    assert log.purge(START + dt.timedelta(hours=20)) == 32
    report = chain_report(log.check()).first()
    assert (report.valid, report.entries_checked, report.broken_links, report.gaps) == (True, 40, 0, 0)
    assert log.cut_tails().isEmpty()
    assert log.purge(START + dt.timedelta(days=30)) == 40
    assert log.cut_tails().isEmpty() and log.entries().isEmpty()
    assert log.append(entries(spark, 60, 8), 3, ("n",))
    assert chain_report(log.check()).first().valid


def test_tampered_files_are_found(spark, table, tmp_path):
    bad = table.entries().withColumn("original_text", F.when(F.col("seq") == 7, "x").otherwise(F.col("original_text")))
    from textwarden.operators.chain import check_chain

    wrong = invalid_entries(check_chain(bad, 20))
    assert {(r.chain_id, r.seq) for r in wrong.collect()} == {(f"u{i}", 7) for i in range(4)}


def test_query(table):
    log = table.entries()
    newest = query_audit(log, 5).collect()
    assert [r.ts for r in newest] == [START + dt.timedelta(hours=h) for h in range(149, 144, -1)]
    assert [r.ts for r in query_audit(log, 2, 3).collect()] == [r.ts for r in newest[3:]]
    day = query_audit(log, 100, start_date="2024-01-02", end_date="2024-01-02T12:00:00")
    assert day.count() == 13
    assert query_audit(log, 100, end_date="2024-01-02").count() == 24
    assert query_audit(log, 100, action_taken="blocked").count() == 50
    assert query_audit(log, 100, event_type="other").count() == 0
    assert [r.seq for r in query_audit(log, 3, chain_id="u1").collect()] == [38, 37, 36]
    assert query_audit(log, None).count() == 150
    plan = query_audit(log, 5, start_date="2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "(dt#" in plan.split("PartitionFilters")[1].split("]")[0] and "TakeOrderedAndProject" in plan


def test_export(spark, table, tmp_path):
    export_logs(table.entries(), str(tmp_path / "csv"), "csv", start_date="2024-01-05")
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    lines = text.splitlines()
    assert lines[0] == "id,timestamp,event_type,action_taken,pii_count,violation_count,hash"
    assert len(lines) == 1 + 54
    export_logs(table.entries(), str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 150
    with pytest.raises(ValueError, match="Unsupported format: xml"):
        export_logs(table.entries(), str(tmp_path / "xml"), "xml")
    export_logs(table.entries().filter("false"), str(tmp_path / "none"), "csv")
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")) == ""


def test_statistics(table):
    stats = table.statistics()
    as_of = dt.date(2024, 1, 3)
    row = S.statistics_summary(stats, as_of, 2).first()
    assert tuple(row) == (48, 16, 16, 16, 2)
    days = S.statistics_breakdown(stats, as_of, 7).collect()
    assert [(r.date.day, r.scans) for r in days] == [(3, 24), (2, 24), (1, 24)]
    assert tuple(S.statistics_summary(stats, dt.date(2020, 1, 1), 7).first()) == (0, 0, 0, 0, 0)
    users = {r.date.day: r.unique_users for r in S.unique_users_daily(table.entries()).collect()}
    assert users[1] == 4
    near = S.unique_users_daily(table.entries(), approximate=True).filter("date = '2024-01-01'").first()
    assert near.unique_users == 4


def test_stored_hash_instead_of_text(spark):
    row = entries(spark, 0, 1, store_original=False).first()
    assert len(row.original_text) == 64 and row.redacted_text == "Plums are ripe"


def test_scan_and_log(spark):
    df = spark.createDataFrame([(1, START, "a@b.cc"), (2, START, "legal advice")], "n int, ts timestamp_ntz, text string")
    rows = {r.n: r for r in scan_and_log(df, "ts", order_by=("n",), keep=("n",)).collect()}
    assert (rows[1].redacted_prompt, rows[1].prev_hash, rows[1].seq) == ("[REDACTED]", "genesis", 1)
    assert (rows[2].safe_to_send, rows[2].prev_hash) == (False, rows[1].audit_hash)
    off = scan_and_log(df, "ts", config=ScanConfig(audit_logging_enabled=False))
    assert "hash" not in off.columns and off.count() == 2


def test_rejected_texts_are_logged_and_come_back(spark):
    df = spark.createDataFrame([(1, START, "x" * 11), (2, START, "ok")], "n int, ts timestamp_ntz, text string")
    logged = scan_and_log(df, "ts", config=ScanConfig(max_prompt_length=10), order_by=("n",), keep=("n",))
    first, second = sorted(logged.collect(), key=lambda r: r.n)
    assert (first.original_text, first.action_taken, first.error, first.max_length) == (
        "x" * 11, "rejected", "Prompt exceeds maximum length", 10,
    )
    assert (second.action_taken, second.error, second.prev_hash) == ("allowed", None, first.audit_hash)
    counts = S.daily_statistics(logged).first()
    assert (counts.total_scans, counts.pii_detections) == (2, 0)


def test_missing_timestamp_is_filled_in(spark):
    df = spark.createDataFrame([(1, None, "ok")], "n int, ts timestamp_ntz, text string")
    row = scan_and_log(df, "ts", order_by=("n",), keep=("n",)).first()
    assert None not in (row.timestamp, row.ts, row.dt) and row.ts.date() == row.dt


def test_export_has_no_cap(spark, tmp_path):
    many = spark.range(10_500).selectExpr(
        "id AS seq", "'t' AS timestamp", "localtimestamp() AS ts", "'m' AS chain_id", "'scan' AS event_type",
        "'allowed' AS action_taken", "CAST(NULL AS array<string>) AS pii_detected", "array('x') AS policy_violations", "'h' AS hash",
    )
    export_logs(many, str(tmp_path / "csv"), "csv")
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert (rows.count(), rows.first().pii_count, rows.first().violation_count) == (10_500, "0", "1")
    export_logs(many, str(tmp_path / "some"), "json", limit=7)
    assert spark.read.json(str(tmp_path / "some")).count() == 7


def test_rate_breaches(spark):
    rows = [("a", START + dt.timedelta(seconds=s)) for s in (1, 2, 3, 61)] + [("b", START)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp")
    on = ScanConfig(rate_limit_enabled=True, max_per_minute=2)
    assert rate_limit_report(df, on).count() == 1
    assert rate_limit_report(df, ScanConfig(max_per_minute=2)).count() == 0
    got = rate_breaches(df, 2).collect()
    assert [(r.user_id, r.window_start, r.requests) for r in got] == [("a", START, 3)]
