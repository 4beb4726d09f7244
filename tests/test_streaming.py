from __future__ import annotations

import datetime as dt

from textwarden.operators.chain import chain_report
from textwarden.operators.stats import daily_statistics
from textwarden.plans import views
from textwarden.sources.audit_table import AuditTable
from textwarden.streaming import jobs

from conftest import SF_DIR


def test_restarted_audit_stream_appends_each_batch_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    source = str(tmp_path / "in")
    events.repartitionByRange(4, "event_id").write.parquet(source)
    log = AuditTable(spark, str(tmp_path / "log"))

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
        writer = jobs.audit_stream(stream, log, views.event_entries, ("ts", "event_id"))
        writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert log.entries().count() == 1000
    run()
    assert log.entries().count() == 1000
    assert log.heads().agg({"last_seq": "sum"}).first()[0] == 1000
    report = chain_report(log.check()).first()
    assert (report.valid, report.broken_links, report.gaps) == (True, 0, 0)


def test_two_streams_into_one_log(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    log = AuditTable(spark, str(tmp_path / "log"))
    for i, writer in enumerate(("left", "right")):
        source = str(tmp_path / f"in-{writer}")
        events.filter(f"event_id % 2 = {i}").write.parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        job = jobs.audit_stream(stream, log, views.event_entries, ("ts", "event_id"), writer)
        job.option("checkpointLocation", str(tmp_path / writer)).trigger(availableNow=True).start().awaitTermination()
    assert log.entries().count() == 1000
    report = chain_report(log.check()).first()
    assert (report.valid, report.broken_links, report.gaps) == (True, 0, 0)


def test_statistics_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    source = str(tmp_path / "in")
    events.repartitionByRange(5, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    entries = views.event_entries(stream).withColumn("ts", views_ts())
    got = jobs.run_updates(jobs.statistics_stream(entries, delay="40 days"), "date", "stats-test")
    want = daily_statistics(views.event_entries(events))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def views_ts():
    from pyspark.sql import functions as F

    return F.col("ts").cast("timestamp")


def test_rate_breaches_as_minutes_close(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s)) for s in (0, 1, 2)] + [("b", start + dt.timedelta(hours=1))]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "user_id string, ts timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("user_id string, ts timestamp").parquet(source)
    got = jobs.run_to_table(jobs.rate_breach_stream(stream, 2), "rate-test").collect()
    assert [(r.user_id, r.requests) for r in got] == [("a", 3)]


def test_chain_in_the_state_store_equals_the_batch_chain_across_restarts(spark):
    """Four deliveries, each a micro-batch of a query started again from its checkpoint, give audit_chain's log."""
    from textwarden.plans import views
    from textwarden.sources.scratch import new_path
    from textwarden.streaming.chain_state import run_in_parts

    events = views.table(spark, SF_DIR, "events")
    log = run_in_parts(spark, events, "ts", 4, views.event_entries, ("ts", "event_id"), ("event_id",), new_path(spark, "t"))
    columns = ["chain_id", "seq", "timestamp", "action_taken", "prev_hash", "hash"]
    batch = views.event_audit(spark, SF_DIR).select(*columns)
    assert sorted(log.select(*columns).collect()) == sorted(batch.collect())
    assert log.select("chain_id", "seq").distinct().count() == log.count()
