"""The registered queries: each takes a session and the folder of the tables and returns a DataFrame.

Nested results are laid out as text or single columns, so that other engines can produce the same rows.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.config import ScanConfig
from textwarden.functions import pii as pii_fn
from textwarden.functions import policy as policy_fn
from textwarden.functions import text as text_fn
from textwarden.functions.canonical import GENESIS, entry_hash, iso_timestamp
from textwarden.functions.sql import lit
from textwarden.operators import audit as audit_op
from textwarden.operators.keyword_index import keyword_matches
from textwarden.operators import chain as chain_op
from textwarden.operators import pii as pii_op
from textwarden.operators import policy as policy_op
from textwarden.operators import retention as retention_op
from textwarden.operators import scan as scan_op
from textwarden.operators import stats as stats_op
from textwarden.plans import views
from textwarden.sources import catalogs
from textwarden.sources.audit_table import AuditTable
from textwarden.sources.files import create
from textwarden.sources.scratch import materialise, new_path
from textwarden.streaming import jobs
from textwarden.streaming.chain_state import run_in_parts

Query = Callable[[SparkSession, str], DataFrame]

CORE = ScanConfig()
EXTENDED = ScanConfig(extended_patterns=True, extended_policies=True)

# The events cover January 2024.
AS_OF = dt.date(2024, 1, 20)
PURGE_BEFORE = retention_op.cutoff(dt.datetime(2024, 1, 28, 12, 0), 15)
SEGMENT_ROWS = 100
TAMPERED_EVERY = 97
TOP_K = 25
MAX_LENGTH = 10_000


def _joined(items: Column, *fields: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", *[x[f] for f in fields])), "|")


def _counts_text(counts: Column) -> Column:
    entries = F.transform(
        F.map_entries(counts), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return F.array_join(F.array_sort(entries), ",")


def _long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


# --- catalogs -------------------------------------------------------------------------------------------


def pattern_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active patterns with how often each occurs in the prompts."""
    found = pii_op.pii_totals(pii_op.with_matches(views.prompts(spark, sf_dir), config=EXTENDED))
    hits = found.groupBy("type").agg(F.sum("matches").alias("matches"))
    return (
        catalogs.pattern_catalog(spark, extended=True)
        .join(hits, "type", "left")
        .select(
            _long("ordinal").alias("ordinal"), "type", "pattern", "name", "severity", "description", "extended",
            F.coalesce("matches", F.lit(0)).alias("matches"),
        )
    )


def policy_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active policies with how many prompts violate each."""
    found = policy_op.with_violations(views.prompts(spark, sf_dir), config=EXTENDED)
    hits = policy_op.violation_rows(found, []).groupBy("policy_name").agg(F.count(F.lit(1)).alias("violations"))
    return (
        catalogs.policy_catalog(spark, extended=True)
        .join(hits, F.col("name") == F.col("policy_name"), "left")
        .select(
            _long("ordinal").alias("ordinal"), "name", "category", F.array_join("keywords", "|").alias("keywords"),
            F.array_join("regex_patterns", " ; ").alias("regex_patterns"), "action", "message", "severity",
            F.coalesce("violations", F.lit(0)).alias("violations"),
        )
    )


# --- personal data --------------------------------------------------------------------------------------


def _matches(spark: SparkSession, sf_dir: str, config: ScanConfig, custom=()) -> DataFrame:
    found = pii_op.with_matches(views.prompts(spark, sf_dir), config=config, custom=custom)
    return pii_op.match_rows(found, ["doc_id"]).select(
        "doc_id", "type", "name", "value", _long("start").alias("match_start"), _long("end").alias("match_end"),
        "severity", "confidence",
    )


def pii_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, CORE)


def pii_matches_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, EXTENDED)


def pii_matches_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, CORE, views.CUSTOM_PATTERNS)


def pii_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in the turns of conversations."""
    found = pii_op.with_matches(views.turns(views.table(spark, sf_dir, "conversations")), config=EXTENDED)
    return pii_op.match_rows(found, ["conv_id", "turn", "role"]).select(
        "conv_id", "turn", "role", "type", "value", _long("start").alias("match_start"), _long("end").alias("match_end")
    )


def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card-shaped numbers of the documents and whether their check digit is right."""
    card = next(p for p in catalogs.BUILTIN_PATTERNS if p.type == "credit_card")
    shaped = F.regexp_extract_all("text", F.lit(card.regex()), 0)
    return (
        views.table(spark, sf_dir, "documents")
        .select("doc_id", F.explode_outer(shaped).alias("card"))
        .filter(F.col("card").isNotNull())
        .select("doc_id", "card", F.expr(text_fn.luhn_valid("card")).alias("valid"))
    )


def _redacted(style: str, overlap: str = "merge", extended: bool = True) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = ScanConfig(extended_patterns=extended, redaction_style=style, overlap=overlap)
        return pii_op.redact_table(views.prompts(spark, sf_dir), config=config).select("doc_id", "redacted")

    return query


def redact_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    redacted = pii_op.redact_table(views.prompts(spark, sf_dir), config=CORE)
    return redacted.select(
        "doc_id", F.col("text").alias("original"), "redacted", _long("pii_found").alias("pii_found"),
        F.array_join("pii_types", ",").alias("pii_types"),
    )


def pii_summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_op.with_matches(views.prompts(spark, sf_dir), config=EXTENDED)
    summed = found.select("doc_id", F.expr(pii_fn.pii_summary("matches")).alias("s"))
    return summed.select(
        "doc_id",
        _long("s.total_count").alias("total_count"),
        _counts_text(F.col("s.by_type")).alias("by_type"),
        *[_long(f"s.by_severity.{s}").alias(s) for s in catalogs.SEVERITIES],
        F.array_join("s.unique_types", ",").alias("unique_types"),
    )


def pii_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_op.pii_totals(pii_op.with_matches(views.prompts(spark, sf_dir), config=EXTENDED))


def pii_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_op.with_matches(views.table(spark, sf_dir, "documents"), config=EXTENDED)
    return pii_op.pii_totals(found, by=["lang"])


def pii_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_op.with_matches(views.prompts(spark, sf_dir), config=EXTENDED)
    return pii_op.pii_cube(found, "lang").select(
        F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("type", F.lit("*")).alias("type"), "matches"
    )


def pii_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches per type in raw web pages."""
    pages = views.table(spark, sf_dir, "pages")
    return pii_op.pii_totals(pii_op.with_matches(pages, "html", EXTENDED))


def _catalog_file(spark: SparkSession, label: str, entries: dict) -> str:
    """A catalog file in the shared folder."""
    path = f"{new_path(spark, label)}.json"
    create(spark, path, json.dumps(entries))
    return path


def pii_matches_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The custom patterns, read from a file."""
    fields = ("pattern", "name", "severity", "description", "value_group")
    entries = {p.type: {f: getattr(p, f) for f in fields} for p in views.CUSTOM_PATTERNS}
    return _matches(spark, sf_dir, CORE, catalogs.load_patterns(spark, _catalog_file(spark, "patterns", entries)))


# --- policies -------------------------------------------------------------------------------------------


def _violations(config: ScanConfig, custom=()) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = policy_op.with_violations(views.prompts(spark, sf_dir), config=config, custom=custom)
        return policy_op.violation_rows(found, ["doc_id"])

    return query


def policy_violations_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The custom policies, read from a file."""
    fields = ("category", "action", "severity", "message", "keywords", "regex_patterns")
    entries = {p.name: {f: getattr(p, f) for f in fields} for p in views.CUSTOM_POLICIES}
    policies = catalogs.load_policies(spark, _catalog_file(spark, "policies", entries))
    return _violations(CORE, policies)(spark, sf_dir)


def policy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations in raw web pages, by policy and what was matched."""
    found = policy_op.with_violations(views.table(spark, sf_dir, "pages"), "html", EXTENDED)
    return (
        policy_op.violation_rows(found, [])
        .groupBy("policy_name", "matched_keyword")
        .agg(F.count(F.lit(1)).alias("pages"))
    )


def policy_summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy_op.with_violations(views.prompts(spark, sf_dir), config=EXTENDED)
    summed = found.select("doc_id", F.expr(policy_fn.policy_summary("violations")).alias("s"))
    return summed.select(
        "doc_id",
        _long("s.total_violations").alias("total_violations"),
        "s.should_block",
        _counts_text(F.col("s.by_category")).alias("by_category"),
        *[_long(f"s.by_severity.{s}").alias(s) for s in catalogs.SEVERITIES],
        *[_long(f"s.by_action.{a}").alias(f"n_{a}") for a in catalogs.ACTIONS],
        F.array_join("s.messages", "|").alias("messages"),
    )


def policy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy_op.with_violations(views.prompts(spark, sf_dir), config=EXTENDED)
    return policy_op.policy_totals(found)


def policy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy_op.with_violations(views.prompts(spark, sf_dir), config=EXTENDED)
    return policy_op.policy_rollup(found).select(
        F.coalesce("category", F.lit("*")).alias("category"),
        F.coalesce("policy_name", F.lit("*")).alias("policy_name"),
        "violations",
    )


def policy_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy_actions(spark, sf_dir, CORE)


def policy_actions_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with regexes restricted to ASCII, for detection and redaction alike."""
    return _policy_actions(spark, sf_dir, ScanConfig(unicode_regex=False))


def _policy_actions(spark: SparkSession, sf_dir: str, config: ScanConfig) -> DataFrame:
    custom = views.CUSTOM_POLICIES
    found = policy_op.with_violations(views.prompts(spark, sf_dir), config=config, custom=custom)
    done = policy_op.with_policy_actions(found, config=config, custom=custom)
    return done.select(
        "doc_id",
        "applied.processed_text",
        "applied.blocked",
        F.array_join("applied.warnings", "|").alias("warnings"),
        F.array_join("applied.applied_actions", "|").alias("applied_actions"),
    )


# --- scans ----------------------------------------------------------------------------------------------


def _scan_columns(scanned: DataFrame, *keys: str) -> DataFrame:
    return scanned.select(
        *keys,
        "redacted_prompt",
        _joined(F.col("pii_detected"), "type", "name", "severity").alias("pii_detected"),
        _joined(F.col("policy_violations"), "policy", "category", "action", "message").alias("policy_violations"),
        "action",
        "safe_to_send",
        _long("summaries.pii.total_count").alias("n_pii"),
        _long("summaries.policy.total_violations").alias("n_violations"),
        "redacted_text",
        "error",
        _long("max_length").alias("max_length"),
    )


def scan_actions_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: what happens to the turns of conversations, by who speaks."""
    scanned = scan_op.scan_table(views.turns(views.table(spark, sf_dir, "conversations")), "text", EXTENDED)
    return scanned.groupBy("role", "action").agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum(F.coalesce(F.array_size("pii_detected"), F.lit(0))).alias("pii_found"),
        F.sum(F.coalesce(F.array_size("policy_violations"), F.lit(0))).alias("violations"),
    )


def scan_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_columns(scan_op.scan_table(views.prompts(spark, sf_dir), "text", CORE), "doc_id")


def scan_without_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ScanConfig(pii_detection_enabled=False, extended_policies=True)
    return _scan_columns(scan_op.scan_table(views.prompts(spark, sf_dir), "text", config), "doc_id")


def scan_without_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ScanConfig(policy_enforcement_enabled=False, auto_redact=False, extended_patterns=True)
    return _scan_columns(scan_op.scan_table(views.prompts(spark, sf_dir), "text", config), "doc_id")


def scan_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a scan rejects for their length."""
    config = ScanConfig(max_prompt_length=MAX_LENGTH)
    scanned = scan_op.scan_table(views.table(spark, sf_dir, "documents"), "text", config)
    return scanned.filter(F.col("error").isNotNull()).select("doc_id", "error", _long("max_length").alias("max_length"))


def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = scan_op.check_compliance(views.prompts(spark, sf_dir), "text", EXTENDED)
    return checked.select(
        "doc_id",
        "compliant",
        _long("issues.pii.total_count").alias("n_pii"),
        _long("issues.policy.total_violations").alias("n_violations"),
        "issues.policy.should_block",
        "recommendation",
    )


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_op.with_risk(scan_op.with_findings(views.prompts(spark, sf_dir), "text", EXTENDED))


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risks(spark, sf_dir).select(
        "doc_id",
        _long("risk.score").alias("score"),
        "risk.level",
        _long("risk.pii_score").alias("pii_score"),
        _long("risk.policy_score").alias("policy_score"),
        "risk.recommendation",
    )


def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_op.risk_levels(_risks(spark, sf_dir))


def risk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scan_op.top_risks(_risks(spark, sf_dir), TOP_K, ["doc_id"])
    return top.select("doc_id", _long("score").alias("score"), "level")


def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(text_fn.truncate_text("text")).alias("short"))


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.prompts(spark, sf_dir).select("doc_id", F.expr(text_fn.sanitize_for_logging("text")).alias("logged"))


# --- audit log ------------------------------------------------------------------------------------------


def entry_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of every document as the first entry of a log: all characters, escaped as the hash covers them."""
    docs = views.prompts(spark, sf_dir)
    hashed = entry_hash("'allowed'", "'scan'", "text", "'2024-01-01T12:00:00'", lit(GENESIS))
    return docs.select("doc_id", F.expr(hashed).alias("hash"))


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = views.event_audit(spark, sf_dir)
    return audit.select(
        "event_id", "chain_id", "seq", "timestamp", "event_type", "original_text", "action_taken", "prev_hash", "hash"
    )


def scan_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scanned and logged: what the caller gets back, with the hash of the log entry."""
    logged = audit_op.scan_and_log(
        views.event_prompts(views.table(spark, sf_dir, "events")),
        "ts",
        order_by=("ts", "event_id"),
        keep=("event_id",),
        chain_id="concat('user-', user_id)",
        event_type="event_type",
    )
    return logged.select(
        "event_id", "redacted_prompt", "safe_to_send", F.col("action_taken").alias("action"),
        _long("summaries.pii.total_count").alias("n_pii"), "audit_hash",
    )


def audit_chain_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in one chain, cut into short segments."""
    audit = views.event_audit(spark, sf_dir, "main", SEGMENT_ROWS)
    return audit.select("event_id", "chain_id", "seq", "prev_hash", "hash")


_stored_logs: dict[tuple, DataFrame] = {}


def _log(spark: SparkSession, sf_dir: str, chain: str = "user", segment_rows: int | None = None) -> DataFrame:
    """The log of all events as a stored table, written when the application first asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, chain, segment_rows)
    if key not in _stored_logs:
        _stored_logs[key] = materialise(views.event_audit(spark, sf_dir, chain, segment_rows), "audit")
    return _stored_logs[key]


def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_op.chain_report(chain_op.check_chain(_log(spark, sf_dir, "main")))


def audit_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over the ends of all segments of the cut chain."""
    return chain_op.seals(chain_op.segment_ends(_log(spark, sf_dir, "main", SEGMENT_ROWS), SEGMENT_ROWS))


def audit_forged_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first segment of a cut chain rewritten and hashed anew. Neighbours fit; the recorded ends do not."""
    log = _log(spark, sf_dir, "main", SEGMENT_ROWS)
    first = F.col("seq") <= SEGMENT_ROWS
    changed = F.when(F.col("seq") == 7, F.lit("changed")).otherwise(F.col("original_text"))
    names = [c for c in log.columns if c not in ("seq", "prev_hash", "hash")]
    again = log.filter(first).withColumn("original_text", changed).select(*names, F.col("seq").alias("place"))
    forged = chain_op.append_chain(again, order_by=("place",), segment_rows=SEGMENT_ROWS).drop("place")
    forged = materialise(forged.unionByName(log.filter(~first)), "forged")
    wrong = chain_op.invalid_entries(chain_op.check_chain(forged, SEGMENT_ROWS), links=True).count()
    found = chain_op.check_segments(forged, chain_op.segment_ends(log, SEGMENT_ROWS), SEGMENT_ROWS)
    return found.withColumn("wrong_entries", F.lit(wrong).cast("long"))


def _tampered(log: DataFrame) -> DataFrame:
    hit = F.col("event_id") % TAMPERED_EVERY == 0
    return log.withColumn(
        "original_text", F.when(hit, F.lit("changed")).otherwise(F.col("original_text"))
    )


def audit_verify_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries found wrong after texts were changed in the log."""
    log = _tampered(_log(spark, sf_dir))
    return chain_op.invalid_entries(chain_op.check_chain(log)).select("chain_id", "seq", "actual_hash")


def audit_verify_rehashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries found wrong after stored hashes were replaced: each such entry and the one after it."""
    log = _log(spark, sf_dir)
    hit = F.col("event_id") % TAMPERED_EVERY == 0
    log = materialise(log.withColumn("hash", F.when(hit, F.sha2("hash", 256)).otherwise(F.col("hash"))), "rehashed")
    return chain_op.invalid_entries(chain_op.check_chain(log)).select(
        "chain_id", "seq", "expected_hash", "actual_hash", "link_ok"
    )


def audit_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of one chain with JSON texts, imported: what was detected in each entry, and whether its hash holds."""
    log = _log(spark, sf_dir, "main").selectExpr(
        "seq AS id", "timestamp", "event_type", "original_text", "redacted_text",
        "to_json(pii_detected) AS pii_detected", "to_json(policy_violations) AS policy_violations",
        "action_taken", "user_id", "session_id", "to_json(metadata) AS metadata", "hash", "prev_hash",
    )
    imported = audit_op.import_log(log)
    checked = chain_op.check_chain(imported)
    return imported.join(checked.select("chain_id", "seq", "hash_ok", "link_ok"), ["chain_id", "seq"]).select(
        "seq",
        _joined(F.col("pii_detected"), "type", "name", "severity").alias("pii_detected"),
        _joined(F.col("policy_violations"), "policy", "category", "action", "message").alias("policy_violations"),
        F.element_at("metadata", "source").alias("origin"),
        "hash_ok",
        "link_ok",
    )


def audit_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_op.chain_heads(_log(spark, sf_dir))


def audit_cut_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of a log whose last day is missing, found by their recorded heads."""
    log = _log(spark, sf_dir)
    heads = chain_op.chain_heads(log)
    last_day = log.agg(F.max("dt")).first()[0]
    return chain_op.cut_tails(log.filter(F.col("dt") < F.lit(last_day)), heads)


def _log_columns(log: DataFrame) -> DataFrame:
    return log.select(
        "event_id", "chain_id", "seq", "timestamp", "event_type", "action_taken", "user_id", "session_id",
        "redacted_text", _long(F.size("pii_detected")).alias("n_pii"),
        _long(F.size("policy_violations")).alias("n_violations"), "hash",
    )


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit_op.query_audit(
        _log(spark, sf_dir), 200, 0, start_date="2024-01-05", end_date="2024-01-12T18:00:00", action_taken="blocked"
    )
    return _log_columns(found)


def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_columns(audit_op.query_audit(_log(spark, sf_dir), 100, 300, event_type="view"))


def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_columns(audit_op.recent_audit(_log(spark, sf_dir)))


def audit_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a CSV export holds, read back from the files."""
    path = new_path(spark, "export-csv")
    audit_op.export_logs(_log(spark, sf_dir), path, "csv", start_date="2024-01-10")
    return (
        spark.read.option("header", True)
        .schema("id long, timestamp string, event_type string, action_taken string, pii_count long, "
                "violation_count long, hash string")
        .csv(path)
    )


def audit_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a JSON export holds, read back from the files."""
    log = _log(spark, sf_dir)
    path = new_path(spark, "export-json")
    audit_op.export_logs(log, path, "json", start_date="2024-01-10")
    back = spark.read.schema(log.schema).json(path)
    return back.select(
        "event_id", "seq", "original_text", "redacted_text", "user_id",
        _joined(F.col("pii_detected"), "type", "name", "severity").alias("pii_detected"),
        F.element_at("metadata", "source").alias("origin"), "hash",
    )


def audit_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that stay after a purge, per chain."""
    kept = retention_op.kept_entries(_log(spark, sf_dir), PURGE_BEFORE)
    return kept.groupBy("chain_id").agg(F.count(F.lit(1)).alias("kept"), F.min("seq").alias("first_seq"))


def audit_purge_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention_op.purge_anchors(_log(spark, sf_dir), PURGE_BEFORE)


def audit_verify_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purged log checked from its anchors, all links included."""
    log = _log(spark, sf_dir)
    anchors = retention_op.purge_anchors(log, PURGE_BEFORE)
    checked = chain_op.check_chain(retention_op.kept_entries(log, PURGE_BEFORE), anchors=anchors)
    return chain_op.chain_report(checked)


def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to a stored log, the first one twice; what each chain holds afterwards."""
    log = AuditTable(spark, new_path(spark, "log"))
    events = views.table(spark, sf_dir, "events")
    first = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    for batch, part in enumerate((events.filter(first), events.filter(first), events.filter(~first))):
        log.append(views.event_entries(part), max(batch - 1, 0), ("ts", "event_id"))
    return _chain_ends(log)


def audit_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers that both count their batches from 0, in one log: the second goes on where the first ended."""
    log = AuditTable(spark, new_path(spark, "log"))
    events = views.table(spark, sf_dir, "events")
    first = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    log.append(views.event_entries(events.filter(first)), 0, ("ts", "event_id"), writer="early")
    log.append(views.event_entries(events.filter(~first)), 0, ("ts", "event_id"), writer="late")
    return _chain_ends(log)


def audit_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append, append late entries, purge by time, check: the report and what is left of the log."""
    log = AuditTable(spark, new_path(spark, "log"))
    events = views.table(spark, sf_dir, "events")
    late = F.col("event_id") % 10 == 0
    log.append(views.event_entries(events.filter(~late)), 0, ("ts", "event_id"))
    log.append(views.event_entries(events.filter(late)), 1, ("ts", "event_id"))
    purged = log.purge(PURGE_BEFORE)
    cut = log.cut_tails().count()
    return chain_op.chain_report(log.check()).withColumns({"purged": F.lit(purged).cast("long"), "cut": F.lit(cut).cast("long")})


def _chain_ends(log: AuditTable) -> DataFrame:
    return log.entries().groupBy("chain_id").agg(
        F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("last_hash"), F.count(F.lit(1)).alias("entries")
    )


# --- statistics -----------------------------------------------------------------------------------------


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_op.daily_statistics(views.event_entries(views.table(spark, sf_dir, "events")))


def stats_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir).withColumn("date", F.col("date").cast("string"))


def stats_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of two halves of the log, added up."""
    entries = views.event_entries(views.table(spark, sf_dir, "events"))
    half = F.col("event_id") % 2 == 0
    merged = stats_op.merge_statistics(
        stats_op.daily_statistics(entries.filter(half)), stats_op.daily_statistics(entries.filter(~half))
    )
    return merged.withColumn("date", F.col("date").cast("string"))


def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_op.statistics_summary(_statistics(spark, sf_dir), AS_OF, stats_op.TOOL_DAYS)


def stats_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats_op.statistics_breakdown(_statistics(spark, sf_dir), AS_OF, stats_op.TOOL_DAYS)
    return rows.withColumn("date", F.col("date").cast("string"))


def unique_users_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = stats_op.unique_users_daily(views.event_entries(views.table(spark, sf_dir, "events")))
    return users.withColumn("date", F.col("date").cast("string"))


def rate_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with more than one event in an hour."""
    found = audit_op.rate_breaches(views.table(spark, sf_dir, "events"), 1, "1 hour")
    return found.withColumn("window_start", F.expr(iso_timestamp("window_start")))


# --- streams --------------------------------------------------------------------------------------------


def scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = views.turns(jobs.read_table_stream(spark, f"{sf_dir}/conversations.parquet"))
    scanned = jobs.run_to_table(jobs.scan_stream(stream, "text", EXTENDED), "scan-stream")
    return _scan_columns(scanned, "conv_id", "turn", "role")


def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that a stream of events leaves behind."""
    log = AuditTable(spark, new_path(spark, "stream-log"))
    stream = jobs.read_table_stream(spark, f"{sf_dir}/events.parquet")
    writer = jobs.audit_stream(stream, log, views.event_entries, ("ts", "event_id"))
    query = (
        writer.option("checkpointLocation", new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return log.entries().select("chain_id", "seq", "timestamp", "action_taken", "prev_hash", "hash")


PHRASE_WORDS = 3
PHRASE_CHARS = 3


def benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword catalog from data: every phrase of 1 to ``PHRASE_WORDS`` words (blank-separated, lower-cased) of
    ``benchmark`` with at least ``PHRASE_CHARS`` characters; catalog order is the phrase itself."""
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    bench = views.table(spark, sf_dir, "benchmark").select(words.alias("ws"))
    phrases = None
    for n in range(1, PHRASE_WORDS + 1):
        these = bench.select(
            F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " "))).alias("keyword")
        )
        phrases = these if phrases is None else phrases.unionByName(these)
    return (
        phrases.where(F.length("keyword") >= PHRASE_CHARS)
        .distinct()
        .select(F.lit("benchmark_phrase").alias("policy_name"), "keyword", F.col("keyword").alias("ordinal"))
    )


def keywords_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding benchmark phrases, found through the trigram anchor index of a catalog table."""
    docs = views.table(spark, sf_dir, "documents")
    found = keyword_matches(docs, benchmark_phrases(spark, sf_dir), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), "policy_name", "matched_keyword", "n_keywords")


STREAM_PARTS = 4


def audit_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all events delivered in ``STREAM_PARTS`` parts by time, chained with the heads in the state store;
    the stream restarts from its checkpoint for every part."""
    events = views.table(spark, sf_dir, "events")
    log = run_in_parts(
        spark, events, "ts", STREAM_PARTS, views.event_entries, ("ts", "event_id"), ("event_id",), new_path(spark, "chain-state")
    )
    return log.select("chain_id", "seq", "timestamp", "action_taken", "prev_hash", "hash")


def stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = jobs.read_table_stream(spark, f"{sf_dir}/events.parquet")
    entries = views.event_entries(stream).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = jobs.run_updates(jobs.statistics_stream(entries), "date", "stats-stream")
    return rows.withColumn("date", F.col("date").cast("string"))


QUERIES: dict[str, Query] = {
    "scan_actions_by_role": scan_actions_by_role,
    "pattern_catalog": pattern_catalog,
    "policy_catalog": policy_catalog,
    "pii_matches": pii_matches,
    "pii_matches_extended": pii_matches_extended,
    "pii_matches_custom": pii_matches_custom,
    "pii_matches_from_file": pii_matches_from_file,
    "pii_conversations": pii_conversations,
    "luhn_cards": luhn_cards,
    "redact_literal": _redacted("[REDACTED]"),
    "redact_custom_literal": _redacted("***", extended=False),
    "redact_type": _redacted("[REDACTED-TYPE]"),
    "redact_xxx": _redacted("[REDACTED-XXX]"),
    "redact_splice": _redacted("[REDACTED]", "splice"),
    "redact_splice_type": _redacted("[REDACTED-TYPE]", "splice"),
    "redact_tool": redact_tool,
    "pii_summary_row": pii_summary_row,
    "pii_by_type": pii_by_type,
    "pii_by_lang": pii_by_lang,
    "pii_cube": pii_cube,
    "pii_pages": pii_pages,
    "policy_violations": _violations(CORE),
    "policy_violations_extended": _violations(EXTENDED),
    "policy_violations_custom": _violations(CORE, views.CUSTOM_POLICIES),
    "policy_violations_whole_word": _violations(ScanConfig(whole_word=True)),
    "policy_violations_from_file": policy_violations_from_file,
    "policy_pages": policy_pages,
    "policy_summary_row": policy_summary_row,
    "policy_by_category": policy_by_category,
    "policy_rollup": policy_rollup,
    "policy_actions": policy_actions,
    "policy_actions_ascii": policy_actions_ascii,
    "scan_prompts": scan_prompts,
    "scan_without_pii": scan_without_pii,
    "scan_without_policies": scan_without_policies,
    "scan_overlong": scan_overlong,
    "compliance": compliance,
    "risk_scores": risk_scores,
    "risk_levels": risk_levels,
    "risk_topk": risk_topk,
    "truncate": truncate,
    "sanitize": sanitize,
    "entry_hashes": entry_hashes,
    "audit_chain": audit_chain,
    "audit_chain_segments": audit_chain_segments,
    "scan_logged": scan_logged,
    "audit_verify": audit_verify,
    "audit_seals": audit_seals,
    "audit_forged_segment": audit_forged_segment,
    "audit_verify_tampered": audit_verify_tampered,
    "audit_verify_rehashed": audit_verify_rehashed,
    "audit_import": audit_import,
    "audit_heads": audit_heads,
    "audit_cut_tails": audit_cut_tails,
    "audit_query": audit_query,
    "audit_page": audit_page,
    "audit_recent": audit_recent,
    "audit_export_csv": audit_export_csv,
    "audit_export_json": audit_export_json,
    "audit_purge": audit_purge,
    "audit_purge_anchors": audit_purge_anchors,
    "audit_verify_purged": audit_verify_purged,
    "audit_table": audit_table,
    "audit_two_writers": audit_two_writers,
    "audit_life": audit_life,
    "stats_daily": stats_daily,
    "stats_merged": stats_merged,
    "stats_summary": stats_summary,
    "stats_breakdown": stats_breakdown,
    "unique_users_daily": unique_users_daily,
    "rate_breaches": rate_breaches,
    "scan_stream": scan_stream,
    "audit_stream": audit_stream,
    "audit_stream_state": audit_stream_state,
    "keywords_indexed": keywords_indexed,
    "stats_stream": stats_stream,
}
