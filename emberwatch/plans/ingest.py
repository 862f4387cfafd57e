"""Registered queries of group A, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import iso
from emberwatch.operators import ingest as op
from emberwatch.plans.fixtures import Tables, with_views
from emberwatch.sources.tables import week_label, week_start


def parsed(t: Tables) -> DataFrame:
    return op.log_parse(t.raw)


def _flat(df: DataFrame) -> DataFrame:
    return df.select("raw_id", "service", "level", "message", F.coalesce("trace_id", F.lit("-")).alias("trace_id"),
                     iso(F.col("ts")).alias("ts"))


def _validated(t: Tables) -> DataFrame:
    return op.log_tagged(parsed(t)).select("raw_id", F.coalesce("reject_reason", F.lit("-")).alias("reject_reason"))


def _required(t: Tables) -> DataFrame:
    fields = ["service", "level", "message", "trace_id", "timestamp"]
    return op.missing_fields(t.raw, fields).select("raw_id", F.array_join("missing", ",").alias("missing"))


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two generations of investigation rows per incident."""
    cols = ["incident_id", "tenant_id", "rca_id", "status", "created_at"]
    first, last = t.rca.where(F.col("status") == "success"), t.rca
    seq = F.concat(iso(F.col("created_at")), F.lit("|"), F.col("rca_id"))
    return (first.select(*cols, F.concat(F.lit("0|"), seq).alias("seq")),
            last.select(*cols, F.concat(F.lit("1|"), seq).alias("seq")))


def _upsert(t: Tables, do_nothing: bool) -> DataFrame:
    out = op.upsert_latest(*_versions(t), ["incident_id"], seq="seq", do_nothing=do_nothing)
    return out.select("incident_id", "tenant_id", "rca_id", "status", iso(F.col("created_at")).alias("created_at"))


def _labels(t: Tables) -> DataFrame:
    return (t.past.select(F.concat(F.lit("al-"), F.regexp_extract("incident_id", r"(\d+)", 1), F.lit("-"), "tenant_id").alias("alert_id"),
                          "tenant_id", F.col("description").alias("label"), F.lit(1).alias("seq")))


def _compression(t: Tables) -> DataFrame:
    return (t.rca.groupBy("incident_id").agg(
        (F.sum("output_tokens") / F.sum("input_tokens")).alias("compression_ratio"),
        F.sum("output_tokens").alias("original_log_count"), F.lit(True).alias("was_compressed")))


QUERIES = {
    "log_parse": lambda t: _flat(parsed(t)),
    "log_validate": _validated,
    "log_enrich": lambda t: op.log_enrich(op.log_validate(parsed(t))[0]).select(
        "raw_id", "trace_id", F.size("metadata").alias("metadata_keys"), F.col("ingested_at").isNotNull().alias("stamped")),
    "tenant_extract": lambda t: op.tenant_extract(parsed(t)).select("raw_id", "tenant_id"),
    "batch_dedup_trace": lambda t: op.batch_dedup_trace(
        t.logs.select("log_id", "trace_id", F.floor(F.col("log_id") / 100).alias("batch")), batch="batch", order="log_id")
        .select("log_id", "batch", F.coalesce("trace_id", F.lit("-")).alias("trace_id")),
    "weekly_partition": lambda t: t.logs.groupBy(
        week_start(F.col("ts")).cast("string").alias("week"), week_label(F.col("ts")).alias("label"))
        .agg(F.count("*").alias("logs")),
    "dead_letter": lambda t: op.dead_letter(
        op.log_validate(parsed(t))[1], topic="logs.raw", reason="reject_reason", payload="value", seen="received_at")
        .select("original_topic", "failure_reason", "retry_count", iso(F.col("first_seen_at")).alias("first_seen_at"),
                "original_payload"),
    "required_fields": _required,
    "rca_upsert": lambda t: _upsert(t, False),
    "rca_insert_once": lambda t: _upsert(t, True),
    "alert_label": lambda t: op.alert_label(t.alerts, _labels(t)).select(
        "alert_id", "tenant_id", F.sha2(F.coalesce("ground_truth", F.lit("-")), 256).alias("truth_hash")),
    "incident_compression_update": lambda t: op.incident_compression_update(t.incidents, _compression(t)).select(
        "incident_id", F.round("compression_ratio", 6).alias("compression_ratio"), "original_log_count", "was_compressed"),
}

_PARSED = """parsed AS (
    SELECT raw_id, received_at, value, json_extract_string(value, '$.service') AS service,
           json_extract_string(value, '$.level') AS level, json_extract_string(value, '$.message') AS message,
           json_extract_string(value, '$.trace_id') AS trace_id,
           json_extract_string(value, '$.metadata.tenant_id') AS meta_tenant,
           coalesce(try_cast(replace(json_extract_string(value, '$.timestamp'), 'Z', '') AS TIMESTAMP), received_at) AS ts
    FROM raw_v WHERE json_valid(value)),
  checked AS (
    SELECT *, CASE WHEN coalesce(service, '') = '' THEN 'service is required'
                   WHEN coalesce(level, '') = '' THEN 'level is required'
                   WHEN coalesce(message, '') = '' THEN 'message is required'
                   WHEN level NOT IN ('DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL') THEN 'level is not valid' END AS reason
    FROM parsed)"""
_GEN = """gens AS (
    SELECT *, '0|' || ISO(created_at) || '|' || rca_id AS seq FROM rca_v WHERE status = 'success'
    UNION ALL SELECT *, '1|' || ISO(created_at) || '|' || rca_id FROM rca_v)"""

ORACLES = {
    "log_parse": f"""WITH {_PARSED} SELECT raw_id, service, level, message, coalesce(trace_id, '-') AS trace_id,
        ISO(ts) AS ts FROM parsed""",
    "log_validate": f"WITH {_PARSED} SELECT raw_id, coalesce(reason, '-') AS reject_reason FROM checked",
    "log_enrich": f"""WITH {_PARSED} SELECT raw_id,
        CASE WHEN coalesce(trace_id, '') = '' THEN 'gen-' || substr(sha256(CAST(raw_id AS VARCHAR)), 1, 32) ELSE trace_id END
            AS trace_id,
        CASE WHEN meta_tenant IS NULL THEN 0 ELSE 1 END AS metadata_keys, TRUE AS stamped FROM checked WHERE reason IS NULL""",
    "tenant_extract": f"WITH {_PARSED} SELECT raw_id, coalesce(nullif(meta_tenant, ''), 'unknown') AS tenant_id FROM parsed",
    "batch_dedup_trace": """WITH b AS (SELECT log_id, trace_id, CAST(floor(log_id / 100) AS BIGINT) AS batch FROM logs_v)
      SELECT log_id, batch, coalesce(trace_id, '-') AS trace_id FROM b
      QUALIFY trace_id IS NULL OR row_number() OVER (PARTITION BY batch, trace_id ORDER BY log_id) = 1""",
    "weekly_partition": """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week,
        'logs_y' || strftime(ts, '%G') || '_w' || strftime(ts, '%V') AS label, count(*) AS logs FROM logs_v GROUP BY ALL""",
    "dead_letter": f"""WITH {_PARSED} SELECT 'logs.raw' AS original_topic, reason AS failure_reason, 0 AS retry_count,
        ISO(received_at) AS first_seen_at, value AS original_payload FROM checked WHERE reason IS NOT NULL""",
    "required_fields": """WITH k AS (
        SELECT raw_id, CASE WHEN json_valid(value) THEN json_keys(value) ELSE [] END AS keys FROM raw_v)
      SELECT raw_id, array_to_string(list_filter(['service', 'level', 'message', 'trace_id', 'timestamp'],
             lambda f: NOT list_contains(keys, f)), ',') AS missing FROM k""",
    "rca_upsert": f"""WITH {_GEN} SELECT incident_id, arg_max(tenant_id, seq) AS tenant_id, arg_max(rca_id, seq) AS rca_id,
        arg_max(status, seq) AS status, strftime(arg_min(created_at, seq), '%Y-%m-%dT%H:%M:%S.%f') AS created_at
      FROM gens GROUP BY incident_id""",
    "rca_insert_once": f"""WITH {_GEN} SELECT incident_id, tenant_id, rca_id, status, ISO(created_at) AS created_at FROM gens
      QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY seq) = 1""",
    "alert_label": """SELECT a.alert_id, a.tenant_id, sha256(coalesce(trim(p.description, E' \\t\\r\\n'), a.ground_truth, '-')) AS truth_hash
      FROM alerts_v a LEFT JOIN past_v p
        ON 'al-' || regexp_extract(p.incident_id, '([0-9]+)', 1) || '-' || p.tenant_id = a.alert_id
       AND length(trim(p.description, E' \\t\\r\\n')) BETWEEN 10 AND 1000""",
    "incident_compression_update": """WITH s AS (
        SELECT incident_id, sum(output_tokens) / sum(input_tokens) AS ratio, sum(output_tokens) AS n FROM rca_v GROUP BY 1)
      SELECT i.incident_id, round(coalesce(s.ratio, i.compression_ratio), 6) AS compression_ratio,
             CAST(coalesce(s.n, i.original_log_count) AS BIGINT) AS original_log_count,
             CASE WHEN s.incident_id IS NOT NULL THEN TRUE ELSE i.was_compressed END AS was_compressed
      FROM incidents_v i LEFT JOIN s USING (incident_id)""",
}
ORACLES = {name: with_views(sql) for name, sql in ORACLES.items()}
