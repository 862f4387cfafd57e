"""Registered queries of groups K and L (API queries, metrics), with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators import anomaly, ingest, metrics, portal, security
from emberwatch.operators.evaluate import cost
from emberwatch.plans import anomaly as anomaly_plans
from emberwatch.plans import context as context_plans
from emberwatch.plans.anomaly import _MERGED
from emberwatch.plans.context import _RED
from emberwatch.plans.fixtures import Tables, with_views
from emberwatch.plans.ingest import _PARSED, parsed
from emberwatch.plans.security import _FULL, _PII, _last_p, _sum


def events_table(t: Tables) -> DataFrame:
    return security.security_events(security.security_scan(t.scan))


def _keys(t: Tables) -> DataFrame:
    """Keys presented by customers, a sixth of them unknown."""
    return (t.customer.join(t.region, F.col("c_nationkey") % 6 == F.col("r_regionkey"), "left")
            .select("c_custkey", F.concat(F.lit("key-"), F.coalesce("r_name", F.lit("none"))).alias("api_key")))


def _seconds(col: str):
    return F.col(col) / 1000.0


def _histograms(t: Tables) -> DataFrame:
    times = metrics.latency_histograms(t.rca, {
        "llm_seconds": (_seconds("llm_latency_ms"), metrics.LLM_SECONDS, True),
        "tool_seconds": (_seconds("tool_latency_ms"), metrics.TOOL_SECONDS, True)}, ["tenant_id"])
    faith = metrics.latency_histogram(t.evals, F.col("faithfulness_score"), ["tenant_id"], metrics.SCORES, positive_only=False)
    ratio = metrics.latency_histogram(context_plans.stats(t), F.col("compression_ratio"), ["tenant_id"], metrics.RATIOS)
    named = times
    for name, df in (("faithfulness", faith), ("compression_ratio", ratio)):
        named = named.unionByName(df.withColumn("metric", F.lit(name)))
    return named.select("metric", "tenant_id", "le", "bucket_count", "count", F.round("sum", 3).alias("sum"))


def _counters(t: Tables) -> DataFrame:
    """Counters of several services in one long table: metric, label, tenant, value."""
    ingested = ingest.tenant_extract(parsed(t)).withColumn(
        "label", F.when(ingest.reject_reason().isNull(), "accepted").otherwise("rejected"))
    parts = {
        "ingested": metrics.metric_counters(ingested, ["label", "tenant_id"]),
        "anomalies": metrics.metric_counters(anomaly_plans.merged(t).withColumnRenamed("anomaly_type", "label"), ["label", "tenant_id"]),
        "verifications": metrics.metric_counters(
            t.alerts.join(anomaly_plans.verdicts(t), "alert_id").withColumn(
                "label", F.when(anomaly.is_yes("verdict"), "confirmed").otherwise("false_positive")), ["label", "tenant_id"]),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("metric"), "label", "tenant_id", F.col("value").cast("long").alias("value"))
        out = df if out is None else out.unionByName(df)
    return out.unionByName(_result_counters(t))


def _result_counters(t: Tables) -> DataFrame:
    """All counters of investigation results from one aggregate of the results."""
    base = cost(t.rca).withColumn("_usd", F.round(F.col("cost_usd") * 1e6).cast("long")).groupBy(
        "tenant_id", "status", "model_used", "failure_reason").agg(
        F.count("*").alias("n"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum("_usd").alias("usd"))

    def counter(metric: str, label: Column, value: str) -> Column:
        return F.struct(F.lit(metric).alias("metric"), label.alias("label"), F.col(value).cast("long").alias("value"))

    rows = F.array(counter("investigations", F.concat_ws("/", "status", "model_used"), "n"),
                   counter("tokens", F.lit("input"), "input"), counter("tokens", F.lit("output"), "output"),
                   counter("micro_usd", F.col("model_used"), "usd"), counter("failures", F.col("failure_reason"), "n"))
    wide = base.select("tenant_id", "status", F.inline(rows)).where((F.col("metric") != "failures") | (F.col("status") == "failed"))
    return wide.groupBy("metric", "label", "tenant_id").agg(F.sum("value").alias("value"))


_ALERT_COLS = ["alert_id", "tenant_id", "service", "severity", "status"]

QUERIES = {
    "recent_logs": lambda t: portal.recent_logs(t.logs, level="ERROR", limit=100).select("tenant_id", "position", "log_id", "service"),
    "alerts_latest_incident": lambda t: portal.alerts_latest_incident(t.alerts, t.incidents, severity="critical").select(
        *_ALERT_COLS, "is_cascade", F.array_join("affected_services", ",").alias("affected_services")),
    "alert_detail": lambda t: portal.alert_detail(t.alerts, t.incidents, t.rca).select(
        *_ALERT_COLS, "incident_id", "correlation_window_ms", "compression_ratio", "was_compressed",
        F.coalesce("rca_id", F.lit("-")).alias("rca_id"), F.coalesce("model_used", F.lit("-")).alias("model_used"),
        F.coalesce("rca_status", F.lit("-")).alias("rca_status")),
    "investigations": lambda t: portal.investigations(t.rca, limit=50).select(
        "tenant_id", "position", "rca_id", "status", "root_cause", "confidence"),
    "failed_investigations": lambda t: portal.failed_investigations(t.rca, limit=50).select(
        "tenant_id", "position", "rca_id", "failure_reason"),
    "investigation_detail": lambda t: portal.investigation_detail(t.rca, t.incidents, t.evals).select(
        "rca_id", "incident_id", "tenant_id", "is_cascade", F.array_join("alert_ids", ",").alias("alert_ids"),
        F.coalesce("eval_mode", F.lit("-")).alias("eval_mode"),
        F.coalesce("hallucination_score", F.lit(-1.0)).alias("hallucination_score")),
    "manual_trigger_payload": lambda t: portal.manual_trigger_payload(t.incidents, t.alerts).select(
        "incident_id", "tenant_id", "severity", "model_id", "compressed_context", "compression_ratio", "incident_description"),
    "security_events_page": lambda t: portal.security_events_page(events_table(t), event_type="pii", limit=50).select(
        "tenant_id", "position", "event_id", "total"),
    "kb_stats": lambda t: portal.kb_stats(t.past).withColumn("services", F.array_join("services", ",")),
    "alert_search": lambda t: portal.alert_search(t.alerts, service="PUR", severity="HIGH").select(
        "alert_id", "tenant_id", "service", "shown", "total"),
    "tenant_by_key_hash": lambda t: portal.tenant_by_key_hash(_keys(t), t.tenants).select("c_custkey", "tenant_id", "model_tier"),
    "metric_counters": _counters,
    "latency_histogram": _histograms,
    "latest_gauge": lambda t: metrics.latest_gauge(t.rca, ["tenant_id"], "confidence", ["created_at", "rca_id"]),
    "rate_per_service": lambda t: metrics.rate_per_service(t.logs).withColumn("per_second", F.round("per_second", 6)),
    "level_distribution": lambda t: metrics.level_distribution(t.logs).withColumn("share", F.round("share", 6)),
    "model_share": lambda t: metrics.share(t.rca, ["model_used"], ["tenant_id"]).withColumn("share", F.round("share", 6)),
    "latency_percentiles": lambda t: metrics.latency_percentiles(t.rca).select(
        "tenant_id", F.round("p50_ms", 3).alias("p50_ms"), F.round("p95_ms", 3).alias("p95_ms")),
}

_LATEST = """contained AS (
    SELECT i.*, unnest(alert_ids) AS alert_id FROM incidents_v i),
  latest AS (
    SELECT * FROM contained QUALIFY row_number() OVER (PARTITION BY tenant_id, alert_id ORDER BY created_at DESC, incident_id DESC) = 1)"""
_RANK = "CASE a.severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


def _hist(metric: str, source: str, value: str, bounds: list[float], positive: bool = True) -> str:
    les = ", ".join(f"('{b}', {b!r}e0)" for b in bounds)
    keep = f"{value} > 0" if positive else f"{value} IS NOT NULL"
    return f"""SELECT '{metric}' AS metric, tenant_id, le, count(*) FILTER (v <= bound) AS bucket_count, count(*) AS count,
        round(sum(v), 3) AS sum
      FROM (SELECT tenant_id, {value} AS v FROM {source} WHERE {keep})
      CROSS JOIN (VALUES {les}, ('+Inf', CAST('infinity' AS DOUBLE))) AS b(le, bound) GROUP BY ALL"""


ORACLES = {
    "recent_logs": """SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, log_id DESC) AS position,
        log_id, service FROM logs_v WHERE level = 'ERROR' QUALIFY position <= 100""",
    "alerts_latest_incident": f"""WITH {_LATEST} SELECT a.alert_id, a.tenant_id, a.service, a.severity, a.status,
        coalesce(l.is_cascade, FALSE) AS is_cascade, coalesce(array_to_string(l.affected_services, ','), '') AS affected_services
      FROM alerts_v a LEFT JOIN latest l ON l.alert_id = a.alert_id AND l.tenant_id = a.tenant_id WHERE a.severity = 'CRITICAL'""",
    "alert_detail": f"""WITH {_LATEST}, lr AS (
        SELECT * FROM rca_v QUALIFY row_number() OVER (PARTITION BY incident_id, tenant_id ORDER BY created_at DESC, rca_id DESC) = 1)
      SELECT a.alert_id, a.tenant_id, a.service, a.severity, a.status, l.incident_id, l.correlation_window_ms,
             l.compression_ratio, l.was_compressed, coalesce(r.rca_id, '-') AS rca_id,
             coalesce(r.model_used, '-') AS model_used, coalesce(r.status, '-') AS rca_status
      FROM alerts_v a LEFT JOIN latest l ON l.alert_id = a.alert_id AND l.tenant_id = a.tenant_id
      LEFT JOIN lr r ON r.incident_id = l.incident_id AND r.tenant_id = l.tenant_id""",
    "investigations": """SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, rca_id DESC) AS position,
        rca_id, status, root_cause, confidence FROM rca_v QUALIFY position <= 50""",
    "failed_investigations": """SELECT tenant_id,
        row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, rca_id DESC) AS position, rca_id, failure_reason
      FROM rca_v WHERE status = 'failed' QUALIFY position <= 50""",
    "investigation_detail": """WITH le AS (
        SELECT * FROM evals_v QUALIFY row_number() OVER (PARTITION BY rca_id ORDER BY evaluated_at DESC, eval_id DESC) = 1)
      SELECT r.rca_id, r.incident_id, r.tenant_id, i.is_cascade, array_to_string(i.alert_ids, ',') AS alert_ids,
             coalesce(e.eval_mode, '-') AS eval_mode, coalesce(e.hallucination_score, -1) AS hallucination_score
      FROM rca_v r LEFT JOIN incidents_v i ON i.incident_id = r.incident_id AND i.tenant_id = r.tenant_id
      LEFT JOIN le e ON e.rca_id = r.rca_id""",
    "manual_trigger_payload": f"""WITH sev AS (
        SELECT i.incident_id, arg_max(a.severity, {_RANK}) AS severity
        FROM (SELECT incident_id, tenant_id, unnest(alert_ids) AS alert_id FROM incidents_v) i
        JOIN alerts_v a ON a.alert_id = i.alert_id AND a.tenant_id = i.tenant_id GROUP BY 1)
      SELECT i.incident_id, i.tenant_id, s.severity, 'gpt-4-turbo' AS model_id,
             'Manual RCA trigger for incident ' || i.incident_id || '. Affected services: '
                 || array_to_string(i.affected_services, ', ') || '. Severity: ' || s.severity || '.' AS compressed_context,
             i.compression_ratio, 'Manual investigation trigger. Services: ' || array_to_string(i.affected_services, ', ')
                 || '. Cascade: ' || CASE WHEN i.is_cascade THEN 'True' ELSE 'False' END || '.' AS incident_description
      FROM incidents_v i JOIN sev s ON s.incident_id = i.incident_id""",
    "kb_stats": """SELECT tenant_id, count(*) AS total, count(*) FILTER (source = 'seed') AS seed_count,
        count(*) FILTER (source = 'auto_learned') AS auto_learned_count,
        array_to_string(list_sort(list(DISTINCT service)), ',') AS services FROM past_v GROUP BY 1""",
    "alert_search": """SELECT alert_id, tenant_id, service, shown, total FROM (
        SELECT *, count(*) OVER (PARTITION BY tenant_id) AS total,
               count(*) FILTER (contains(service, 'pur') AND severity = 'HIGH') OVER (PARTITION BY tenant_id) AS shown FROM alerts_v)
      WHERE contains(service, 'pur') AND severity = 'HIGH'""",
    "tenant_by_key_hash": """SELECT c_custkey, CAST(r_regionkey AS VARCHAR) AS tenant_id,
        CASE WHEN r_regionkey % 2 = 0 THEN 'premium' ELSE 'standard' END AS model_tier
      FROM customer JOIN region ON c_nationkey % 6 = r_regionkey""",
    "latest_gauge": "SELECT tenant_id, arg_max(confidence, ISO(created_at) || rca_id) AS value FROM rca_v GROUP BY 1",
    "rate_per_service": """SELECT tenant_id, service, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start, count(*) AS logs,
        round(count(*) / 3600, 6) AS per_second FROM logs_v GROUP BY ALL""",
    "level_distribution": """SELECT tenant_id, level, count(*) AS n,
        round(count(*) / sum(count(*)) OVER (PARTITION BY tenant_id), 6) AS share FROM logs_v GROUP BY tenant_id, level""",
    "model_share": """SELECT tenant_id, model_used, count(*) AS n,
        round(count(*) / sum(count(*)) OVER (PARTITION BY tenant_id), 6) AS share FROM rca_v GROUP BY tenant_id, model_used""",
    "latency_percentiles": """SELECT tenant_id, round(quantile_cont(total_latency_ms, 0.5), 3) AS p50_ms,
        round(quantile_cont(total_latency_ms, 0.95), 3) AS p95_ms FROM rca_v GROUP BY 1""",
}


def _body(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


ORACLES["security_events_page"] = f"""{_FULL}, ev AS (
    SELECT coalesce(tenant_id, 'unknown') AS tenant_id,
           'sec-' || substr(sha256(log_id || '|pii'), 1, 32) AS event_id, ts FROM {_last_p} WHERE {_sum(_PII, 'p')} > 0)
  SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id DESC) AS position, event_id,
         count(*) OVER (PARTITION BY tenant_id) AS total FROM ev QUALIFY position <= 50"""
ORACLES["latency_histogram"] = _body(_RED, " UNION ALL ".join([
    _hist("llm_seconds", "rca_v", "llm_latency_ms / 1e3", metrics.LLM_SECONDS),
    _hist("tool_seconds", "rca_v", "tool_latency_ms / 1e3", metrics.TOOL_SECONDS),
    _hist("faithfulness", "evals_v", "faithfulness_score", metrics.SCORES, positive=False),
    _hist("compression_ratio", "(SELECT tenant_id, tokens_out / tokens AS compression_ratio FROM stats)",
          "compression_ratio", metrics.RATIOS)]))
ORACLES["metric_counters"] = _body(_MERGED + ", " + _PARSED, """, cnt AS (
    SELECT 'ingested' AS metric, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS label,
           coalesce(nullif(meta_tenant, ''), 'unknown') AS tenant_id, 1 AS v FROM checked
    UNION ALL SELECT 'anomalies', anomaly_type, tenant_id, 1 FROM merged
    UNION ALL SELECT 'verifications', CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'confirmed' ELSE 'false_positive' END,
      tenant_id, 1 FROM alerts_v WHERE status = 'open'
    UNION ALL SELECT 'investigations', status || '/' || model_used, tenant_id, 1 FROM rca_v
    UNION ALL SELECT 'failures', failure_reason, tenant_id, 1 FROM rca_v WHERE status = 'failed'
    UNION ALL SELECT 'tokens', 'input', tenant_id, input_tokens FROM rca_v
    UNION ALL SELECT 'tokens', 'output', tenant_id, output_tokens FROM rca_v
    UNION ALL SELECT 'micro_usd', model_used, tenant_id,
      CAST(round((input_tokens * CASE WHEN model_used IN ('gpt-4', 'gpt-4-turbo') THEN 10 ELSE 1 END
                + output_tokens * CASE WHEN model_used IN ('gpt-4', 'gpt-4-turbo') THEN 30 ELSE 2 END)) AS BIGINT) FROM rca_v)
  SELECT metric, label, tenant_id, CAST(sum(v) AS BIGINT) AS value FROM cnt GROUP BY ALL""")
ORACLES = {name: with_views(sql) for name, sql in ORACLES.items()}
