"""The chain as one query: every stage takes what the one before it gave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import iso
from emberwatch.operators import anomaly, context, correlate, security
from emberwatch.operators.ordered import full_ranks
from emberwatch.plans.anomaly import DAY, HOUR, NOVELTY_SEVERITY, SCORED, novelty_fold
from emberwatch.plans.fixtures import Tables, with_views
from emberwatch.plans.security import CLEAN

THRESHOLD, COOLDOWN_S, WINDOW_S = 0.3, 4 * HOUR, 6 * HOUR


def clean_logs(t: Tables) -> DataFrame:
    return security.security_clean(t.logs)


def log_vectors(t: Tables, logs: DataFrame) -> DataFrame:
    """Error logs with a vector of the embeddings table: all vectors by their position in the order of ids, round and
    round, so that every error log has one. Without any vector there are none."""
    placed = full_ranks(t.embeddings.select("vec_id", "embedding"), [], ["vec_id"], F.floor(F.col("vec_id") / 4096))
    vectors = placed.select((F.col("rank") - 1).cast("long").alias("_v"), "embedding")
    place = F.pmod("log_id", F.greatest(F.lit(1).cast("long"), t.embeddings.agg(F.count("*")).scalar()))
    return (logs.where(F.col("level").isin(*anomaly.ERROR_LEVELS)).withColumn("_v", place).join(vectors, "_v")
            .select("tenant_id", "service", F.col("log_id").alias("id"), "ts", "embedding"))


def detected(t: Tables) -> DataFrame:
    """Alerts of both detectors that were not judged noise, one per series and cooldown."""
    logs = clean_logs(t)
    scored = anomaly.zscore(anomaly.bucket_counts(logs, bucket_s=HOUR), window_s=DAY, bucket_s=HOUR)
    spikes = anomaly.spike_priority(anomaly.zscore_anomalies(scored))
    novel = anomaly.semantic_novelty(log_vectors(t, logs), threshold=THRESHOLD)
    found = anomaly.merge_detectors(spikes, anomaly.novelty_per_bucket(novel, logs, bucket_s=HOUR), ["tenant_id", "service", "bucket"])
    alerts = anomaly.alerts(anomaly.anomaly_description(found, threshold=THRESHOLD))
    verdicts = alerts.select("alert_id", F.when(F.col("severity") == "LOW", "NO: noise").otherwise("YES").alias("verdict"))
    confirmed = anomaly.verdict_filter(alerts, verdicts)
    taken = anomaly.alert_cooldown(confirmed.select("tenant_id", "service", F.col("alert_id").alias("id"), F.col("created_at").alias("ts")),
                                   cooldown_s=COOLDOWN_S, chunk_s=7 * DAY)
    return confirmed.join(taken.select(F.col("id").alias("alert_id")), "alert_id", "left_semi")


def pipeline_incidents(t: Tables) -> DataFrame:
    """Incidents of the detected alerts with the size of their context before and after reduction."""
    incidents = correlate.incident_fields(correlate.correlate(detected(t), window_s=WINDOW_S, chunk_s=7 * DAY), window_s=WINDOW_S)
    lines = context.context_logs_before(incidents, clean_logs(t), minutes=24 * 60)
    stats = context.compression_sizes(lines).select(F.col("set_id").alias("incident_id"), "tenant_id", "log_count", "log_count_out")
    return (incidents.join(stats, ["incident_id", "tenant_id"], "left").fillna(0, ["log_count", "log_count_out"])
            .select("incident_id", "tenant_id", iso(F.col("created_at")).alias("created_at"), "is_cascade", "severity",
                    F.array_join("alert_ids", ",").alias("alert_ids"), F.array_join("affected_services", ",").alias("affected_services"),
                    "log_count", "log_count_out"))


QUERIES = {
    "pipeline_alerts": lambda t: detected(t).select("alert_id", "tenant_id", "service", "anomaly_type", "severity", "created_at_text"),
    "pipeline_incidents": pipeline_incidents,
}

_RANK = "CASE {} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_NAMED = SCORED.replace("logs_v", "clean")
_ALERTS = f"""WITH RECURSIVE {CLEAN},
  {_NAMED},
  anom AS (
    SELECT tenant_id, service, bucket, metric, CASE metric WHEN 'errors' THEN 'error_rate_spike' ELSE 'volume_spike' END AS anomaly_type,
           CASE WHEN z >= 7 THEN 'CRITICAL' WHEN z >= 5 THEN 'HIGH' WHEN z >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
           current_value, round(baseline_mean, 4) AS baseline_mean, round(z, 4) AS z_score
    FROM scored WHERE baseline_points >= 5 AND z > 3),
  spikes AS (SELECT * FROM anom QUALIFY row_number() OVER (PARTITION BY tenant_id, service, bucket ORDER BY metric) = 1),
  vectors AS (
    SELECT l.tenant_id, l.service, l.log_id, l.ts, v.embedding FROM clean l
    JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) v
      ON v.place = l.log_id % (SELECT count(*) FROM embeddings)
    WHERE l.level IN ('ERROR', 'FATAL')),
  {novelty_fold("vectors", "log_id", "ts", THRESHOLD)},
  sem AS (
    SELECT n.tenant_id, n.service, CAST(floor(epoch(n.seen_at) / 3600) AS BIGINT) * 3600 AS bucket, n.sim, 1 - n.sim AS distance,
           {NOVELTY_SEVERITY.format('1 - n.sim')} AS severity, l.message AS nearest_message
    FROM novelty n LEFT JOIN clean l ON l.log_id = n.nearest_id WHERE n.sim < {THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY n.tenant_id, n.service, bucket ORDER BY distance DESC, n.id) = 1),
  merged AS (
    SELECT tenant_id, service, bucket,
           CASE WHEN s.metric IS NULL THEN 'new_error_pattern' WHEN m.sim IS NULL THEN s.anomaly_type ELSE 'combined' END AS kind,
           CASE WHEN s.metric IS NULL THEN m.severity WHEN m.sim IS NULL THEN s.severity
                WHEN {_RANK.format('m.severity')} > {_RANK.format('s.severity')} THEN m.severity ELSE s.severity END AS severity,
           s.z_score, s.current_value, s.baseline_mean, m.sim, m.nearest_message
    FROM spikes s FULL JOIN sem m USING (tenant_id, service, bucket)),
  raised AS (
    SELECT 'al-' || substr(sha256(tenant_id || '|' || service || '|' || bucket), 1, 32) AS alert_id, tenant_id, service, severity, kind,
           make_timestamp(bucket * 1000000) AS created_at,
           CASE kind WHEN 'combined' THEN 'combined' WHEN 'new_error_pattern' THEN 'semantic' ELSE 'statistical' END AS anomaly_type,
           CASE kind
             WHEN 'error_rate_spike' THEN 'Error rate spike: Z-score=' || z_score || ', current=' || current_value
                  || ' errors/bucket vs baseline mean=' || baseline_mean
             WHEN 'volume_spike' THEN 'Log volume spike: Z-score=' || z_score || ', current=' || current_value
                  || ' logs/bucket vs baseline mean=' || baseline_mean
             WHEN 'new_error_pattern' THEN 'Novel error pattern detected: similarity=' || sim || ' below threshold={THRESHOLD}'
                  || CASE WHEN coalesce(nearest_message, '') <> '' THEN '. Nearest known pattern: ''' || nearest_message || '''' ELSE '' END
             ELSE 'Multiple anomaly signals: statistical Z-score=' || z_score || ', semantic similarity=' || sim END AS description
    FROM merged WHERE severity <> 'LOW'),
  waiting AS (
    SELECT *, row_number() OVER (PARTITION BY tenant_id, service ORDER BY created_at, alert_id) AS n FROM raised),
  cooled AS (
    SELECT tenant_id, service, alert_id, n, created_at AS accepted, TRUE AS ok FROM waiting WHERE n = 1
    UNION ALL
    SELECT w.tenant_id, w.service, w.alert_id, w.n,
           CASE WHEN w.created_at - c.accepted >= INTERVAL 4 HOUR THEN w.created_at ELSE c.accepted END,
           w.created_at - c.accepted >= INTERVAL 4 HOUR
    FROM cooled c JOIN waiting w ON w.tenant_id = c.tenant_id AND w.service = c.service AND w.n = c.n + 1),
  alerts AS (SELECT r.* FROM raised r JOIN cooled c ON c.alert_id = r.alert_id AND c.ok)"""
_INCIDENTS = _ALERTS + f""",
  numbered AS (
    SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, alert_id) AS n,
           {{'id': alert_id, 'svc': service, 'at': created_at, 'sev': {_RANK.format('severity')}}} AS a FROM alerts),
  grouped AS (
    SELECT tenant_id, n, a, [a] AS win, FALSE AS fired FROM numbered WHERE n = 1
    UNION ALL
    SELECT tenant_id, n, a, win, len(list_distinct(list_transform(win, lambda x: x.svc))) > 1
    FROM (SELECT c.tenant_id, c.n, c.a, list_append(list_filter(CASE WHEN f.fired THEN [] ELSE f.win END,
                                                    lambda x: x.at >= c.a.at - INTERVAL 6 HOUR), c.a) AS win
          FROM grouped f JOIN numbered c ON c.tenant_id = f.tenant_id AND c.n = f.n + 1)),
  incidents AS (
    SELECT tenant_id, fired AS is_cascade, a.at AS opened, CASE WHEN fired THEN win ELSE [a] END AS win,
           'inc-' || substr(sha256(tenant_id || '|' || a.id || '|' || CASE WHEN fired THEN 'true' ELSE 'false' END), 1, 32) AS incident_id
    FROM grouped),
  lines AS (
    SELECT i.incident_id, l.level, l.message, l.service,
           row_number() OVER (PARTITION BY i.incident_id, l.service, l.level, l.message ORDER BY l.ts, l.log_id) AS nth
    FROM (SELECT incident_id, tenant_id, opened, unnest(list_distinct(list_transform(win, lambda x: x.svc))) AS service FROM incidents) i
    JOIN clean l ON l.tenant_id = i.tenant_id AND l.service = i.service AND l.ts <= i.opened AND l.ts > i.opened - INTERVAL 1 DAY),
  sizes AS (
    SELECT incident_id, count(*) AS log_count, count(*) FILTER (level IN ('ERROR', 'FATAL')
             OR (level <> 'DEBUG' AND message NOT LIKE 'GET /health%' AND message NOT LIKE 'GET /metrics%'
                 AND (level <> 'INFO' OR nth = 1))) AS log_count_out FROM lines GROUP BY 1)"""

ORACLES = {
    "pipeline_alerts": f"""{_ALERTS} SELECT alert_id, tenant_id, service, anomaly_type, severity, ISO(created_at) AS created_at_text
        FROM alerts""",
    "pipeline_incidents": f"""{_INCIDENTS} SELECT i.incident_id, tenant_id, ISO(opened) AS created_at, is_cascade,
        CASE list_max(list_transform(win, lambda x: x.sev)) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END
            AS severity,
        array_to_string(list_transform(win, lambda x: x.id), ',') AS alert_ids,
        array_to_string(list_sort(list_distinct(list_transform(win, lambda x: x.svc))), ',') AS affected_services,
        coalesce(log_count, 0) AS log_count, coalesce(log_count_out, 0) AS log_count_out
      FROM incidents i LEFT JOIN sizes s ON s.incident_id = i.incident_id""",
}
ORACLES = {name: with_views(sql) for name, sql in ORACLES.items()}
