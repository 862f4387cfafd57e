"""Registered queries of group D, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import iso
from emberwatch.operators import correlate as op
from emberwatch.plans.fixtures import Tables, with_views

WINDOW_S = 3600


def log_alerts(t: Tables) -> DataFrame:
    """Every error log as an alert; severity by level."""
    return (t.logs.where(F.col("level").isin("ERROR", "FATAL"))
            .select("tenant_id", F.format_string("a-%012d", "log_id").alias("alert_id"), "service",
                    F.when(F.col("level") == "FATAL", "CRITICAL").when(F.col("service") == "error", "HIGH")
                     .when(F.col("service") == "view", "LOW").otherwise("MEDIUM").alias("severity"),
                    F.col("ts").alias("created_at")))


def members(t: Tables) -> DataFrame:
    return op.correlate(log_alerts(t), window_s=WINDOW_S, chunk_s=86400)


def incidents(t: Tables) -> DataFrame:
    return op.incident_fields(members(t), window_s=WINDOW_S)


def _flat(df: DataFrame) -> DataFrame:
    return df.select("incident_id", "tenant_id", iso(F.col("created_at")).alias("created_at"), "is_cascade",
                     F.array_join("alert_ids", ",").alias("alert_ids"),
                     F.array_join("affected_services", ",").alias("affected_services"),
                     "severity", "correlation_window_ms")


QUERIES = {
    "correlate": lambda t: members(t).select("incident_id", "tenant_id", "is_cascade", "alert_id"),
    "incident_fields": lambda t: _flat(incidents(t)),
    "incident_counts": lambda t: op.incident_counts(incidents(t)),
    "incident_severity": lambda t: op.incident_severity(t.incidents, t.alerts)
        .select("incident_id", "tenant_id", "severity"),
}

# The rule itself, one alert at a time: the state is the list of alerts now in the window.
FOLD = """WITH RECURSIVE log_alerts AS (
    SELECT tenant_id, 'a-' || lpad(CAST(log_id AS VARCHAR), 12, '0') AS alert_id, service, ts AS created_at,
           CASE WHEN level = 'FATAL' THEN 4 WHEN service = 'error' THEN 3 WHEN service = 'view' THEN 1 ELSE 2 END AS sev,
           row_number() OVER (PARTITION BY tenant_id ORDER BY ts, log_id) AS n
    FROM logs_v WHERE level IN ('ERROR', 'FATAL')),
  numbered AS (
    SELECT tenant_id, n, {'id': alert_id, 'svc': service, 'at': created_at, 'sev': sev} AS a FROM log_alerts),
  fold AS (
    SELECT tenant_id, n, a, [a] AS win, FALSE AS fired FROM numbered WHERE n = 1
    UNION ALL
    SELECT tenant_id, n, a, win, len(list_distinct(list_transform(win, lambda x: x.svc))) > 1
    FROM (SELECT c.tenant_id, c.n, c.a,
                 list_append(list_filter(CASE WHEN f.fired THEN [] ELSE f.win END,
                                         lambda x: x.at >= c.a.at - INTERVAL 1 HOUR), c.a) AS win
          FROM fold f JOIN numbered c ON c.tenant_id = f.tenant_id AND c.n = f.n + 1)),
  incs AS (
    SELECT tenant_id, fired AS is_cascade, a.at AS opened, CASE WHEN fired THEN win ELSE [a] END AS win,
           'inc-' || substr(sha256(tenant_id || '|' || a.id || '|' || CASE WHEN fired THEN 'true' ELSE 'false' END), 1, 32)
               AS incident_id
    FROM fold)"""

ORACLES = {
    "correlate": FOLD + """
      SELECT incident_id, tenant_id, is_cascade, unnest(list_transform(win, lambda x: x.id)) AS alert_id FROM incs""",
    "incident_fields": FOLD + """
      SELECT incident_id, tenant_id, ISO(opened) AS created_at, is_cascade,
             array_to_string(list_transform(win, lambda x: x.id), ',') AS alert_ids,
             array_to_string(list_sort(list_distinct(list_transform(win, lambda x: x.svc))), ',') AS affected_services,
             CASE list_max(list_transform(win, lambda x: x.sev)) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH'
                  WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
             CASE WHEN is_cascade THEN 3600000 ELSE 0 END AS correlation_window_ms FROM incs""",
    "incident_counts": FOLD + """
      SELECT tenant_id, count(*) FILTER (NOT is_cascade) AS single_incidents,
             count(*) FILTER (is_cascade) AS cascade_incidents FROM incs GROUP BY tenant_id""",
    "incident_severity": """
      WITH ranked AS (
        SELECT i.incident_id, i.tenant_id, a.severity,
               CASE a.severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS r
        FROM (SELECT incident_id, tenant_id, unnest(alert_ids) AS alert_id FROM incidents_v) i
        JOIN alerts_v a ON a.alert_id = i.alert_id AND a.tenant_id = i.tenant_id)
      SELECT i.incident_id, i.tenant_id, coalesce(m.severity, 'HIGH') AS severity
      FROM incidents_v i LEFT JOIN (SELECT incident_id, arg_max(severity, r) AS severity FROM ranked GROUP BY 1) m
        ON m.incident_id = i.incident_id""",
}
ORACLES = {name: with_views(sql) for name, sql in ORACLES.items()}
