"""Registered queries of groups E to G (context, cache, routing), with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.scoring import cosine
from emberwatch.functions.text import iso
from emberwatch.operators import cache, context, routing
from emberwatch.operators.correlate import incident_severity
from emberwatch.plans.correlate import FOLD
from emberwatch.plans.correlate import incidents as log_incidents
from emberwatch.plans.fixtures import Tables, with_views


def ctx(t: Tables) -> DataFrame:
    """Logs of the day before each incident that the log table's own errors raised."""
    return context.context_logs_before(log_incidents(t), t.logs, minutes=24 * 60)


def reduced(t: Tables) -> DataFrame:
    return context.context_compress_before(log_incidents(t), t.logs, minutes=24 * 60)


def stats(t: Tables) -> DataFrame:
    return context.compression_sizes_before(log_incidents(t), t.logs, minutes=24 * 60)


def looked_up(t: Tables) -> DataFrame:
    q = t.vec.select("tenant_id", F.col("vec_id").alias("query_id"), "embedding", F.col("created_at").alias("asked_at"))
    return cache.cache_lookup(q, t.entries, threshold=0.5)


def severe_incidents(t: Tables) -> DataFrame:
    return incident_severity(t.incidents, t.alerts)


def spend(t: Tables) -> DataFrame:
    return routing.daily_spend(t.evals)


def routed(t: Tables, **options) -> DataFrame:
    """``routing.route``, with the severity carried along the timeline of costs: incidents are not joined to their own spend."""
    spent = routing.spend_so_far(severe_incidents(t), t.evals, keep=("severity",))
    return routing.routed_columns(spent, t.tenants, **options)


def _text_rows(t: Tables) -> DataFrame:
    return t.past.select("incident_id", F.array("service").alias("affected_services"),
                         F.upper("source").alias("severity"), F.col("description").alias("compressed_context"))


def _splits(t: Tables) -> DataFrame:
    return cache.cache_tagged(looked_up(t)).select(
        "tenant_id", F.col("query_id").alias("incident_id"), F.coalesce("rca_result", F.lit("-")).alias("rca_result"), "stream")


def _vector_pairs(t: Tables) -> DataFrame:
    """Each vector with the next one of its series."""
    nxt = t.vec.select("tenant_id", "service", (F.col("vec_id") - 10).alias("vec_id"), F.col("embedding").alias("other"))
    return t.vec.join(nxt, ["tenant_id", "service", "vec_id"])


QUERIES = {
    "context_logs": lambda t: ctx(t).select("set_id", "service", "log_id", "level"),
    "context_text": lambda t: context.context_lines_before(
        log_incidents(t), t.logs, minutes=24 * 60, line=F.sha2(context.context_line(), 256)).withColumnRenamed("line", "line_hash"),
    "context_block": lambda t: context.context_text_before(log_incidents(t), t.logs, minutes=24 * 60, of=lambda text: F.sha2(text, 256))
        .withColumnRenamed("text", "text_hash").select("set_id", "tenant_id", "log_count", "text_hash"),
    "context_compress": lambda t: reduced(t).select("set_id", "log_id"),
    "compression_stats": lambda t: stats(t).withColumn("compression_ratio", F.round("compression_ratio", 6)),
    "requests_by_flag": lambda t: context.requests_by_flag(stats(t)),
    "cosine": lambda t: _vector_pairs(t).select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity")),
    "cache_lookup": lambda t: looked_up(t).select(
        "tenant_id", "query_id", F.coalesce("item_id", F.lit(-1)).alias("item_id"),
        F.coalesce("similarity", F.lit(-1.0)).alias("similarity"), "cache_hit"),
    "cache_query_text": lambda t: cache.cache_query_text(_text_rows(t)).select("incident_id", "query_text"),
    "cache_split": _splits,
    "cache_write": lambda t: cache.cache_write(t.evals, t.rca).withColumn("created_at", iso(F.col("created_at"))),
    "cache_stats": lambda t: cache.cache_stats(looked_up(t), t.entries),
    "daily_spend": lambda t: spend(t).select("tenant_id", F.col("day").cast("string").alias("day"), F.round("spend", 6).alias("spend")),
    "route": lambda t: routed(t).select("incident_id", "tenant_id", "severity", "model_id", "reason", "prompt_variant"),
    "route_low_skip": lambda t: routed(t, low_skip=True).groupBy("tenant_id", "severity", "reason")
        .agg(F.count("*").alias("routed")),
    "ab_variant": lambda t: routed(t).groupBy("prompt_variant", "tenant_id").agg(F.count("*").alias("incidents")),
    "unknown_tenant": lambda t: routing.unknown_tenant(t.incidents, t.tenants.where(F.col("model_tier") == "premium"))
        .select("incident_id", "tenant_id"),
    "routing_counts": lambda t: routing.routing_counts(routed(t)),
    "budget_usage": lambda t: routing.budget_usage(t.tenants, spend(t)).select(
        "tenant_id", F.col("day").cast("string").alias("day"), F.round("used_share", 4).alias("used_share"), "exceeded"),
}

_CTX = FOLD.removeprefix("WITH ") + """,
  ctx AS (
    SELECT s.set_id, s.tenant_id, r.service, r.log_id, r.ts, r.level, r.message,
           (PYISO(ts)) || 'Z [' || r.level || '] ' || r.service || ': ' || r.message AS line
    FROM (SELECT DISTINCT incident_id AS set_id, tenant_id, opened, unnest(list_distinct(list_transform(win, lambda x: x.svc))) AS service
          FROM incs) s
    JOIN logs_v r ON r.tenant_id = s.tenant_id AND r.service = s.service AND r.ts <= s.opened
     AND r.ts > s.opened - INTERVAL 1 DAY)"""
_RED = _CTX + """, sized AS (
    SELECT *, len(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) AS tok FROM ctx),
  totals AS (SELECT set_id, tenant_id, count(*) AS log_count, sum(tok) AS tokens FROM sized GROUP BY ALL),
  ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.set_id, s.service, s.level, s.message ORDER BY s.ts, s.log_id) AS nth
    FROM sized s),
  reduced AS (
    SELECT * FROM ranked WHERE level IN ('ERROR', 'FATAL')
      OR (level <> 'DEBUG' AND message NOT LIKE 'GET /health%' AND message NOT LIKE 'GET /metrics%'
          AND (level <> 'INFO' OR nth = 1))),
  stats AS (
    SELECT t.set_id, t.tenant_id, t.log_count, CAST(t.tokens AS BIGINT) AS tokens,
           CAST(coalesce(r.tok, 0) AS BIGINT) AS tokens_out, coalesce(r.n, 0) AS log_count_out,
           coalesce(r.n, 0) < t.log_count AS was_compressed,
           round(coalesce(r.tok, 0) / t.tokens, 6) AS compression_ratio
    FROM totals t LEFT JOIN (SELECT set_id, sum(tok) AS tok, count(*) AS n FROM reduced GROUP BY 1) r USING (set_id))"""
_LOOK = """pairs AS (
    SELECT q.tenant_id, q.vec_id AS query_id, e.entry_id AS item_id, e.rca_result,
           round(greatest(0, least(1, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))), 6)
               AS similarity
    FROM vec_v q JOIN entries_v e ON e.tenant_id = q.tenant_id AND e.created_at <= q.created_at
         AND e.created_at > q.created_at - INTERVAL 1 DAY AND e.rca_result IS NOT NULL),
  best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) = 1),
  looked AS (
    SELECT q.tenant_id, q.vec_id AS query_id, b.similarity, coalesce(b.similarity >= 0.5, FALSE) AS cache_hit,
           CASE WHEN b.similarity >= 0.5 THEN b.item_id END AS item_id,
           CASE WHEN b.similarity >= 0.5 THEN b.rca_result END AS rca_result
    FROM vec_v q LEFT JOIN best b ON b.query_id = q.vec_id)"""
_SPEND = """spend AS (
    SELECT tenant_id, CAST(evaluated_at AS DATE) AS day, sum(cost_usd) AS spend FROM evals_v GROUP BY ALL)"""
_ROUTE = """sev AS (
    SELECT incident_id, arg_max(a.severity, CASE a.severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)
           AS severity
    FROM (SELECT incident_id, tenant_id, unnest(alert_ids) AS alert_id FROM incidents_v) i
    JOIN alerts_v a ON a.alert_id = i.alert_id AND a.tenant_id = i.tenant_id GROUP BY incident_id),
  spent AS (
    SELECT i.incident_id, sum(CAST(e.cost_usd AS DECIMAL(28, 9))) AS spend
    FROM incidents_v i JOIN evals_v e ON e.tenant_id = i.tenant_id AND e.evaluated_at <= i.created_at
     AND CAST(e.evaluated_at AS DATE) = CAST(i.created_at AS DATE) GROUP BY 1),
  routed AS (
    SELECT i.incident_id, i.tenant_id, v.severity,
           CASE WHEN coalesce(s.spend, 0) >= t.token_budget_usd_daily THEN 'gpt-3.5-turbo'
                WHEN t.model_tier = 'premium' AND v.severity IN ('CRITICAL', 'HIGH') THEN 'gpt-4-turbo'
                ELSE 'gpt-3.5-turbo' END AS model_id,
           CASE WHEN coalesce(s.spend, 0) >= t.token_budget_usd_daily THEN 'budget_exceeded'
                ELSE 'severity_' || v.severity || '_tier_' || t.model_tier END AS reason,
           CASE WHEN CAST('0x' || substr(md5(i.incident_id), 1, 8) AS BIGINT) % 2 = 0 THEN 'v1' ELSE 'v2' END AS prompt_variant
    FROM incidents_v i JOIN tenants_v t ON t.tenant_id = i.tenant_id JOIN sev v ON v.incident_id = i.incident_id
    LEFT JOIN spent s ON s.incident_id = i.incident_id)"""

ORACLES = {
    "context_logs": f"WITH {_CTX} SELECT set_id, service, log_id, level FROM ctx",
    "context_text": f"""WITH {_CTX} SELECT set_id, tenant_id, sha256(line) AS line_hash,
        row_number() OVER (PARTITION BY set_id, tenant_id ORDER BY ts, log_id) AS position FROM ctx""",
    "context_block": f"""WITH {_CTX} SELECT set_id, tenant_id, count(*) AS log_count,
        sha256(string_agg(line, chr(10) ORDER BY ts, log_id)) AS text_hash FROM ctx GROUP BY ALL""",
    "context_compress": f"WITH {_RED} SELECT set_id, log_id FROM reduced",
    "compression_stats": f"WITH {_RED} SELECT * FROM stats",
    "requests_by_flag": f"WITH {_RED} SELECT tenant_id, was_compressed, count(*) AS requests FROM stats GROUP BY ALL",
    "cosine": """SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
        CAST(b.embedding AS DOUBLE[])))), 6) AS similarity
      FROM vec_v a JOIN vec_v b ON b.vec_id = a.vec_id + 10 AND b.tenant_id = a.tenant_id AND b.service = a.service""",
    "cache_lookup": f"""WITH {_LOOK} SELECT tenant_id, query_id, coalesce(item_id, -1) AS item_id,
        coalesce(similarity, -1) AS similarity, cache_hit FROM looked""",
    "cache_query_text": """SELECT incident_id, trim(service || ' ' || upper(source) || ' ' || description, E' \\t\\r\\n')
        AS query_text FROM past_v""",
    "cache_split": f"""WITH {_LOOK} SELECT tenant_id, query_id AS incident_id, coalesce(rca_result, '-') AS rca_result,
        CASE WHEN cache_hit THEN 'hit' ELSE 'miss' END AS stream FROM looked""",
    "cache_write": """SELECT 'entry-' || rca_id AS entry_id, tenant_id, incident_id,
        '{"rca_id":"' || rca_id || '","root_cause":"' || root_cause || '"}' AS rca_result, ISO(evaluated) AS created_at
      FROM (SELECT r.rca_id, r.tenant_id, r.incident_id, r.root_cause, max(e.evaluated_at) AS evaluated
            FROM evals_v e JOIN rca_v r ON r.rca_id = e.rca_id AND NOT r.cache_hit
            WHERE e.faithfulness_score > 0.7 AND e.hallucination_score > 0.7 GROUP BY ALL)""",
    "cache_stats": f"""WITH {_LOOK}, used AS (
        SELECT tenant_id, count(*) FILTER (cache_hit) AS hits, count(*) FILTER (NOT cache_hit) AS misses FROM looked GROUP BY 1)
      SELECT tenant_id, hits, misses, e.n AS keys_stored, round(hits / (hits + misses), 4) AS hit_rate,
             hits * 2000 AS tokens_saved, round(hits * 2e-2, 6) AS cost_saved_usd
      FROM used JOIN (SELECT tenant_id, count(*) FILTER (created_at <= t AND created_at > t - INTERVAL 1 DAY) AS n
        FROM entries_v, (SELECT greatest((SELECT max(created_at) FROM entries_v), (SELECT max(created_at) FROM vec_v)) AS t)
        GROUP BY 1) e USING (tenant_id)""",
    "daily_spend": f"WITH {_SPEND} SELECT tenant_id, CAST(day AS VARCHAR) AS day, round(spend, 6) AS spend FROM spend",
    "route": f"WITH {_ROUTE} SELECT * FROM routed",
    "route_low_skip": f"""WITH {_ROUTE} SELECT tenant_id, severity, reason, count(*) AS routed FROM routed
        WHERE severity <> 'LOW' OR reason = 'budget_exceeded' GROUP BY ALL""",
    "ab_variant": f"WITH {_ROUTE} SELECT prompt_variant, tenant_id, count(*) AS incidents FROM routed GROUP BY ALL",
    "unknown_tenant": """SELECT incident_id, tenant_id FROM incidents_v
        WHERE tenant_id NOT IN (SELECT tenant_id FROM tenants_v WHERE model_tier = 'premium')""",
    "routing_counts": f"WITH {_ROUTE} SELECT model_id, severity, tenant_id, count(*) AS selections FROM routed GROUP BY ALL",
    "budget_usage": f"""WITH {_SPEND} SELECT tenant_id, CAST(day AS VARCHAR) AS day,
        round(spend / token_budget_usd_daily, 4) AS used_share, spend >= token_budget_usd_daily AS exceeded
      FROM spend JOIN tenants_v USING (tenant_id)""",
}
ORACLES = {name: with_views(sql) for name, sql in ORACLES.items()}
