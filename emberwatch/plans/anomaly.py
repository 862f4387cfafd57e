"""Registered queries of group C, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import iso
from emberwatch.operators import anomaly as op
from emberwatch.plans.fixtures import Tables, with_views

HOUR, DAY = 3600, 86400


def _buckets(t: Tables) -> DataFrame:
    return op.bucket_counts(t.logs, bucket_s=HOUR)


def _anomalies(t: Tables, bucket_s: int = HOUR) -> DataFrame:
    scored = op.zscore(op.bucket_counts(t.logs, bucket_s=bucket_s), window_s=DAY, bucket_s=bucket_s)
    return op.zscore_anomalies(scored)


def flagship(t: Tables, bucket_s: int = HOUR) -> DataFrame:
    return op.spike_priority(_anomalies(t, bucket_s)).withColumn("confidence", F.round("confidence", 4))


def error_candidates(t: Tables) -> DataFrame:
    return (t.logs.where(F.col("level").isin(*op.ERROR_LEVELS))
            .select("tenant_id", "service", F.col("log_id").alias("id"), "ts"))


def semantic_results(t: Tables) -> DataFrame:
    """Novelty results per (tenant, service, bucket), derived from the error events' values."""
    per_bucket = (t.events.where(F.col("value") >= 100)
                  .groupBy((F.col("user_id") % 5).cast("string").alias("tenant_id"),
                           F.col("event_type").alias("service"),
                           op.bucket_start(F.col("ts"), HOUR).alias("bucket"))
                  .agg(F.round(F.max("value") / 500.0, 4).alias("distance"),
                       F.min_by("props", "event_id").alias("nearest_message")))
    return (op.novelty_severity(per_bucket.where(F.col("distance") > 0.3))
            .withColumns({"anomaly_type": F.lit("new_error_pattern"),
                          "similarity": F.round(1.0 - F.col("distance"), 4)}))


def merged(t: Tables) -> DataFrame:
    return op.merge_detectors(op.spike_priority(_anomalies(t)), semantic_results(t),
                              ["tenant_id", "service", "bucket"])


def error_vectors(t: Tables) -> DataFrame:
    return t.vec.select("tenant_id", "service", F.col("vec_id").alias("id"),
                        F.col("created_at").alias("ts"), "embedding")


def verdicts(t: Tables) -> DataFrame:
    return (t.alerts.where(F.col("status") == "open")
            .select("alert_id", F.when(F.col("severity") == "LOW", "no").when(F.col("severity") == "HIGH", " yes, likely")
                    .when(F.col("severity") == "MEDIUM", "NO: noise").otherwise("YES").alias("verdict")))


def novel_split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Rows of the two halves of each label's time range: the later half is tested against the earlier."""
    mid = t.vec.groupBy("tenant_id", "service").agg(F.avg("vec_id").alias("mid"))
    both = t.vec.join(mid, ["tenant_id", "service"])
    q = both.where(F.col("vec_id") > F.col("mid")).select("tenant_id", "service", F.col("vec_id").alias("query_id"), "embedding")
    c = both.where(F.col("vec_id") <= F.col("mid")).select("tenant_id", "service", F.col("vec_id").alias("item_id"), "embedding")
    return q, c


def _r4(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in cols})


def zscore_columns(scored: DataFrame) -> DataFrame:
    plain = scored.withColumn("defined", F.col("z_score").isNotNull()).withColumns(
        {c: F.coalesce(c, F.lit(-1.0)) for c in ("z_score", "baseline_mean", "baseline_std")})
    return _r4(plain, "z_score", "baseline_mean", "baseline_std")


QUERIES = {
    "bucket_counts": _buckets,
    "zscore": lambda t: zscore_columns(op.zscore(_buckets(t), window_s=DAY, bucket_s=HOUR)),
    "zscore_anomalies": lambda t: _r4(_anomalies(t), "confidence"),
    "spike_priority": flagship,
    "zscore_per_event": lambda t: op.zscore_per_event(t.logs, window_s=DAY, bucket_s=HOUR, slice_s=60)
        .withColumn("ts", iso(F.col("ts"))),
    "semantic_novelty": lambda t: op.semantic_novelty(error_vectors(t), threshold=0.3)
        .select("tenant_id", "service", "id", F.round("similarity", 6).alias("similarity"), "nearest_id", "severity"),
    "novel_vs_baseline": lambda t: op.novel_vs_baseline(*novel_split(t), threshold=0.5)
        .select("tenant_id", "service", "query_id", "item_id", "similarity", F.round("distance", 6).alias("distance")),
    "novelty_severity": lambda t: semantic_results(t).select(
        "tenant_id", "service", "bucket", "distance", "severity", "confidence"),
    "evict_oldest": lambda t: op.evict_oldest(
        t.logs.select("tenant_id", F.col("log_id").alias("id"), "ts"), max_size=1500, batch=300)
        .select("tenant_id", "id"),
    "merge_detectors": lambda t: _r4(merged(t), "confidence").select(
        "tenant_id", "service", "bucket", "anomaly_type", "severity", "confidence"),
    "anomaly_description": lambda t: op.anomaly_description(merged(t)).select(
        "tenant_id", "service", "bucket", "wire_type", "description"),
    "alert_cooldown": lambda t: op.alert_cooldown(error_candidates(t), cooldown_s=4 * HOUR)
        .select("tenant_id", "service", "id", iso(F.col("ts")).alias("ts")),
    "recent_errors": lambda t: op.recent_errors(t.logs, k=10).select(
        "tenant_id", "service", F.col("_rank").alias("position"), "log_id", "message"),
    "verdict_filter": lambda t: op.verdict_filter(t.alerts, verdicts(t)).select("alert_id", "tenant_id", "severity"),
    "alerts": lambda t: op.alerts(op.anomaly_description(merged(t))).select(
        "alert_id", "tenant_id", "service", "anomaly_type", "severity", "confidence", "created_at_text", "status"),
}

_COUNTS = """buckets AS (
    SELECT tenant_id, service, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS bucket,
           count(*) FILTER (level IN ('ERROR', 'FATAL')) AS errors, count(*) AS volume
    FROM logs_v GROUP BY ALL)"""
SCORED = _COUNTS + """, series AS (
    SELECT tenant_id, service, bucket, 'errors' AS metric, errors AS x FROM buckets WHERE errors > 0
    UNION ALL SELECT tenant_id, service, bucket, 'volume', volume FROM buckets),
  base AS (
    SELECT tenant_id, service, bucket, metric, CAST(x AS DOUBLE) AS current_value,
           avg(x) OVER w AS baseline_mean, stddev_pop(x) OVER w AS baseline_std, count(x) OVER w AS baseline_points
    FROM series
    WINDOW w AS (PARTITION BY tenant_id, service, metric ORDER BY bucket
                 RANGE BETWEEN 172800 PRECEDING AND 3600 PRECEDING)),
  scored AS (SELECT *, CASE WHEN baseline_std > 0 THEN (current_value - baseline_mean) / baseline_std END AS z FROM base)"""
_ANOM = SCORED + """, anom AS (
    SELECT tenant_id, service, bucket, metric,
           CASE metric WHEN 'errors' THEN 'error_rate_spike' ELSE 'volume_spike' END AS anomaly_type,
           CASE WHEN z >= 7 THEN 'CRITICAL' WHEN z >= 5 THEN 'HIGH' WHEN z >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
           round(least(1e0, (z - 3e0) / 3e0), 4) AS confidence, current_value, baseline_points,
           round(baseline_mean, 4) AS baseline_mean, round(z, 4) AS z_score, 3e0 AS threshold
    FROM scored WHERE baseline_points >= 5 AND z > 3),
  spikes AS (SELECT * FROM anom QUALIFY row_number() OVER (PARTITION BY tenant_id, service, bucket ORDER BY metric) = 1)"""
NOVELTY_SEVERITY = "CASE WHEN {0} > 0.7 THEN 'CRITICAL' WHEN {0} > 0.5 THEN 'HIGH' WHEN {0} > 0.3 THEN 'MEDIUM' ELSE 'LOW' END"


def novelty_fold(source: str, id_col: str, time_col: str, threshold: float) -> str:
    """The rule one row at a time: stored rows of a series as a list; the nearest is the most similar, then smallest id."""
    return f"""arrivals AS (
        SELECT tenant_id, service, CAST({id_col} AS BIGINT) AS id, {time_col} AS seen_at, CAST(embedding AS DOUBLE[]) AS e,
               row_number() OVER (PARTITION BY tenant_id, service ORDER BY {time_col}, {id_col}) AS n FROM {source}),
      novelty AS (
        SELECT tenant_id, service, n, id, seen_at, CAST(NULL AS DOUBLE) AS sim, CAST(NULL AS BIGINT) AS nearest_id,
               [{{'id': id, 'e': e}}] AS stored FROM arrivals WHERE n = 1
        UNION ALL
        SELECT tenant_id, service, n, id, seen_at, best.s, -best.i,
               CASE WHEN best.s < {threshold} THEN list_append(stored, {{'id': id, 'e': e}}) ELSE stored END
        FROM (SELECT o.tenant_id, o.service, o.n, o.id, o.seen_at, o.e, f.stored,
                     list_max(list_transform(f.stored, lambda x: {{'s': round(list_cosine_similarity(x.e, o.e), 9), 'i': -x.id}})) AS best
              FROM novelty f JOIN arrivals o ON o.tenant_id = f.tenant_id AND o.service = f.service AND o.n = f.n + 1))"""


_SEM = """, sem0 AS (
    SELECT CAST(user_id % 5 AS VARCHAR) AS tenant_id, event_type AS service,
           CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS bucket,
           round(max(value) / 5e2, 4) AS distance, arg_min(props, event_id) AS nearest_message
    FROM events WHERE value >= 100 GROUP BY ALL),
  sem AS (
    SELECT *, round(1 - distance, 4) AS similarity, distance AS confidence,
           CASE WHEN distance > 0.7 THEN 'CRITICAL' WHEN distance > 0.5 THEN 'HIGH'
                WHEN distance > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS severity
    FROM sem0 WHERE distance > 0.3)"""
_RANK = "CASE {} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_MERGED = _ANOM + _SEM + f""", merged AS (
    SELECT tenant_id, service, bucket,
           CASE WHEN s.metric IS NULL THEN 'new_error_pattern' WHEN m.distance IS NULL THEN s.anomaly_type
                ELSE 'combined' END AS anomaly_type,
           CASE WHEN s.metric IS NULL THEN m.severity WHEN m.distance IS NULL THEN s.severity
                WHEN {_RANK.format('m.severity')} > {_RANK.format('s.severity')} THEN m.severity
                ELSE s.severity END AS severity,
           round(greatest(s.confidence, m.confidence), 4) AS confidence,
           s.z_score, s.current_value, s.baseline_mean, m.similarity, m.nearest_message
    FROM spikes s FULL JOIN sem m USING (tenant_id, service, bucket)),
  described AS (
    SELECT *, CASE anomaly_type WHEN 'combined' THEN 'combined' WHEN 'new_error_pattern' THEN 'semantic'
                   ELSE 'statistical' END AS wire_type,
           CASE anomaly_type
             WHEN 'error_rate_spike' THEN 'Error rate spike: Z-score=' || z_score || ', current=' || current_value
                  || ' errors/bucket vs baseline mean=' || baseline_mean
             WHEN 'volume_spike' THEN 'Log volume spike: Z-score=' || z_score || ', current=' || current_value
                  || ' logs/bucket vs baseline mean=' || baseline_mean
             WHEN 'new_error_pattern' THEN 'Novel error pattern detected: similarity=' || similarity
                  || ' below threshold=0.7. Nearest known pattern: ''' || nearest_message || ''''
             ELSE 'Multiple anomaly signals: statistical Z-score=' || z_score || ', semantic similarity=' || similarity
           END AS description
    FROM merged)"""

ORACLES = {
    "bucket_counts": f"WITH {_COUNTS} SELECT * FROM buckets",
    "zscore": f"""WITH {SCORED} SELECT tenant_id, service, bucket, metric, current_value, baseline_points,
        round(coalesce(baseline_mean, -1), 4) AS baseline_mean, round(coalesce(baseline_std, -1), 4) AS baseline_std,
        z IS NOT NULL AS defined, round(coalesce(z, -1), 4) AS z_score FROM scored""",
    "zscore_anomalies": f"WITH {_ANOM} SELECT * FROM anom",
    "spike_priority": f"WITH {_ANOM} SELECT * FROM spikes",
    "zscore_per_event": f"""WITH {SCORED}, counted AS (
        SELECT tenant_id, service, log_id, ts, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS bucket, level,
               count(*) OVER w AS volume,
               count(*) FILTER (level IN ('ERROR', 'FATAL')) OVER w AS errors
        FROM logs_v WINDOW w AS (PARTITION BY tenant_id, service, CAST(floor(epoch(ts) / 3600) AS BIGINT)
                                 ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING)),
      per_event AS (
        SELECT c.tenant_id, c.service, c.bucket, s.metric, c.log_id, c.ts,
               CASE s.metric WHEN 'errors' THEN c.errors ELSE c.volume END AS n, s.baseline_mean, s.baseline_std
        FROM counted c JOIN scored s USING (tenant_id, service, bucket)
        WHERE s.baseline_points >= 5 AND s.baseline_std > 0)
      SELECT tenant_id, service, bucket, metric, log_id, ISO(ts) AS ts, n AS count_at_crossing,
             round((n - baseline_mean) / baseline_std, 4) AS z_score
      FROM per_event WHERE (n - baseline_mean) / baseline_std > 3
      QUALIFY row_number() OVER (PARTITION BY tenant_id, service, bucket, metric ORDER BY ts, log_id) = 1""",
    "semantic_novelty": f"""WITH RECURSIVE {novelty_fold("vec_v", "vec_id", "created_at", 0.3)}
      SELECT tenant_id, service, id, round(sim, 6) AS similarity, nearest_id, {NOVELTY_SEVERITY.format('1 - sim')} AS severity
      FROM novelty WHERE sim < 0.3""",
    "novel_vs_baseline": """WITH halves AS (
        SELECT *, CAST(embedding AS DOUBLE[]) AS e, avg(vec_id) OVER (PARTITION BY tenant_id, service) AS mid FROM vec_v),
      best AS (
        SELECT q.tenant_id, q.service, q.vec_id AS query_id, c.vec_id AS item_id,
               round(list_cosine_similarity(q.e, c.e), 6) AS similarity
        FROM halves q JOIN halves c ON q.tenant_id = c.tenant_id AND q.service = c.service
        WHERE q.vec_id > q.mid AND c.vec_id <= c.mid
        QUALIFY row_number() OVER (PARTITION BY q.tenant_id, q.service, q.vec_id
                                   ORDER BY similarity DESC, c.vec_id) = 1)
      SELECT *, round(1 - similarity, 6) AS distance FROM best WHERE similarity < 0.5""",
    "novelty_severity": "WITH " + _SEM[2:] + " SELECT tenant_id, service, bucket, distance, severity, confidence FROM sem",
    "evict_oldest": """WITH RECURSIVE ranked AS (
        SELECT tenant_id, log_id AS id, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, log_id) AS pos FROM logs_v),
      inserts AS (
        SELECT tenant_id, 0 AS pos, 0 AS stored, 0 AS gone FROM ranked WHERE pos = 1
        UNION ALL
        SELECT i.tenant_id, r.pos, CASE WHEN stored + 1 > 1500 THEN stored + 1 - 300 ELSE stored + 1 END,
               CASE WHEN stored + 1 > 1500 THEN gone + 300 ELSE gone END
        FROM inserts i JOIN ranked r ON r.tenant_id = i.tenant_id AND r.pos = i.pos + 1)
      SELECT r.tenant_id, r.id FROM ranked r
      WHERE r.pos > (SELECT max(gone) FROM inserts i WHERE i.tenant_id = r.tenant_id)""",
    "merge_detectors": f"WITH {_MERGED} SELECT tenant_id, service, bucket, anomaly_type, severity, confidence FROM merged",
    "anomaly_description": f"WITH {_MERGED} SELECT tenant_id, service, bucket, wire_type, description FROM described",
    "alert_cooldown": """WITH RECURSIVE cand AS (
        SELECT tenant_id, service, log_id AS id, ts,
               row_number() OVER (PARTITION BY tenant_id, service ORDER BY ts, log_id) AS n
        FROM logs_v WHERE level IN ('ERROR', 'FATAL')),
      fold AS (
        SELECT tenant_id, service, id, ts, n, ts AS accepted, TRUE AS ok FROM cand WHERE n = 1
        UNION ALL
        SELECT c.tenant_id, c.service, c.id, c.ts, c.n,
               CASE WHEN c.ts - f.accepted >= INTERVAL 4 HOUR THEN c.ts ELSE f.accepted END,
               c.ts - f.accepted >= INTERVAL 4 HOUR
        FROM fold f JOIN cand c ON c.tenant_id = f.tenant_id AND c.service = f.service AND c.n = f.n + 1)
      SELECT tenant_id, service, id, ISO(ts) AS ts FROM fold WHERE ok""",
    "recent_errors": """SELECT tenant_id, service, row_number() OVER w AS position, log_id, message
      FROM logs_v WHERE level IN ('ERROR', 'FATAL')
      WINDOW w AS (PARTITION BY tenant_id, service ORDER BY ts DESC, log_id DESC)
      QUALIFY row_number() OVER w <= 10""",
    "verdict_filter": """SELECT alert_id, tenant_id, severity FROM alerts_v
      WHERE status <> 'open' OR severity IN ('HIGH', 'CRITICAL')""",
    "alerts": f"""WITH {_MERGED}
      SELECT 'al-' || substr(sha256(tenant_id || '|' || service || '|' || bucket), 1, 32) AS alert_id, tenant_id, service,
             wire_type AS anomaly_type, severity, confidence,
             strftime(make_timestamp(bucket * 1000000), '%Y-%m-%dT%H:%M:%S.%f') AS created_at_text,
             'open' AS status FROM described""",
}
ORACLES = {name: with_views(sql) for name, sql in ORACLES.items()}
