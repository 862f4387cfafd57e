"""Registered queries of groups I and J (investigation, evaluation), with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import iso
from emberwatch.operators import evaluate as ev
from emberwatch.operators import investigate as op
from emberwatch.operators.correlate import incident_severity
from emberwatch.plans.correlate import FOLD
from emberwatch.plans.correlate import incidents as log_incidents
from emberwatch.plans.fixtures import Tables, with_views

WEEK = 7 * 24 * 60


def json_steps(t: Tables) -> DataFrame:
    step = F.struct(F.col("step_number").cast("int").alias("step_number"), "action", "observation")
    return t.steps.select("rca_id", "tenant_id", F.to_json(F.array(step)).alias("reasoning_steps"))


def timeline(t: Tables) -> DataFrame:
    return op.error_timeline(log_incidents(t), t.logs, minutes=24 * 60)


def results(t: Tables) -> DataFrame:
    return ev.eval_input(t.rca, incident_severity(t.incidents, t.alerts))


def near_results(t: Tables) -> DataFrame:
    """Results moved into the time of the logs (the tables' own dates lie years apart): the first log plus
    half hours by the tokens read."""
    first = t.logs.select(F.min(F.unix_micros("ts"))).scalar()
    return results(t).select("rca_id", "tenant_id", "service", F.timestamp_micros(
        first + (F.col("input_tokens") % 600) * F.lit(1_800_000_000)).alias("created_at"))


def truth(t: Tables) -> DataFrame:
    return ev.ground_truth_lookup(results(t), t.alerts)


def proxy(t: Tables) -> DataFrame:
    return ev.similarity_proxy(t.qvec, t.kbvec, t.past, threshold=0.3)


def modes(t: Tables) -> DataFrame:
    judged = ev.judge_parse(t.judged, "judged", default=None)
    scored = truth(t).join(judged, ["rca_id", "tenant_id"]).select("rca_id", "score")
    similar = judged.where(F.col("tenant_id") == "1").select("rca_id", "score")
    return ev.eval_mode(results(t).select("rca_id", "tenant_id"), scored, similar, ev.judge_parse(t.judged, "judged"))


def _validated(t: Tables) -> DataFrame:
    return op.result_tagged(t.outputs, min_conf=0.5).select(
        "rca_id", F.coalesce("failure_reason", F.lit("-")).alias("failure_reason"))


QUERIES = {
    "query_logs": lambda t: op.query_logs(t.logs, level="error", minutes=WEEK, limit=50).select("tenant_id", "service", "position", "log_id"),
    "service_dependencies": lambda t: op.service_dependencies(t.logs, minutes=WEEK, k=10),
    "error_timeline": lambda t: timeline(t).select("incident_id", "tenant_id", "position", "service", "log_id"),
    "first_failing_service": lambda t: op.first_failing_before(log_incidents(t), t.logs, minutes=24 * 60),
    "steps_explode": lambda t: op.steps_explode(json_steps(t)).select(
        "rca_id", F.col("step_number").cast("long").alias("step_number"), F.coalesce("action", F.lit("-")).alias("action"),
        F.sha2(F.coalesce("observation", F.lit("")), 256).alias("observation_hash")),
    "tool_calls": lambda t: op.tool_calls(op.steps_explode(json_steps(t))),
    "observations_text": lambda t: op.observations(t.steps),
    "observations_block": lambda t: op.observations_text(t.steps, max_chars=2000).select(
        "rca_id", "tenant_id", F.sha2("observations", 256).alias("text_hash")),
    "result_validate": _validated,
    "step_stream_filter": lambda t: op.step_stream_filter(t.steps).select("rca_id", "step_number", "step_type"),
    "eval_input": lambda t: results(t).select("rca_id", "incident_id", "tenant_id", "service", "severity", "is_cascade"),
    "ground_truth_lookup": truth,
    "similarity_proxy": lambda t: proxy(t).select("tenant_id", "query_id", "item_id", "similarity", "past_root_cause"),
    "eval_mode": modes,
    "evidence_logs": lambda t: ev.evidence_lines(near_results(t), t.logs, hours=24, line=F.sha2(ev.evidence_line(), 256)).select(
        "rca_id", "log_id", F.col("line").alias("line_hash")),
    "evidence_block": lambda t: ev.evidence_logs(near_results(t), t.logs, k=20, hours=24, max_chars=3000).select(
        "rca_id", F.sha2("evidence", 256).alias("text_hash")),
    "judge_parse": lambda t: ev.judge_parse(t.judged, "judged").select("rca_id", "score"),
    "cost": lambda t: ev.cost(t.rca).select("rca_id", F.round("cost_usd", 6).alias("cost_usd")),
    "passed": lambda t: ev.passed(t.evals).select("eval_id", F.coalesce(F.col("passed").cast("string"), F.lit("null")).alias("passed")),
    "learn": lambda t: ev.learn(t.evals, results(t)).select(
        "incident_id", "tenant_id", "service", "description", "root_cause", "resolution",
        F.array_join("tags", ",").alias("tags"), "source", iso(F.col("created_at")).alias("created_at")),
    "notify_candidates": lambda t: ev.notify_candidates(t.evals, results(t)),
    "eval_summary": lambda t: ev.eval_summary(t.evals, t.tenants),
    "ab_faithfulness": lambda t: ev.ab_faithfulness(t.evals),
    "running_pass_rate": lambda t: ev.running_pass_rate(t.evals).select(
        "tenant_id", "eval_id", "passed", "seen", "pass_rate"),
}

_SINCE = "ts > (SELECT max(ts) FROM logs_v) - INTERVAL 7 DAY"
_TIMELINE = FOLD + """,
  timeline AS (
    SELECT s.incident_id, s.tenant_id, e.service, e.log_id,
           row_number() OVER (PARTITION BY s.incident_id ORDER BY e.ts, e.log_id) AS position
    FROM (SELECT DISTINCT incident_id, tenant_id, opened, unnest(list_distinct(list_transform(win, lambda x: x.svc))) AS service
          FROM incs) s
    JOIN logs_v e ON e.tenant_id = s.tenant_id AND e.service = s.service AND e.level IN ('ERROR', 'FATAL')
     AND e.ts <= s.opened AND e.ts > s.opened - INTERVAL 1 DAY)"""
_RANK = "CASE {0} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
_RESULTS = f"""linked AS (
    SELECT i.incident_id, a.alert_id, a.severity, a.ground_truth, a.created_at
    FROM (SELECT incident_id, tenant_id, unnest(alert_ids) AS alert_id FROM incidents_v) i
    JOIN alerts_v a ON a.alert_id = i.alert_id AND a.tenant_id = i.tenant_id),
  results AS (
    SELECT r.*, i.affected_services, i.is_cascade, i.affected_services[1] AS service, s.severity
    FROM rca_v r JOIN incidents_v i ON i.incident_id = r.incident_id AND i.tenant_id = r.tenant_id
    JOIN (SELECT incident_id, arg_max(severity, {_RANK.format('severity')}) AS severity FROM linked GROUP BY 1) s
      ON s.incident_id = r.incident_id
    WHERE r.status = 'success' AND NOT r.cache_hit),
  truth AS (
    SELECT r.rca_id, r.tenant_id, arg_min(l.ground_truth, ISO(l_at) || l.alert_id) AS ground_truth
    FROM results r JOIN (SELECT *, created_at AS l_at FROM linked) l ON l.incident_id = r.incident_id
    WHERE l.ground_truth IS NOT NULL GROUP BY ALL)"""
_SCORE = "TRY_CAST(CASE WHEN json_valid(judged) THEN json_extract_string(judged, '$.score') END AS DOUBLE)"
_COS = "round(list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])), 6)"
_PASS = "(faithfulness_score > 0.7 AND hallucination_score > 0.7)"

ORACLES = {
    "query_logs": f"""SELECT tenant_id, service, row_number() OVER (PARTITION BY tenant_id, service ORDER BY ts, log_id) AS position,
        log_id FROM logs_v WHERE level = 'ERROR' AND {_SINCE} QUALIFY position <= 50""",
    "service_dependencies": f"""WITH c AS (
        SELECT l1.tenant_id, l1.service, l2.service AS depends_on, count(DISTINCT l1.trace_id) AS shared_traces
        FROM (SELECT * FROM logs_v WHERE {_SINCE}) l1 JOIN logs_v l2
          ON l1.trace_id = l2.trace_id AND l1.tenant_id = l2.tenant_id AND l1.service <> l2.service
        GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY tenant_id, service ORDER BY shared_traces DESC, depends_on) AS position
      FROM c QUALIFY position <= 10""",
    "error_timeline": f"{_TIMELINE} SELECT incident_id, tenant_id, position, service, log_id FROM timeline",
    "first_failing_service": f"{_TIMELINE} SELECT incident_id, tenant_id, service AS first_failing_service FROM timeline WHERE position = 1",
    "steps_explode": """SELECT rca_id, step_number, coalesce(action, '-') AS action,
        sha256(coalesce(observation, '')) AS observation_hash FROM steps_v""",
    "tool_calls": "SELECT tenant_id, action AS tool, count(*) AS calls FROM steps_v WHERE action IS NOT NULL GROUP BY ALL",
    "observations_text": "SELECT rca_id, tenant_id, step_number, coalesce(observation, '') AS observation FROM steps_v",
    "observations_block": """SELECT rca_id, tenant_id, sha256(substr(string_agg(coalesce(observation, ''), ' ' ORDER BY step_number), 1, 2000)) AS text_hash
      FROM steps_v GROUP BY ALL""",
    "result_validate": """WITH j AS (
        SELECT *, json_valid(output) AS good, CASE WHEN json_valid(output) THEN output END AS o FROM outputs_v)
      SELECT rca_id, CASE WHEN error = 'rate_limit' THEN 'api_error' WHEN error IS NOT NULL THEN 'unexpected_error'
        WHEN NOT good OR length(json_extract_string(o, '$.root_cause')) < 20
             OR CAST(json_extract_string(o, '$.confidence') AS DOUBLE) > 1 OR json_array_length(o, '$.recommendations') < 1
        THEN 'schema_validation_error'
        WHEN CAST(json_extract_string(o, '$.confidence') AS DOUBLE) < 0.5 THEN 'low_confidence' ELSE '-' END AS failure_reason
      FROM j""",
    "step_stream_filter": """SELECT rca_id, step_number, step_type FROM steps_v s
      WHERE step_number <= coalesce((SELECT min(step_number) FROM steps_v x WHERE x.rca_id = s.rca_id AND x.step_type = 'complete'),
                                    1000000)""",
    "eval_input": f"WITH {_RESULTS} SELECT rca_id, incident_id, tenant_id, service, severity, is_cascade FROM results",
    "ground_truth_lookup": f"WITH {_RESULTS} SELECT * FROM truth",
    "similarity_proxy": f"""WITH near AS (
        SELECT q.tenant_id, q.query_id, v.item_id, {_COS.format('q.embedding', 'v.embedding')} AS similarity
        FROM qvec_v q JOIN kbvec_v v ON v.tenant_id = q.tenant_id
        QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY similarity DESC, v.item_id) = 1)
      SELECT n.*, p.root_cause AS past_root_cause FROM near n JOIN past_v p ON p.incident_id = n.item_id AND p.tenant_id = n.tenant_id
      WHERE n.similarity >= 0.3""",
    "eval_mode": f"""WITH {_RESULTS}, s AS (SELECT rca_id, {_SCORE} AS score FROM judged_v)
      SELECT r.rca_id, r.tenant_id,
             CASE WHEN t.rca_id IS NOT NULL AND s.score IS NOT NULL THEN 'ground_truth'
                  WHEN r.tenant_id = '1' AND s.score IS NOT NULL THEN 'similarity' ELSE 'heuristic' END AS eval_mode,
             coalesce(s.score, 0.75) AS faithfulness_score
      FROM results r LEFT JOIN truth t ON t.rca_id = r.rca_id LEFT JOIN s ON s.rca_id = r.rca_id""",
    "evidence_logs": f"""WITH {_RESULTS}, near AS (
        SELECT r.rca_id, r.tenant_id, r.service,
               make_timestamp((SELECT min(epoch_us(ts)) FROM logs_v) + CAST(l.n AS BIGINT) * 1800000000) AS at
        FROM results r JOIN (SELECT rca_id, input_tokens % 600 AS n FROM rca_v) l ON l.rca_id = r.rca_id)
      SELECT n.rca_id, l.log_id, sha256((PYISO(ts)) || 'Z [' || level || ']: ' || message) AS line_hash
      FROM near n JOIN logs_v l ON l.tenant_id = n.tenant_id AND l.service = n.service
       AND l.ts <= n.at AND l.ts > n.at - INTERVAL 24 HOUR WHERE level IN ('ERROR', 'FATAL')""",
    "evidence_block": f"""WITH {_RESULTS}, near AS (
        SELECT r.rca_id, r.tenant_id, r.service,
               make_timestamp((SELECT min(epoch_us(ts)) FROM logs_v) + CAST(l.n AS BIGINT) * 1800000000) AS at
        FROM results r JOIN (SELECT rca_id, input_tokens % 600 AS n FROM rca_v) l ON l.rca_id = r.rca_id),
      lines AS (
        SELECT n.rca_id, (PYISO(ts)) || 'Z [' || level || ']: ' || message AS line,
               row_number() OVER (PARTITION BY n.rca_id ORDER BY ts DESC, log_id DESC) AS nth
        FROM near n JOIN logs_v l ON l.tenant_id = n.tenant_id AND l.service = n.service
         AND l.ts <= n.at AND l.ts > n.at - INTERVAL 24 HOUR WHERE level IN ('ERROR', 'FATAL'))
      SELECT n.rca_id, sha256(coalesce(substr(e.text, 1, 3000), 'NO_LOGS_TEXT')) AS text_hash
      FROM near n LEFT JOIN (SELECT rca_id, string_agg(line, chr(10) ORDER BY nth) AS text FROM lines WHERE nth <= 20 GROUP BY 1) e
        ON e.rca_id = n.rca_id""".replace("NO_LOGS_TEXT", ev.NO_LOGS.replace("'", "''")),
    "judge_parse": f"SELECT rca_id, coalesce({_SCORE}, 0.75) AS score FROM judged_v",
    "cost": """SELECT rca_id, round((input_tokens * CASE WHEN model_used IN ('gpt-4', 'gpt-4-turbo') THEN 1e-2 ELSE 1e-3 END
        + output_tokens * CASE WHEN model_used IN ('gpt-4', 'gpt-4-turbo') THEN 3e-2 ELSE 2e-3 END) / 1e3, 6) AS cost_usd FROM rca_v""",
    "passed": f"SELECT eval_id, coalesce(CAST({_PASS} AS VARCHAR), 'null') AS passed FROM evals_v",
    "learn": f"""WITH {_RESULTS} SELECT 'learned-' || e.eval_id AS incident_id, e.tenant_id, r.service,
        'Services: ' || array_to_string(r.affected_services, ', ') || '. Cascade: '
            || CASE WHEN r.is_cascade THEN 'True' ELSE 'False' END || '.' AS description,
        r.root_cause, array_to_string(r.recommendations, '; ') AS resolution, 'rca_id:' || r.rca_id AS tags,
        'auto_learned' AS source, ISO(evaluated_at) AS created_at
      FROM evals_v e JOIN results r ON r.rca_id = e.rca_id WHERE e.faithfulness_score > 0.8 AND e.hallucination_score > 0.7""",
    "notify_candidates": f"""WITH {_RESULTS} SELECT e.eval_id, e.rca_id, e.tenant_id, e.faithfulness_score,
        array_to_string(r.affected_services, ', ') AS services,
        r.root_cause
      FROM evals_v e JOIN results r ON r.rca_id = e.rca_id WHERE r.severity = 'CRITICAL' AND e.faithfulness_score > 0.7""",
    "eval_summary": f"""WITH recent AS (SELECT * FROM evals_v)
      SELECT tenant_id, count(*) AS total_evaluations, round(avg(faithfulness_score), 4) AS avg_faithfulness,
             round(avg(hallucination_score), 4) AS avg_hallucination, round(avg(cost_usd), 6) AS avg_cost_usd,
             round(sum(cost_usd), 6) AS total_cost_usd, count(*) FILTER {_PASS.replace('(', '(', 1)} AS passed_count,
             count(*) FILTER (eval_mode = 'ground_truth') AS ground_truth_count,
             count(*) FILTER (eval_mode = 'similarity') AS similarity_count,
             count(*) FILTER (eval_mode = 'heuristic') AS heuristic_count,
             round(count(*) FILTER {_PASS} / count(*), 4) AS pass_rate
      FROM recent GROUP BY tenant_id""",
    "ab_faithfulness": """WITH recent AS (
        SELECT * FROM evals_v WHERE prompt_version IS NOT NULL)
      SELECT tenant_id, prompt_version, round(avg(faithfulness_score), 4) AS avg_faithfulness FROM recent GROUP BY ALL""",
    "running_pass_rate": f"""SELECT tenant_id, eval_id, CAST(count(*) FILTER {_PASS} OVER w AS BIGINT) AS passed, count(*) OVER w AS seen,
        count(*) FILTER {_PASS} OVER w / count(*) OVER w AS pass_rate
      FROM evals_v WINDOW w AS (PARTITION BY tenant_id ORDER BY evaluated_at, eval_id ROWS UNBOUNDED PRECEDING)""",
}
ORACLES = {name: with_views(sql) for name, sql in ORACLES.items()}
