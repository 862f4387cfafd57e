"""Dashboards read from rollups that a stream keeps up; oracles are those of the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators import anomaly, ingest, metrics
from emberwatch.operators.evaluate import cost
from emberwatch.plans import anomaly as anomaly_plans
from emberwatch.plans import context as context_plans
from emberwatch.plans import investigate, portal, streams
from emberwatch.plans.fixtures import Tables
from emberwatch.plans.ingest import parsed
from emberwatch.streaming import flows, rollups

BOUNDS = {"llm_seconds": metrics.LLM_SECONDS, "tool_seconds": metrics.TOOL_SECONDS, "faithfulness": metrics.SCORES,
          "compression_ratio": metrics.RATIOS}


def kept(rows: DataFrame, partial: rollups.Partial, name: str) -> DataFrame:
    """The partial rows of a stream of these rows."""
    path = flows.scratch(rows.sparkSession, name)
    rollups.rollup_sink(flows.as_stream(rows, f"{name}-rows"), partial, path, flows.scratch(rows.sparkSession, f"{name}-state"),
                        trigger={"availableNow": True}).awaitTermination()
    return rollups.read_partials(rows.sparkSession, path)


def counter_events(t: Tables) -> DataFrame:
    """Everything that is counted, one row per count: metric, label, tenant_id, at, value."""
    def rows(df: DataFrame, metric: str, label: Column, at: Column, value: Column | None = None) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), label.alias("label"), "tenant_id", at.alias("at"),
                         (F.lit(1) if value is None else value).cast("long").alias("value"))

    accepted = F.when(ingest.reject_reason().isNull(), "accepted").otherwise("rejected")
    confirmed = F.when(anomaly.is_yes("verdict"), "confirmed").otherwise("false_positive")
    rca, at = cost(t.rca), F.col("created_at")
    out = rows(ingest.tenant_extract(parsed(t)), "ingested", accepted, F.col("ts"))
    for more in (
        rows(anomaly_plans.merged(t), "anomalies", F.col("anomaly_type"), F.timestamp_seconds("bucket")),
        rows(t.alerts.join(anomaly_plans.verdicts(t), "alert_id"), "verifications", confirmed, at),
        rows(rca, "investigations", F.concat_ws("/", "status", "model_used"), at),
        rows(rca.where("status = 'failed'"), "failures", F.col("failure_reason"), at),
        rows(rca, "tokens", F.lit("input"), at, F.col("input_tokens")),
        rows(rca, "tokens", F.lit("output"), at, F.col("output_tokens")),
        rows(rca, "micro_usd", F.col("model_used"), at, F.round(F.col("cost_usd") * 1e6)),
    ):
        out = out.unionByName(more)
    return out


def histogram_events(t: Tables) -> DataFrame:
    def rows(df: DataFrame, metric: str, at: str, value: Column, positive: bool = True) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), "tenant_id", F.col(at).alias("at"),
                         (F.when(value > 0, value) if positive else value).cast("double").alias("value"))

    ratios = context_plans.stats(t).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    return (rows(t.rca, "llm_seconds", "created_at", F.col("llm_latency_ms") / 1000.0)
            .unionByName(rows(t.rca, "tool_seconds", "created_at", F.col("tool_latency_ms") / 1000.0))
            .unionByName(rows(t.evals, "faithfulness", "evaluated_at", F.col("faithfulness_score"), False))
            .unionByName(rows(ratios, "compression_ratio", "at", F.col("compression_ratio"))))


QUERIES = {
    "rollup_eval_summary": lambda t: rollups.eval_summary_of(kept(t.evals, rollups.eval_partials, "evals"), t.tenants),
    "rollup_pass_rate": lambda t: rollups.pass_rate_of(kept(t.evals, rollups.eval_partials, "evals")),
    "rollup_counters": lambda t: rollups.counters_of(kept(counter_events(t), rollups.counter_partials, "counters")),
    "rollup_histograms": lambda t: rollups.histograms_of(
        kept(histogram_events(t), rollups.histogram_partials(BOUNDS), "histograms"), BOUNDS).withColumn("sum", F.round("sum", 3)),
    "rollup_percentiles": lambda t: rollups.quantiles_of(
        kept(t.rca, rollups.quantile_partials("total_latency_ms", "created_at"), "latencies"), {"p50_ms": 0.5, "p95_ms": 0.95}),
}

ORACLES = {
    "rollup_eval_summary": investigate.ORACLES["eval_summary"],
    "rollup_pass_rate": streams.ORACLES["stream_pass_rate"],
    "rollup_counters": portal.ORACLES["metric_counters"],
    "rollup_histograms": portal.ORACLES["latency_histogram"],
}
