"""Streaming forms, run to the end of a bounded source; oracles are those of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import iso
from emberwatch.plans import anomaly, context, correlate, investigate
from emberwatch.plans.fixtures import Tables, with_views
from emberwatch.sources import topics
from emberwatch.sources.tables import read_table
from emberwatch.streaming import flows, settled, stateful

HOUR = 3600


def _buckets(t: Tables) -> DataFrame:
    """Closed buckets; the last ones stay open until later events move the watermark."""
    closed = flows.bucket_counts_stream(flows.as_stream(t.logs, "logs"), bucket_s=HOUR, lateness="0 seconds")
    return flows.run_to_table(closed, name="buckets")


def _sink(t: Tables) -> DataFrame:
    spark = t.spark
    logs = t.logs.withColumn("metadata", F.from_json("metadata", "map<string,string>"))
    path = flows.scratch(spark, "weekly")
    flows.log_sink(flows.as_stream(logs, "logs"), path, flows.scratch(spark, "weekly-state"),
                   trigger={"availableNow": True}).awaitTermination()
    return spark.read.parquet(path).groupBy(F.col("week").cast("string").alias("week"), "tenant_id").agg(
        F.count("*").alias("logs"), F.countDistinct("log_id").alias("ids"))


def _compacted(t: Tables) -> DataFrame:
    """Streamed into the sink, compacted into the weekly layout, read whole: a row lost or doubled anywhere shows."""
    logs = t.logs.withColumn("metadata", F.from_json("metadata", "map<string,string>"))
    path, weekly = flows.scratch(t.spark, "sink"), flows.scratch(t.spark, "compacted")
    flows.log_sink(flows.as_stream(logs, "logs"), path, flows.scratch(t.spark, "sink-state"), trigger={"availableNow": True}).awaitTermination()
    flows.compact_sink(t.spark, path, weekly)
    return read_table(t.spark, weekly).groupBy(F.col("week").cast("string").alias("week"), "tenant_id", "service").agg(
        F.count("*").alias("logs"), F.countDistinct("log_id").alias("ids"), F.max("log_id").alias("newest"))


def _cache(t: Tables) -> DataFrame:
    """Entries and questions as one stream of events."""
    entries = t.entries.select("tenant_id", F.col("created_at").alias("at"), F.lit(0).alias("kind"), F.col("entry_id").cast("long").alias("id"),
                               F.col("rca_result").alias("result"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = t.vec.select("tenant_id", F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.col("vec_id").cast("long").alias("id"),
                         F.lit(None).cast("string").alias("result"), F.col("embedding").cast("array<double>").alias("embedding"))
    return settled.cache_lookup_stream(_ticking(entries.unionByName(asked), "at"), threshold=0.5)


def _ticking(df: DataFrame, at: str) -> DataFrame:
    return flows.as_stream(settled.with_tick(df, at), "timed")


def _merged(t: Tables) -> DataFrame:
    at = F.timestamp_seconds("bucket")
    stat = anomaly.flagship(t).select("tenant_id", "service", "bucket", at.alias("at"), "anomaly_type", "severity", "confidence", "z_score",
                                      "current_value", "baseline_mean")
    sem = anomaly.semantic_results(t).select("tenant_id", "service", "bucket", at.alias("at"), "anomaly_type", "severity", "confidence",
                                             "similarity", "nearest_message")
    return settled.merge_detectors_stream(_ticking(stat, "at"), _ticking(sem, "at"), ["tenant_id", "service", "bucket"])


def _steps(t: Tables) -> DataFrame:
    """Steps of an investigation a minute apart; investigations start an hour apart."""
    at = F.timestamp_seconds(1704067200 + F.regexp_extract("rca_id", "[0-9]+", 0).cast("long") * 3600 + F.col("step_number") * 60)
    return settled.step_stream(_ticking(t.steps.select("rca_id", "step_number", "step_type", at.alias("at")), "at"), first=0)


def _topic(t: Tables) -> DataFrame:
    """Logs through a topic (its file form): written as keyed messages by one stream, read and parsed by another."""
    base = flows.scratch(t.spark, "topics")
    logs = t.logs.select("tenant_id", "service", "log_id", "level", "message")
    topics.write_topic(topics.to_messages(flows.as_stream(logs, "logs")), topic="logs.enriched", path=base,
                       checkpoint=flows.scratch(t.spark, "topic-state"), available_now=True).awaitTermination()
    read = topics.read_topic(t.spark, topic="logs.enriched", path=base)
    parsed = read.select("key", F.from_json("value", logs.schema).alias("m")).select("key", "m.*")
    return flows.run_to_table(parsed, name="from-topic")


QUERIES = {
    "topic_logs": lambda t: _topic(t).groupBy("key", "service", "level").agg(
        F.count("*").alias("logs"), F.countDistinct("log_id").alias("ids"), F.count_if(F.col("key") == F.col("tenant_id")).alias("keyed"),
        F.sum(F.length("message")).alias("chars")),
    "stream_cache_lookup": lambda t: flows.run_to_table(_cache(t)).select(
        "tenant_id", "query_id", F.coalesce("item_id", F.lit(-1)).alias("item_id"), F.coalesce("similarity", F.lit(-1.0)).alias("similarity"),
        "cache_hit"),
    "stream_merge_detectors": lambda t: flows.run_to_table(_merged(t)).select(
        "tenant_id", "service", "bucket", "anomaly_type", "severity", F.round("confidence", 4).alias("confidence")),
    "stream_zscore_per_event": lambda t: flows.run_to_table(settled.zscore_per_event_stream(
        _ticking(t.logs.select("tenant_id", "service", "log_id", "ts", "level"), "ts"), window_s=anomaly.DAY, bucket_s=HOUR))
        .withColumn("ts", iso(F.col("ts"))),
    "stream_route": lambda t: flows.run_to_table(settled.route_stream(
        _ticking(settled.spend_events(context.severe_incidents(t), t.evals), "at"), t.tenants))
        .select("incident_id", "tenant_id", "severity", "model_id", "reason", "prompt_variant"),
    "stream_steps": lambda t: flows.run_to_table(_steps(t)),
    "weekly_layout": _compacted,
    "stream_bucket_counts": _buckets,
    "stream_zscore": lambda t: anomaly.zscore_columns(flows.run_to_table(stateful.zscore_stream(
        flows.as_stream(_buckets(t), "closed"), window_s=anomaly.DAY, bucket_s=HOUR), name="zscores")),
    "stream_cooldown": lambda t: flows.run_to_table(stateful.cooldown_stream(
        flows.as_stream(anomaly.error_candidates(t)), cooldown_s=4 * HOUR)).withColumn("ts", iso(F.col("ts"))),
    "stream_correlate": lambda t: flows.run_to_table(stateful.correlate_stream(
        flows.as_stream(correlate.log_alerts(t)), window_s=correlate.WINDOW_S))
        .select("incident_id", "tenant_id", "is_cascade", "alert_id"),
    "stream_novelty": lambda t: flows.run_to_table(stateful.novelty_stream(
        flows.as_stream(anomaly.error_vectors(t)), threshold=0.3))
        .select("tenant_id", "service", "id", F.round("similarity", 6).alias("similarity")),
    "stream_pass_rate": lambda t: flows.run_to_table(
        flows.pass_rate_stream(flows.as_stream(t.evals)), mode="complete"),
    "log_sink": _sink,
}

ORACLES = {
    "topic_logs": with_views("""SELECT tenant_id AS key, service, level, count(*) AS logs, count(DISTINCT log_id) AS ids, count(*) AS keyed,
        CAST(sum(length(message)) AS BIGINT) AS chars FROM logs_v GROUP BY ALL"""),
    "stream_cache_lookup": context.ORACLES["cache_lookup"],
    "stream_merge_detectors": anomaly.ORACLES["merge_detectors"],
    "stream_zscore_per_event": anomaly.ORACLES["zscore_per_event"],
    "stream_route": context.ORACLES["route"],
    "stream_steps": investigate.ORACLES["step_stream_filter"],
    "stream_bucket_counts": with_views("""
        WITH b AS (
          SELECT tenant_id, service, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS bucket,
                 count(*) FILTER (level IN ('ERROR', 'FATAL')) AS errors, count(*) AS volume
          FROM logs_v GROUP BY ALL)
        SELECT * FROM b WHERE bucket + 3600 <= (SELECT epoch(max(ts)) FROM logs_v)"""),
    "stream_zscore": with_views(f"""WITH {anomaly.SCORED} SELECT tenant_id, service, bucket, metric, current_value, baseline_points,
        round(coalesce(baseline_mean, -1), 4) AS baseline_mean, round(coalesce(baseline_std, -1), 4) AS baseline_std,
        z IS NOT NULL AS defined, round(coalesce(z, -1), 4) AS z_score FROM scored
      WHERE bucket + 3600 <= (SELECT epoch(max(ts)) FROM logs_v)"""),
    "stream_cooldown": anomaly.ORACLES["alert_cooldown"],
    "stream_correlate": correlate.ORACLES["correlate"],
    "stream_novelty": with_views(f"""WITH RECURSIVE {anomaly.novelty_fold("vec_v", "vec_id", "created_at", 0.3)}
        SELECT tenant_id, service, id, round(sim, 6) AS similarity FROM novelty WHERE sim < 0.3"""),
    "stream_pass_rate": with_views("""
        SELECT tenant_id, CAST(count(*) FILTER (faithfulness_score > 0.7 AND hallucination_score > 0.7) AS BIGINT) AS passed,
               count(*) AS seen,
               count(*) FILTER (faithfulness_score > 0.7 AND hallucination_score > 0.7) / count(*) AS pass_rate
        FROM evals_v GROUP BY tenant_id"""),
    "weekly_layout": with_views("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, tenant_id, service, count(*) AS logs,
        count(DISTINCT log_id) AS ids, max(log_id) AS newest FROM logs_v GROUP BY ALL"""),
    "log_sink": with_views("""
        SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, tenant_id, count(*) AS logs, count(DISTINCT log_id) AS ids
        FROM logs_v GROUP BY ALL"""),
}
