"""Analytical queries behind the API: lists, details, latest-related lookups and small statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import clip
from emberwatch.operators.correlate import incident_severity
from emberwatch.operators.ordered import newest

NO_TEXTS = "array<string>"


def optional(df: DataFrame, **filters: str | None) -> DataFrame:
    """Equality filters; None means no filter."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def recent_logs(logs: DataFrame, *, service: str | None = None, level: str | None = None, limit: int) -> DataFrame:
    """The ``limit`` newest logs per tenant."""
    return newest(optional(logs, service=service, level=level), ["tenant_id"],
                  [F.desc("ts"), F.desc("log_id")], limit, rank="position")


def _latest_incident(incidents: DataFrame, cols: list[str]) -> DataFrame:
    """Per alert, the newest incident that contains it: one aggregate instead of a lookup per alert."""
    order = F.struct("created_at", "incident_id")
    return (incidents.select("tenant_id", F.explode("alert_ids").alias("alert_id"), order.alias("_o"),
                             F.struct(*cols).alias("_i"))
            .groupBy("tenant_id", "alert_id").agg(F.max_by("_i", F.col("_o")).alias("inc")))


def alerts_latest_incident(alerts: DataFrame, incidents: DataFrame, *, severity: str | None = None,
                           service: str | None = None, limit: int | None = None) -> DataFrame:
    """Alerts with cascade flag and services of their latest incident; newest first per tenant."""
    wanted = optional(alerts, severity=severity.upper() if severity else None, service=service)
    if limit is not None:
        wanted = newest(wanted, ["tenant_id"], [F.desc("created_at"), F.desc("alert_id")], limit).drop("_rank")
    latest = _latest_incident(incidents, ["is_cascade", "affected_services"])
    return (wanted.join(latest, ["tenant_id", "alert_id"], "left")
            .withColumns({"is_cascade": F.coalesce("inc.is_cascade", F.lit(False)),
                          "affected_services": F.coalesce("inc.affected_services", F.array().cast(NO_TEXTS))})
            .drop("inc"))


def latest_rca(rca: DataFrame, cols: list[str]) -> DataFrame:
    """Newest result of each incident, any status."""
    return (rca.groupBy("tenant_id", "incident_id")
            .agg(F.max_by(F.struct(*cols), F.struct("created_at", "rca_id")).alias("_r"))
            .select("tenant_id", "incident_id", "_r.*"))


def alert_detail(alerts: DataFrame, incidents: DataFrame, rca: DataFrame) -> DataFrame:
    """Alert, its latest incident, and that incident's latest result."""
    fields = ["incident_id", "is_cascade", "affected_services", "correlation_window_ms", "compression_ratio",
              "original_log_count", "was_compressed"]
    results = latest_rca(rca, ["rca_id", "model_used", "status"]).withColumnRenamed("status", "rca_status")
    joined = alerts.join(_latest_incident(incidents, fields), ["tenant_id", "alert_id"], "left").select(
        *alerts.columns, "inc.*")
    return joined.join(results, ["tenant_id", "incident_id"], "left")


def investigations(rca: DataFrame, *, status: str | None = None, limit: int, chars: int | None = None) -> DataFrame:
    """The ``limit`` newest results per tenant; causes are cut for display if ``chars`` is given."""
    page = newest(optional(rca, status=status), ["tenant_id"], [F.desc("created_at"), F.desc("rca_id")], limit, rank="position")
    return page if chars is None else page.withColumn("root_cause", clip(F.col("root_cause"), chars))


def failed_investigations(rca: DataFrame, *, limit: int) -> DataFrame:
    return investigations(rca, status="failed", limit=limit)


def investigation_detail(rca: DataFrame, incidents: DataFrame, evals: DataFrame) -> DataFrame:
    """Result with its incident and its latest evaluation."""
    latest = (evals.groupBy("rca_id", "tenant_id")
              .agg(F.max_by(F.struct("eval_mode", "faithfulness_score", "hallucination_score", F.col("cost_usd")),
                            F.struct("evaluated_at", "eval_id")).alias("_e"))
              .select("rca_id", "tenant_id", "_e.*"))
    inc = incidents.select("incident_id", "tenant_id", "alert_ids", "affected_services", "is_cascade", "correlation_window_ms")
    return rca.join(inc, ["incident_id", "tenant_id"], "left").join(latest, ["rca_id", "tenant_id"], "left")


def manual_trigger_payload(incidents: DataFrame, alerts: DataFrame, *, model: str = "gpt-4-turbo",
                           variant: str = "v1") -> DataFrame:
    """Investigation requests for incidents chosen by hand; severity HIGH without alerts."""
    services = F.array_join("affected_services", ", ")
    cascade = F.initcap(F.col("is_cascade").cast("string"))
    # The words of the two texts of a request.
    return (incident_severity(incidents, alerts).select(
        "incident_id", "tenant_id", "alert_ids", "affected_services", "is_cascade", "severity",
        F.lit(model).alias("model_id"), F.lit(variant).alias("prompt_variant"),
        F.concat(F.lit("Manual RCA trigger for incident "), "incident_id", F.lit(". Affected services: "), services,
                 F.lit(". Severity: "), "severity", F.lit(".")).alias("compressed_context"),
        F.coalesce(F.nullif("compression_ratio", F.lit(0.0)), F.lit(1.0)).alias("compression_ratio"),
        F.concat(F.lit("Manual investigation trigger. Services: "), services, F.lit(". Cascade: "), cascade,
                 F.lit(".")).alias("incident_description"), "created_at"))


def security_events_page(events: DataFrame, *, event_type: str | None = None, limit: int) -> DataFrame:
    """The ``limit`` newest events per tenant with the total before the limit. The total is an aggregate joined to
    the few page rows, not a count over the whole partition."""
    wanted = optional(events, event_type=event_type).withColumn("tenant_id", F.coalesce("tenant_id", F.lit("unknown")))
    total = wanted.groupBy("tenant_id").agg(F.count("*").alias("total"))
    return newest(wanted, ["tenant_id"], [F.desc("logged_at"), F.desc("event_id")], limit, rank="position").join(total, "tenant_id")


def kb_stats(past: DataFrame) -> DataFrame:
    """Entries by origin and the sorted services per tenant (their number is that of the services)."""
    return past.groupBy("tenant_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("source") == "seed").alias("seed_count"),
        F.count_if(F.col("source") == "auto_learned").alias("auto_learned_count"),
        F.array_sort(F.collect_set("service")).alias("services"))


def alert_search(alerts: DataFrame, *, service: str | None = None, severity: str | None = None) -> DataFrame:
    """Matching alerts (service: case-insensitive substring) with shown and total per tenant."""
    match = F.lit(True)
    if service:
        match = match & F.contains(F.lower("service"), F.lit(service.lower()))
    if severity:
        match = match & (F.col("severity") == severity)
    counts = alerts.groupBy("tenant_id").agg(F.count_if(match).alias("shown"), F.count("*").alias("total"))
    return alerts.where(match).join(counts, "tenant_id")


def tenant_by_key_hash(keys: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenant of each presented key, by digest."""
    return (keys.withColumn("api_key_hash", F.sha2("api_key", 256))
            .join(tenants.select("tenant_id", "name", "model_tier", "api_key_hash"), "api_key_hash"))
