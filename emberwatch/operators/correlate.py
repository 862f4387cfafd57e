"""Correlation of alerts into incidents, and incident-level summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.scoring import severity_rank, stable_id
from emberwatch.operators.ordered import CHUNK, attach, with_chunk

ORDER = ["created_at", "alert_id"]


def correlate(alerts: DataFrame, *, window_s: int = 60, chunk_s: int | None = None) -> DataFrame:
    """Single and cascade incidents per tenant, alerts taken in time order (ties by id).

    Rule: each alert joins the tenant's window, alerts older than ``window_s`` leave it; two distinct
    services in the window make a cascade of everything in it and empty it; otherwise the alert is a
    single incident and stays.

    A window that has not fired holds one service only, including the previous alert while that is
    young enough. So an alert is *linked* if its predecessor is within ``window_s`` and has another
    service, and it fires iff it is linked and the predecessor did not fire: in a run of linked
    alerts every second one fires, starting with the first. An alert belongs to the next firing at or
    after it, if that is still within the window.

    The timeline is cut into chunks. Inside a chunk everything but the state before its first alert
    is known; one summary row per chunk carries that state and the next firing across chunks.

    Returns one row per (incident, member alert): incident_id, tenant_id, is_cascade, at, alert_id,
    service, severity, created_at.
    """
    key, window_us = ["tenant_id"], window_s * 1_000_000
    cols = ["alert_id", "service", "severity", "created_at"]
    rows = Window.partitionBy(*key, CHUNK).orderBy(*ORDER)
    chunks = Window.partitionBy(*key).orderBy(CHUNK)
    # "Next firing" looks ahead: a growing frame over the reverse order costs one pass, a frame that
    # ends at "unbounded following" would rescan the rest for every row.
    ahead = (Window.partitionBy(*key, CHUNK).orderBy(*[F.desc(c) for c in ORDER])
             .rowsBetween(Window.unboundedPreceding, 0))
    later = Window.partitionBy(*key).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)

    def linked(before: Column, row: Column) -> Column:
        gap = F.unix_micros(row["created_at"]) - F.unix_micros(before["created_at"])
        return (before["service"] != row["service"]) & (gap <= window_us)

    base = with_chunk(alerts.select(*key, *cols), F.col("created_at"), chunk_s or max(60 * window_s, 3600))
    # Row number, link to the row before (unknown for the chunk's first row), last unlinked row.
    inside = (base.withColumn("_row", F.struct(*cols))
              .withColumns({"_n": F.row_number().over(rows), "_before": F.lag("_row").over(rows)})
              .withColumn("_linked", linked(F.col("_before"), F.col("_row")))
              .withColumn("_break", F.max(F.when(~F.col("_linked"), F.col("_n"))).over(rows)))
    odd = F.col("_linked") & ((F.col("_n") - F.col("_break")) % 2 == 1)
    mark = F.struct("created_at", "alert_id")
    summary = inside.groupBy(*key, CHUNK).agg(
        F.max_by("_row", F.struct("_n")).alias("last"), F.min_by("_row", F.struct("_n")).alias("first"),
        F.max("_n").alias("n"), F.max("_break").alias("break"),
        F.max(F.when(F.col("_n") == 2, F.struct(F.col("_linked").alias("linked"), mark.alias("mark")))).alias("second"),
        F.min(F.when(odd, mark)).alias("rest"))
    # Run position of the chunk's last row: counted from its own last break, else from the row before.
    state = summary.withColumn("joined", F.coalesce(linked(F.lag("last").over(chunks), F.col("first")), F.lit(False)))
    own = F.when(F.col("break").isNotNull(), F.col("n") - F.col("break")).when(~F.col("joined"), F.col("n") - 1)
    state = (state.withColumn("own", own)
             .withColumn("rows", F.sum("n").over(chunks))
             .withColumn("reset", F.max(F.when(F.col("own").isNotNull(), F.struct(F.col(CHUNK), "own", "rows"))).over(chunks))
             .withColumn("end", F.coalesce(F.col("reset.own") + F.col("rows") - F.col("reset.rows"), F.col("rows")))
             .withColumn("start", F.when(F.col("joined"), F.coalesce(F.lag("end").over(chunks), F.lit(0)) + 1).otherwise(0)))
    fired = (F.when(F.col("start") % 2 == 1, F.struct(F.col("first.created_at"), F.col("first.alert_id")))
             .when(F.col("second.linked"), F.col("second.mark")).otherwise(F.col("rest")))
    carry = (state.withColumn("_fired", fired)
             .select(*key, CHUNK, F.col("start").alias("_start"),
                     F.last("_fired", ignorenulls=True).over(later).alias("_later")))

    position = F.coalesce(F.col("_n") - F.col("_break"), F.col("_start") + F.col("_n") - 1)
    marked = (attach(inside, carry, key)
              .withColumn("_fires", position % 2 == 1)
              .withColumn("_next", F.coalesce(
                  F.last(F.when(F.col("_fires"), mark), ignorenulls=True).over(ahead), F.col("_later"))))
    member = F.unix_micros("_next.created_at") - F.unix_micros("created_at") <= window_us

    def role(cascade: bool, trigger: Column) -> Column:
        return F.struct(F.lit(cascade).alias("is_cascade"), trigger["alert_id"].alias("trigger"),
                        trigger["created_at"].alias("at"))

    roles = F.array_compact(F.array(F.when(F.coalesce(member, F.lit(False)), role(True, F.col("_next"))),
                                    F.when(~F.col("_fires"), role(False, F.col("_row")))))
    return (marked.select(*key, *cols, F.inline(roles))
            .select(stable_id("inc-", F.col("tenant_id"), F.col("trigger"), F.col("is_cascade").cast("string"))
                    .alias("incident_id"), *key, "is_cascade", "at", *cols))


def incident_fields(members: DataFrame, *, window_s: int = 60) -> DataFrame:
    """One row per incident: ordered alert ids, sorted services, highest severity, window length.

    A single has one member; a cascade spans at most ``window_s``, so the lists are bounded by it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "alert_id")))
    severity = F.max_by(F.coalesce("severity", F.lit("LOW")), severity_rank(F.coalesce("severity", F.lit("LOW"))))
    return (members.groupBy("incident_id", "tenant_id", "is_cascade", "at")
            .agg(ordered.alias("_o"), F.array_sort(F.collect_set("service")).alias("affected_services"),
                 severity.alias("severity"))
            .select("incident_id", "tenant_id", F.col("at").alias("created_at"), "is_cascade",
                    F.transform("_o", lambda o: o.alert_id).alias("alert_ids"), "affected_services", "severity",
                    F.when(F.col("is_cascade"), window_s * 1000).otherwise(0).alias("correlation_window_ms")))


def incident_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("tenant_id").agg(
        F.count_if(~F.col("is_cascade")).alias("single_incidents"),
        F.count_if(F.col("is_cascade")).alias("cascade_incidents"))


def incident_severity(incidents: DataFrame, alerts: DataFrame, *, default: str = "HIGH") -> DataFrame:
    """Highest severity over an incident's alerts of the same tenant; ``default`` without any."""
    linked = (incidents.select("incident_id", "tenant_id", F.explode("alert_ids").alias("alert_id"))
              .join(alerts.select("alert_id", "tenant_id", F.col("severity").alias("_s")), ["alert_id", "tenant_id"])
              .groupBy("incident_id", "tenant_id").agg(F.max_by("_s", severity_rank(F.col("_s"))).alias("severity")))
    return (incidents.drop("severity").join(linked, ["incident_id", "tenant_id"], "left")
            .withColumn("severity", F.coalesce("severity", F.lit(default))))
