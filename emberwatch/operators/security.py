"""Security scans over a log table or stream: injection, personal data, events and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import redaction as rd


def injection_scan(df: DataFrame, text_col: str = "message", *, prefix: str = "injection") -> DataFrame:
    """Adds <prefix>_text, <prefix>_names and <prefix>_count; families run one after the other."""
    return rd.redact(df, text_col, rd.injection_rules(), out_text=f"{prefix}_text",
                     out_names=f"{prefix}_names", out_count=f"{prefix}_count")


def pii_scan(df: DataFrame, text_col: str = "message", *, kinds: tuple[str, ...] | None = None,
             prefix: str = "pii") -> DataFrame:
    """E-mail, public IPv4, Luhn-valid card, phone and labelled user-id redaction, in this order."""
    return rd.redact(df, text_col, rd.pii_rules(kinds), out_text=f"{prefix}_text",
                     out_names=f"{prefix}_names", out_count=f"{prefix}_count")


def pii_simple(df: DataFrame, text_col: str, kinds: tuple[str, ...]) -> DataFrame:
    return pii_scan(df, text_col, kinds=kinds)


def pii_public_ip(df: DataFrame, text_col: str = "message") -> DataFrame:
    return pii_scan(df, text_col, kinds=("ipv4",))


def pii_credit_card(df: DataFrame, text_col: str = "message") -> DataFrame:
    return pii_scan(df, text_col, kinds=("credit_card",))


def security_scan(logs: DataFrame) -> DataFrame:
    """Injection scan on the raw message, then the personal-data scan on its output."""
    return pii_scan(injection_scan(logs), "injection_text")


def security_clean(logs: DataFrame) -> DataFrame:
    """Clean log rows: redacted message plus flags; other columns (also metadata) stay as they are."""
    kept = [c for c in logs.columns if c != "message"]
    return security_scan(logs).select(
        *kept, F.col("pii_text").alias("message"),
        (F.col("injection_count") > 0).alias("injection_attempted"),
        F.col("pii_names").alias("pii_fields_redacted"))


def security_events(scanned: DataFrame, *, id_col: str = "log_id", time_col: str = "ts") -> DataFrame:
    """Up to two events per scanned log at the log's time, with the digest of the raw message only."""
    def event(kind: str, names: str, count: str):
        return F.when(F.col(count) > 0, F.struct(
            F.lit(kind).alias("event_type"), F.col(names).alias("names"), F.col(count).alias("matches")))

    both = F.array_compact(F.array(event("injection", "injection_names", "injection_count"),
                                   event("pii", "pii_names", "pii_count")))
    details = F.when(F.col("event_type") == "injection",
                     F.to_json(F.struct(F.col("names").alias("matched_patterns"), F.col("matches").alias("match_count")))
                     ).otherwise(F.to_json(F.struct(F.col("names").alias("fields_redacted"),
                                                    F.col("matches").alias("redaction_count"))))
    digest = F.sha2(F.col("message"), 256)
    # The outer form keeps Spark from testing the list, and so scanning the text, a second time.
    return (scanned.select(id_col, "tenant_id", "service", "message", F.col(time_col).alias("logged_at"), F.inline_outer(both))
            .where(F.col("event_type").isNotNull())
            .select(F.concat(F.lit("sec-"), F.substring(F.sha2(F.concat_ws("|", F.col(id_col).cast("string"),
                                                                           "event_type"), 256), 1, 32)).alias("event_id"),
                    id_col, "tenant_id", "service", "event_type", details.alias("details"),
                    digest.alias("original_message_hash"), "logged_at"))


def parse_errors(rejected: DataFrame, *, id_col: str = "raw_id", reason_col: str = "reject_reason",
                 time_col: str = "received_at") -> DataFrame:
    """Events for rows that did not parse, with the columns of ``security_events`` (the tenant is not known)."""
    raw = F.coalesce("value", F.lit(""))
    return rejected.select(
        F.concat(F.lit("sec-"), F.substring(F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.lit("parse_error")), 256), 1, 32))
         .alias("event_id"),
        F.col(id_col).alias("log_id"), F.lit("unknown").alias("tenant_id"), F.lit("security-scan").alias("service"),
        F.lit("parse_error").alias("event_type"), F.to_json(F.struct(F.col(reason_col).alias("error"))).alias("details"),
        F.sha2(raw, 256).alias("original_message_hash"), F.col(time_col).alias("logged_at"))


def audit_hash(calls: DataFrame) -> DataFrame:
    """Audit rows of model calls: digests instead of texts."""
    return (calls.withColumns({"input_hash": F.sha2("input_text", 256), "output_hash": F.sha2("output_text", 256)})
            .drop("input_text", "output_text"))


def pii_by_field(scanned: DataFrame) -> DataFrame:
    """Messages per field type and tenant; a field counts once per message."""
    return (scanned.select(F.coalesce("tenant_id", F.lit("unknown")).alias("tenant_id"),
                           F.explode_outer("pii_names").alias("field_type"))
            .where(F.col("field_type").isNotNull())
            .groupBy("tenant_id", "field_type").agg(F.count("*").alias("messages")))


def injection_by_service(scanned: DataFrame) -> DataFrame:
    return (scanned.where(F.col("injection_count") > 0)
            .groupBy("service", F.coalesce("tenant_id", F.lit("unknown")).alias("tenant_id"))
            .agg(F.count("*").alias("attempts")))
