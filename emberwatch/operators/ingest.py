"""Ingestion: parse, validate, enrich, tenant extraction, dedup, dead letters, keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.scoring import stable_id
from emberwatch.functions.text import strip
from emberwatch.schemas import LOG_LEVELS, RAW_LOG

# Fixed value: RFC 3339 timestamps.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def rfc3339(text: Column) -> Column:
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def log_parse(raw: DataFrame, *, value: str = "value", arrived: str = "received_at") -> DataFrame:
    """JSON text to typed log columns; malformed JSON is dropped, a bad timestamp becomes arrival time."""
    parsed = raw.withColumn("_j", F.from_json(value, RAW_LOG, {"columnNameOfCorruptRecord": "_corrupt"}))
    return (parsed.where(F.col("_j").isNotNull() & F.col("_j._corrupt").isNull())
            .withColumns({"service": F.col("_j.service"), "level": F.col("_j.level"),
                          "message": F.col("_j.message"), "trace_id": F.col("_j.trace_id"),
                          "metadata": F.col("_j.metadata"),
                          "ts": F.coalesce(rfc3339(F.col("_j.timestamp")), F.col(arrived))})
            .drop("_j"))


def reject_reason() -> Column:
    """First rule a record breaks, in order; null for a good record. Levels are case-sensitive."""
    def empty(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    return (F.when(empty("service"), "service is required").when(empty("level"), "level is required")
            .when(empty("message"), "message is required")
            .when(~F.col("level").isin(LOG_LEVELS), "level is not valid"))


def log_tagged(logs: DataFrame) -> DataFrame:
    """All rows with ``reject_reason``, in one pass."""
    return logs.withColumn("reject_reason", reject_reason())


def log_validate(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); rejected rows carry ``reject_reason``."""
    tagged = log_tagged(logs)
    return tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"), tagged.where(F.col("reject_reason").isNotNull())


def log_enrich(valid: DataFrame, *, key: str = "raw_id", now: Column | None = None) -> DataFrame:
    """Fill a missing trace id (from the row key, so replays agree) and metadata; stamp ingestion time."""
    trace = F.when(F.coalesce("trace_id", F.lit("")) == "", stable_id("gen-", F.col(key).cast("string"))).otherwise(F.col("trace_id"))
    return valid.withColumns({"trace_id": trace,
                              "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")),
                              "ingested_at": now if now is not None else F.current_timestamp()})


def tenant_extract(df: DataFrame, *, default: str = "unknown", out: str = "tenant_id") -> DataFrame:
    """``metadata.tenant_id`` if non-empty, else the default."""
    return df.withColumn(out, F.coalesce(F.nullif(F.try_element_at("metadata", F.lit("tenant_id")), F.lit("")), F.lit(default)))


def batch_dedup_trace(df: DataFrame, *, batch: str, order: str, trace: str = "trace_id") -> DataFrame:
    """First row per trace inside each batch; rows without a trace all stay."""
    has = F.coalesce(F.col(trace), F.lit("")) != ""
    first = F.min_by(F.struct(*df.columns), F.col(order))
    kept = df.where(has).groupBy(batch, trace).agg(first.alias("_r")).select("_r.*")
    return kept.unionByName(df.where(~has))


def dead_letter(rejected: DataFrame, *, topic: str, reason: str, payload: str, seen: str,
                retries: int | Column = 0, max_chars: int | None = None) -> DataFrame:
    """Envelope for rows that could not be processed, with their whole payload unless ``max_chars`` is given."""
    whole = F.col(payload)
    tries = F.lit(retries) if isinstance(retries, int) else retries
    return rejected.select(
        F.lit(topic).alias("original_topic"), F.col(reason).alias("failure_reason"),
        tries.alias("retry_count"), F.col(seen).alias("first_seen_at"),
        F.col(seen).alias("last_attempt_at"), (whole if max_chars is None else F.substring(whole, 1, max_chars)).alias("original_payload"))


def missing_fields(messages: DataFrame, fields: list[str], *, value: str = "value") -> DataFrame:
    """All rows with the list of keys they lack; a null value counts as present."""
    keys = F.json_object_keys(F.get_json_object(value, "$"))
    missing = F.array_except(F.array(*[F.lit(f) for f in fields]), F.coalesce(keys, F.array().cast("array<string>")))
    return messages.withColumn("missing", missing)


def required_fields(messages: DataFrame, fields: list[str], *, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(ok, bad) by key presence; bad rows list ``missing``."""
    tagged = missing_fields(messages, fields, value=value)
    return tagged.where(F.size("missing") == 0).drop("missing"), tagged.where(F.size("missing") > 0)


def sink_rows(logs: DataFrame) -> DataFrame:
    """Rows as stored: a bad trace id becomes null, missing metadata an empty map."""
    return logs.withColumns({"trace_id": F.when(F.col("trace_id").rlike(UUID), F.col("trace_id")),
                             "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))})


def bad_tenants(logs: DataFrame) -> DataFrame:
    """Rows whose tenant is not a UUID; a sink that requires UUID tenants refuses their batch."""
    return logs.where(~F.coalesce(F.col("tenant_id").rlike(UUID), F.lit(False)))


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str], *, seq: str,
                  keep_first: tuple[str, ...] = ("created_at",), do_nothing: bool = False) -> DataFrame:
    """Insert-or-update: the last version of a key wins, except ``keep_first`` columns, which stay as
    first stored. With ``do_nothing`` the first version wins. One shuffle, combined map-side."""
    both = base.unionByName(updates)
    cols = [c for c in base.columns if c not in keys]
    row = F.struct(*cols)
    if do_nothing:
        return both.groupBy(*keys).agg(F.min_by(row, F.col(seq)).alias("_r")).select(*keys, "_r.*")
    aggs = [F.max_by(row, F.col(seq)).alias("_r"), F.min_by(row, F.col(seq)).alias("_f")]
    kept = [F.col(f"_f.{c}") if c in keep_first else F.col(f"_r.{c}") for c in cols]
    return both.groupBy(*keys).agg(*aggs).select(*keys, *kept)


def update_by_key(base: DataFrame, updates: DataFrame, keys: list[str], cols: list[str], *, seq: str | None = None) -> DataFrame:
    """Set ``cols`` where the key matches; unmatched updates change nothing. Several updates of one
    key: the one with the largest ``seq`` counts."""
    row = F.struct(*cols)
    one = updates.groupBy(*keys).agg((F.max_by(row, F.col(seq)) if seq else F.first(row)).alias("_u"))
    joined = base.join(one, keys, "left")
    return joined.withColumns({c: F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)) for c in cols}).drop("_u")


def alert_label(alerts: DataFrame, labels: DataFrame, *, lo: int = 10, hi: int = 1000) -> DataFrame:
    """Set ``ground_truth`` from trimmed label texts of accepted length, tenant and alert matching."""
    text = strip(F.col("label"))
    good = labels.where(F.length(text).between(lo, hi)).select("alert_id", "tenant_id", text.alias("ground_truth"), "seq")
    return update_by_key(alerts, good, ["alert_id", "tenant_id"], ["ground_truth"], seq="seq")


def incident_compression_update(incidents: DataFrame, stats: DataFrame) -> DataFrame:
    return update_by_key(incidents, stats, ["incident_id"],
                         ["compression_ratio", "original_log_count", "was_compressed"])
