"""Semantic cache as tables: lookup in a time window, hit and miss streams, writes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import strip
from emberwatch.operators.vectors import blocked_scores

TOKENS_PER_HIT = 2000        # fixed value: estimated tokens of one saved investigation
USD_PER_TOKEN = 0.00001      # fixed value: estimated price


def cache_query_text(incidents: DataFrame, *, context: str = "compressed_context", chars: int | None = None) -> DataFrame:
    """Text used for both writing and reading: services, severity and the context, or its first ``chars``."""
    said = F.coalesce(context, F.lit(""))
    return incidents.withColumn("query_text", strip(F.concat_ws(
        " ", F.array_join("affected_services", " "), "severity", said if chars is None else F.substring(said, 1, chars))))


def cache_lookup(queries: DataFrame, entries: DataFrame, *, threshold: float = 0.92, ttl_s: int = 86400,
                 block_rows: int = 4096) -> DataFrame:
    """Best live entry of the tenant per query: ``t - ttl < created_at <= t``; hit iff its similarity
    reaches the threshold. Entries without vector or result do not count.

    Entries are copied to the one later TTL-wide time bucket they can still serve, so a query meets
    two buckets' worth of entries, not the tenant's history.
    """
    ttl_us = ttl_s * 1_000_000
    q = queries.select("tenant_id", "query_id", "embedding", F.unix_micros("asked_at").alias("at"))
    q = q.withColumn("_bucket", F.floor(F.col("at") / ttl_us).cast("long"))
    e = (entries.where(F.col("embedding").isNotNull() & F.col("rca_result").isNotNull())
         .select("tenant_id", F.col("entry_id").alias("item_id"), "embedding", F.unix_micros("created_at").alias("at")))
    b = F.floor(F.col("at") / ttl_us).cast("long")
    e = e.withColumn("_bucket", F.explode(F.array(b, b + 1)))
    best = blocked_scores(q, e, ["tenant_id", "_bucket"], k=1, max_age_us=ttl_us, block_rows=block_rows, clip=True)
    found = best.select("query_id", "tenant_id", "item_id", "similarity")
    live = entries.select("tenant_id", F.col("entry_id").alias("item_id"), "rca_result")
    scored = (queries.drop("embedding").join(found, ["query_id", "tenant_id"], "left")
              .withColumn("cache_hit", F.coalesce(F.col("similarity") >= threshold, F.lit(False))))
    return (scored.join(live, ["tenant_id", "item_id"], "left")
            .withColumns({c: F.when(F.col("cache_hit"), F.col(c)) for c in ("item_id", "rca_result")}))


def cache_tagged(looked_up: DataFrame) -> DataFrame:
    """One pass over the lookups with the stream each goes to, for a sink partitioned by ``stream``."""
    return looked_up.withColumn("stream", F.when(F.col("cache_hit"), "hit").otherwise("miss"))


def cache_split(looked_up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): a hit carries the cached result marked as such; a miss goes on to routing."""
    tagged = cache_tagged(looked_up).withColumnRenamed("query_id", "incident_id")
    return (tagged.where("stream = 'hit'").select("tenant_id", "incident_id", "rca_result", "similarity", "cache_hit"),
            tagged.where("stream = 'miss'").select("tenant_id", "incident_id"))


def cache_write(evals: DataFrame, rca: DataFrame) -> DataFrame:
    """Entries from evaluations that passed and whose result did not itself come from the cache."""
    good = evals.where((F.col("faithfulness_score") > 0.7) & (F.col("hallucination_score") > 0.7))
    latest = good.groupBy("rca_id", "tenant_id").agg(F.max("evaluated_at").alias("created_at"))
    return (latest.join(rca.where(~F.col("cache_hit")).select("rca_id", "tenant_id", "incident_id", "root_cause"),
                        ["rca_id", "tenant_id"])
            .select(F.concat(F.lit("entry-"), "rca_id").alias("entry_id"), "tenant_id", "incident_id",
                    F.to_json(F.struct("rca_id", "root_cause")).alias("rca_result"), "created_at"))


def cache_stats(looked_up: DataFrame, entries: DataFrame, *, as_of: Column | None = None, ttl_s: int = 86400) -> DataFrame:
    """Hits, misses and stored keys per tenant. An entry is stored while ``as_of - ttl < created_at <= as_of``
    (default: the newest entry or question)."""
    if as_of is None:
        newest = entries.agg(F.max("created_at").alias("t")).unionByName(looked_up.agg(F.max("asked_at").alias("t")))
        as_of = newest.agg(F.max("t")).scalar()
    age = F.unix_micros(as_of) - F.unix_micros("created_at")
    entries = entries.where((age >= 0) & (age < ttl_s * 1_000_000))
    used = looked_up.groupBy("tenant_id").agg(F.count_if("cache_hit").alias("hits"),
                                              F.count_if(~F.col("cache_hit")).alias("misses"))
    stored = entries.groupBy("tenant_id").agg(F.count("*").alias("keys_stored"))
    rate = F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0))
    return (used.join(stored, "tenant_id", "full").fillna(0, ["hits", "misses", "keys_stored"])
            .withColumns({"hit_rate": F.round(rate, 4), "tokens_saved": F.col("hits") * TOKENS_PER_HIT,
                          "cost_saved_usd": F.round(F.col("hits") * TOKENS_PER_HIT * F.lit(USD_PER_TOKEN), 6)}))
