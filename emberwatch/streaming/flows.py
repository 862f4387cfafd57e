"""Streaming aggregates, sinks and small runners."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.operators.evaluate import is_passed
from emberwatch.operators.ingest import bad_tenants, batch_dedup_trace, dead_letter, sink_rows, upsert_latest
from emberwatch.session import run_dir
from emberwatch.sources.tables import week_start, write_weekly


def bucket_counts_stream(logs: DataFrame, *, bucket_s: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Closed buckets only: a bucket is emitted once the watermark has passed its end."""
    return (logs.withWatermark("ts", lateness)
            .groupBy("tenant_id", "service", F.window("ts", f"{bucket_s} seconds").alias("w"))
            .agg(F.count_if(F.col("level").isin("ERROR", "FATAL")).alias("errors"), F.count("*").alias("volume"))
            .select("tenant_id", "service", F.unix_timestamp("w.start").alias("bucket"), "errors", "volume"))


def pass_rate_stream(evals: DataFrame) -> DataFrame:
    """Pass rate so far per tenant (complete mode)."""
    ok = F.coalesce(is_passed(), F.lit(False)).cast("long")
    return (evals.groupBy("tenant_id").agg(F.sum(ok).alias("passed"), F.count("*").alias("seen"))
            .withColumn("pass_rate", F.col("passed") / F.col("seen")))


def log_sink(logs: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None,
             dedup_traces: bool = False, dead_letters: str | None = None) -> StreamingQuery:
    """Write each micro-batch into its own folder, partitioned by week. A replayed batch overwrites
    its folder, so every row lands once. Within a batch repeated traces can be dropped on request.

    With ``dead_letters`` tenants must be UUIDs: a batch with any other tenant is not stored but goes
    to that folder as a whole, every row with its whole payload.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            store(batch, batch_id)
        finally:
            batch.unpersist()

    def store(batch: DataFrame, batch_id: int) -> None:
        if dead_letters is not None and not bad_tenants(batch).isEmpty():
            failed = batch.withColumns({"_why": F.lit("invalid tenant id"), "_value": F.to_json(F.struct("*"))})
            (dead_letter(failed, topic="logs.enriched", reason="_why", payload="_value", seen="ts")
             .write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}"))
            return
        # Repeats go by the trace as sent; only then do traces that are no UUID become null.
        if dedup_traces:
            batch = batch_dedup_trace(batch.withColumn("_b", F.lit(0)), batch="_b", order="log_id").drop("_b")
        rows = sink_rows(batch).withColumn("week", week_start(F.col("ts")))
        (rows.repartitionByRange("week", "tenant_id", "ts").sortWithinPartitions("week", "tenant_id", "ts")
         .write.mode("overwrite").partitionBy("week").parquet(f"{path}/batch={batch_id}"))

    writer = logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def compact_sink(spark: SparkSession, path: str, out: str, *, parts: int | None = None) -> None:
    """Rewrite all batches of ``log_sink`` into the weekly layout at ``out``, few large files instead of many small ones."""
    write_weekly(spark.read.parquet(path).drop("batch", "week"), out, parts=parts, mode="overwrite")


def change_log_sink(rows: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Keyed updates as an append-only change log; ``read_current`` merges it per key on read."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def read_current(spark: SparkSession, path: str, keys: list[str], *, seq: str) -> DataFrame:
    log = spark.read.parquet(path).drop("batch")
    return upsert_latest(log, log.limit(0), keys, seq=seq)


def compact_changes(spark: SparkSession, path: str, out: str, keys: list[str], *, seq: str) -> None:
    """Merge a change log into one snapshot at ``out``, itself a change log: later batches written beside it merge on."""
    read_current(spark, path, keys, seq=seq).write.mode("overwrite").parquet(f"{out}/batch=-1")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the run's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_stream(df: DataFrame, name: str = "source") -> DataFrame:
    """A bounded table as a file stream."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run_to_table(stream: DataFrame, *, name: str = "sink", mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end and return what it wrote."""
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-state")
    if mode == "append":
        query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = (stream.writeStream.outputMode(mode).foreachBatch(write)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
