"""Topic reads and writes: Kafka on a cluster, JSON files with the same columns elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_topic(spark: SparkSession, *, topic: str, servers: str | None = None,
               path: str | None = None, **options: str) -> DataFrame:
    """Stream with columns ``key``, ``value`` (strings) and ``timestamp``."""
    if servers:
        raw = (spark.readStream.format("kafka")
               .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
               .options(**options).load())
        return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")
    return (spark.readStream.schema("key string, value string, timestamp timestamp")
            .options(**options).json(f"{path}/{topic}"))


def to_messages(df: DataFrame, *, key: str = "tenant_id") -> DataFrame:
    """Rows as tenant-keyed JSON messages."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"),
                     F.current_timestamp().alias("timestamp"))


def write_topic(df: DataFrame, *, topic: str, checkpoint: str, servers: str | None = None,
                path: str | None = None, available_now: bool = False) -> StreamingQuery:
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    if servers:
        return (writer.format("kafka").option("kafka.bootstrap.servers", servers)
                .option("topic", topic).start())
    return writer.format("json").start(f"{path}/{topic}")
