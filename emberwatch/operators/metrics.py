"""Metrics as aggregates over the event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the histogram buckets.
LLM_SECONDS = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0]
TOOL_SECONDS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0]
SCORES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
RATIOS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def metric_counters(df: DataFrame, labels: list[str], *, value: str | None = None, name: str = "value") -> DataFrame:
    """Counter per label combination: rows, or the sum of ``value``."""
    return df.groupBy(*labels).agg((F.sum(value) if value else F.count("*")).alias(name))


def token_counters(rca: DataFrame) -> DataFrame:
    """Tokens by type and tenant."""
    by_type = rca.unpivot(["tenant_id"], ["input_tokens", "output_tokens"], "token_type", "tokens")
    return by_type.groupBy("tenant_id", F.regexp_replace("token_type", "_tokens", "").alias("token_type")).agg(
        F.sum("tokens").alias("tokens"))


def latency_histogram(df: DataFrame, value: Column, labels: list[str], bounds: list[float], *,
                      positive_only: bool = True) -> DataFrame:
    """Cumulative buckets, sum and count per label set."""
    return latency_histograms(df, {"": (value, bounds, positive_only)}, labels).drop("metric")


def latency_histograms(df: DataFrame, metrics: dict[str, tuple[Column, list[float], bool]], labels: list[str]) -> DataFrame:
    """Histograms of several values of the same rows, ``{metric: (value, bounds, positive only)}``: one aggregate
    per bound in a single pass, rows are not multiplied by bounds. A label set without values has no buckets."""
    names = list(metrics)
    counted, sums = [], []
    for m, (value, bounds, positive) in enumerate(metrics.values()):
        v = F.when(F.col(f"_v{m}") > 0, F.col(f"_v{m}")) if positive else F.col(f"_v{m}")
        counted += [F.count_if(v <= b).alias(f"_b{m}_{i}") for i, b in enumerate(bounds)] + [F.count(v).alias(f"_n{m}")]
        sums.append(F.sum(v).alias(f"_s{m}"))
    agg = df.select(*labels, *[metrics[n][0].alias(f"_v{m}") for m, n in enumerate(names)]).groupBy(*labels).agg(*counted, *sums)
    rows = [F.struct(F.lit(n).alias("metric"), F.lit(le).alias("le"), F.col(count).alias("bucket_count"),
                     F.col(f"_n{m}").alias("count"), F.col(f"_s{m}").cast("double").alias("sum"))
            for m, n in enumerate(names)
            for le, count in [(str(b), f"_b{m}_{i}") for i, b in enumerate(metrics[n][1])] + [("+Inf", f"_n{m}")]]
    return agg.select(*labels, F.inline(F.array(*rows))).where(F.col("count") > 0)


def latest_gauge(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"))


def rate_per_service(logs: DataFrame, *, window_s: int = 3600) -> DataFrame:
    """Logs per second in tumbling windows."""
    start = F.floor(F.unix_timestamp("ts") / window_s) * window_s
    return (logs.groupBy("tenant_id", "service", start.cast("long").alias("window_start"))
            .agg(F.count("*").alias("logs")).withColumn("per_second", F.col("logs") / window_s))


def share(df: DataFrame, labels: list[str], within: list[str]) -> DataFrame:
    """Rows per label set and their share; the window runs over the aggregate, not the rows."""
    return (df.groupBy(*within, *labels).agg(F.count("*").alias("n"))
            .withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within))))


def level_distribution(logs: DataFrame) -> DataFrame:
    return share(logs, ["level"], ["tenant_id"])


def latency_percentiles(rca: DataFrame, *, exact: bool = True) -> DataFrame:
    """p50 and p95 of the total latency per tenant. Exact keeps one counter per distinct millisecond
    value, which is bounded; ``exact=False`` uses the sketch."""
    def at(p: float) -> Column:
        c = F.col("total_latency_ms")
        return F.percentile(c, p) if exact else F.percentile_approx(c, p, 10_000).cast("double")

    return rca.groupBy("tenant_id").agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))
