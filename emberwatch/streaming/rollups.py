"""Rollups that a stream keeps up: partial aggregates per hour, written once per micro-batch and merged on read.

A micro-batch writes its own folder, named by its id, and a replayed batch writes it anew: nothing counts twice. A
dashboard reads partial rows, whose number grows with hours, labels and batches, not with events; ``compact`` folds the
batches of a rollup into one. Periods are whole hours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.operators.evaluate import is_passed

MODES = ("ground_truth", "similarity", "heuristic")
#: Size parameter of quantile sketches: a stored sketch has some thousand numbers at most, whatever its rows, and a merged one
#: is within 0.4 % of the rank asked for (99 % confidence).
SKETCH_K = 800

Partial = Callable[[DataFrame], DataFrame]


def rollup_sink(rows: DataFrame, partial: Partial, path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Write ``partial`` of every micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def read_partials(spark: SparkSession, path: str, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Partial rows of the hours ``start <= hour < end``; all without bounds."""
    rows = spark.read.parquet(path).drop("batch")
    if start is not None:
        rows = rows.where(F.col("hour") >= F.lit(start).cast("timestamp"))
    return rows if end is None else rows.where(F.col("hour") < F.lit(end).cast("timestamp"))


def compact(spark: SparkSession, path: str, out: str, merge: Partial) -> None:
    """All batches of a rollup as one at ``out``, by the rollup's own merge per hour; later batches beside it merge on."""
    merge(read_partials(spark, path)).write.mode("overwrite").parquet(f"{out}/batch=-1")


def _hour(at: str) -> Column:
    return F.date_trunc("hour", F.col(at)).alias("hour")


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of all other columns per key."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "hour")])


# Evaluations: summary and pass rate.


def eval_partials(evals: DataFrame) -> DataFrame:
    modes = [F.count_if(F.col("eval_mode") == m).alias(f"{m}_count") for m in MODES]
    scores = [f(c).alias(f"{n}_{c}") for c in ("faithfulness_score", "hallucination_score", "cost_usd") for n, f in (("sum", F.sum), ("n", F.count))]
    return evals.groupBy("tenant_id", _hour("evaluated_at")).agg(
        F.count("*").alias("total_evaluations"), F.count_if(is_passed()).alias("passed_count"), *modes, *scores)


def merge_evals(partials: DataFrame) -> DataFrame:
    return _added(partials, ["tenant_id", "hour"])


def eval_summary_of(partials: DataFrame, tenants: DataFrame) -> DataFrame:
    """``evaluate.eval_summary`` from partial rows."""
    total = _added(partials, ["tenant_id"])

    def avg(c: str, digits: int) -> Column:
        return F.round(F.coalesce(F.try_divide(f"sum_{c}", f"n_{c}"), F.lit(0.0)), digits)

    shown = total.select(
        "tenant_id", "total_evaluations", avg("faithfulness_score", 4).alias("avg_faithfulness"),
        avg("hallucination_score", 4).alias("avg_hallucination"), avg("cost_usd", 6).alias("avg_cost_usd"),
        F.round(F.coalesce("sum_cost_usd", F.lit(0.0)), 6).alias("total_cost_usd"), "passed_count", *[f"{m}_count" for m in MODES])
    return (tenants.select("tenant_id").join(shown, "tenant_id", "left").fillna(0)
            .withColumn("pass_rate", F.round(F.coalesce(F.try_divide("passed_count", "total_evaluations"), F.lit(0.0)), 4)))


def pass_rate_of(partials: DataFrame) -> DataFrame:
    return _added(partials, ["tenant_id"]).select(
        "tenant_id", F.col("passed_count").alias("passed"), F.col("total_evaluations").alias("seen"),
        (F.col("passed_count") / F.col("total_evaluations")).alias("pass_rate"))


# Counters: events (metric, label, tenant_id, at, value).


def counter_partials(events: DataFrame) -> DataFrame:
    return events.groupBy("metric", "label", "tenant_id", _hour("at")).agg(F.sum("value").alias("value"))


def merge_counters(partials: DataFrame) -> DataFrame:
    return _added(partials, ["metric", "label", "tenant_id", "hour"])


def counters_of(partials: DataFrame) -> DataFrame:
    return _added(partials, ["metric", "label", "tenant_id"])


# Histograms: events (metric, tenant_id, at, value).


def histogram_partials(bounds: dict[str, list[float]]) -> Partial:
    """Rows per place between the bounds of their metric, and sums. Values that are null don't count."""
    limits = F.create_map(*[x for m, b in bounds.items() for x in (F.lit(m), F.array(*map(F.lit, b)))])

    def partial(events: DataFrame) -> DataFrame:
        place = F.size(F.filter(limits[F.col("metric")], lambda b: b < F.col("value")))
        return events.where(F.col("value").isNotNull()).groupBy("metric", "tenant_id", _hour("at"), place.alias("place")).agg(
            F.count("*").alias("n"), F.sum("value").alias("total"))

    return partial


def merge_histograms(partials: DataFrame) -> DataFrame:
    return _added(partials, ["metric", "tenant_id", "hour", "place"])


def histograms_of(partials: DataFrame, bounds: dict[str, list[float]]) -> DataFrame:
    """Cumulative buckets with count and sum, as ``metrics.latency_histograms``."""
    places = _added(partials, ["metric", "tenant_id", "place"])
    names = F.create_map(*[x for m, b in bounds.items() for x in (F.lit(m), F.array(*[F.lit(str(v)) for v in b], F.lit("+Inf")))])
    # A place counts in its own bucket and all above; a series has few places.
    series = places.groupBy("metric", "tenant_id").agg(
        F.collect_list(F.struct("place", "n")).alias("own"), F.sum("n").alias("count"), F.sum("total").alias("sum"))
    each = series.select("*", F.posexplode(names[F.col("metric")]).alias("at", "le"))
    upto = F.aggregate(F.filter("own", lambda x: x["place"] <= F.col("at")), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return each.select("metric", "tenant_id", "le", upto.alias("bucket_count"), "count", "sum")


# Quantiles: one sketch per tenant and hour.


def quantile_partials(value: str, at: str, keys: list[str] | None = None, k: int = SKETCH_K) -> Partial:
    def partial(rows: DataFrame) -> DataFrame:
        return rows.where(F.col(value).isNotNull()).groupBy(*(keys or ["tenant_id"]), _hour(at)).agg(
            F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))

    return partial


def merge_quantiles(partials: DataFrame, keys: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    return partials.groupBy(*(keys or ["tenant_id"]), "hour").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles_of(partials: DataFrame, ranks: dict[str, float], keys: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """Quantiles of the period that the partial rows cover, from the merged sketch."""
    merged = partials.groupBy(*(keys or ["tenant_id"])).agg(F.kll_merge_agg_double("sketch", k).alias("_s"))
    return merged.select(*(keys or ["tenant_id"]), F.kll_sketch_get_n_double("_s").alias("rows"),
                         *[F.kll_sketch_get_quantile_double("_s", F.lit(r)).alias(name) for name, r in ranks.items()])
