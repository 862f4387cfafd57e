"""Streams that wait for the watermark, over shuffled micro-batches and restarts, against the batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import anomaly, cache, investigate, routing
from emberwatch.streaming import flows, settled
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run_in_batches(spark, df, time, build, parts=4, seed=0, mix_s=0):
    """One availableNow run per slice, restarting from the checkpoint each time; rows are ``mix_s`` seconds out of order at
    most, and a tick ends the stream."""
    src, out, state = (flows.scratch(spark, n) for n in ("in", "out", "state"))
    rng = random.Random(seed)
    data = sorted(df.collect(), key=lambda r: r[time] + dt.timedelta(seconds=rng.uniform(0, mix_s)))
    slices = [data[i * len(data) // parts:(i + 1) * len(data) // parts] for i in range(parts)]
    for i, part in enumerate([*slices, []]):
        rng.shuffle(part)
        frame = spark.createDataFrame(part, df.schema)
        if i == parts:
            frame = settled.with_tick(frame, time)
        frame.coalesce(1).write.mode("append").parquet(src)
        stream = build(spark.readStream.schema(df.schema).parquet(src))
        query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    run_in_batches.last = query.lastProgress
    return spark.read.schema(stream.schema).parquet(out)


def state_rows():
    return sum(op["numRowsTotal"] for op in run_in_batches.last["stateOperators"])


def test_cache_lookup(spark):
    rng = random.Random(1)

    def vector():
        return [float(rng.choice([1, 2, 3])), float(rng.choice([0, 1, 2])), 1.0]

    entries = [("ab"[i % 2], i, vector(), None if i % 7 == 0 else f"r{i}", at(rng.randrange(40_000))) for i in range(60)]
    asked = [("abc"[i % 3], i, vector(), at(rng.randrange(45_000))) for i in range(80)]
    e = spark.createDataFrame(entries, "tenant_id string, entry_id long, embedding array<double>, rca_result string, created_at timestamp")
    q = spark.createDataFrame(asked, "tenant_id string, query_id long, embedding array<double>, asked_at timestamp")
    want = cache.cache_lookup(q, e, threshold=0.97, ttl_s=3600)
    events = e.select("tenant_id", F.col("created_at").alias("at"), F.lit(0).alias("kind"), F.col("entry_id").alias("id"),
                      F.col("rca_result").alias("result"), "embedding").unionByName(
        q.select("tenant_id", F.col("asked_at").alias("at"), F.lit(1).alias("kind"), F.col("query_id").alias("id"),
                 F.lit(None).cast("string").alias("result"), "embedding"))
    got = run_in_batches(spark, events, "at", lambda s: settled.cache_lookup_stream(s, threshold=0.97, ttl_s=3600), mix_s=500)
    columns = ["tenant_id", "query_id", "item_id", "similarity", "cache_hit", "rca_result"]
    assert sorted(map(str, rows(got.select(columns)))) == sorted(map(str, rows(want.select(columns))))
    assert 5 < got.where("cache_hit").count() < 80
    assert state_rows() == 0  # every bucket is over: nothing is left of the entries


def test_zscore_per_event(spark):
    rng = random.Random(2)
    logs, n = [], 0
    for service in "ab":
        for bucket in range(40):
            size = rng.randint(3, 6) + (30 if bucket in (20, 33) else 0)
            for _ in range(size):
                logs.append(("t", service, n, at(bucket * 60 + rng.randrange(60)), "ERROR" if rng.random() < (0.9 if bucket == 20 else 0.4) else "INFO"))
                n += 1
    df = spark.createDataFrame(logs, "tenant_id string, service string, log_id long, ts timestamp, level string")
    how = {"window_s": 1200, "bucket_s": 60}
    want = anomaly.zscore_per_event(df, **how)
    got = run_in_batches(spark, df, "ts", lambda s: settled.zscore_per_event_stream(s, **how), mix_s=300)
    columns = ["tenant_id", "service", "bucket", "metric", "log_id", "ts", "count_at_crossing", "z_score"]
    assert sorted(rows(got.select(columns))) == sorted(rows(want.select(columns))) and want.count() >= 4


def test_route_with_late_costs(spark):
    rng = random.Random(3)
    tenants = spark.createDataFrame([("a", "premium", 5.0), ("b", "standard", 2.0)], "tenant_id string, model_tier string, token_budget_usd_daily double")
    evals = spark.createDataFrame([("ab"[i % 2], f"e{i}", at(rng.randrange(200_000)), rng.choice([0.1, 0.333333333, None])) for i in range(80)],
                                  "tenant_id string, eval_id string, evaluated_at timestamp, cost_usd double")
    incidents = spark.createDataFrame([("abx"[i % 3], f"i{i}", at(rng.randrange(200_000)), rng.choice(["CRITICAL", "low", None])) for i in range(60)],
                                      "tenant_id string, incident_id string, created_at timestamp, severity string")
    want = routing.route(incidents, tenants, routing.spend_so_far(incidents, evals))
    events = settled.spend_events(incidents, evals)
    got = run_in_batches(spark, events, "at", lambda s: settled.route_stream(s, tenants), mix_s=400)
    columns = ["incident_id", "tenant_id", "severity", "model_id", "reason", "prompt_variant"]
    assert sorted(rows(got.select(columns))) == sorted(rows(want.select(columns)))
    assert {"budget_exceeded"} < {r.reason for r in want.collect()} and state_rows() == 0


def test_a_cost_later_than_the_watermark_counts_for_nothing(spark):
    tenants = spark.createDataFrame([("a", "standard", 1.0)], "tenant_id string, model_tier string, token_budget_usd_daily double")
    schema = "tenant_id string, at timestamp, kind int, id string, severity string, nano long"
    slices = [[("a", at(1000), 1, "i1", "LOW", 0), ("a", at(9000), 1, "i2", "LOW", 0)],
              [("a", at(9500), 0, "in time", None, 2 * 10**9), ("a", at(500), 0, "too late", None, 9 * 10**9), ("a", at(9600), 1, "i3", "LOW", 0)], []]
    src, out, state = (flows.scratch(spark, n) for n in ("in", "out", "state"))
    for i, part in enumerate(slices):
        frame = spark.createDataFrame(part, schema)
        (settled.with_tick(frame, "at") if i == 2 else frame).coalesce(1).write.mode("append").parquet(src)
        (settled.route_stream(spark.readStream.schema(schema).parquet(src), tenants, lateness="0 seconds").writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
    got = {r.incident_id: r.reason for r in spark.read.parquet(out).collect()}
    assert got == {"i1": "severity_LOW_tier_standard", "i2": "severity_LOW_tier_standard", "i3": "budget_exceeded"}


def test_steps_in_shuffled_batches(spark):
    rng = random.Random(4)
    data = []
    for r in range(12):
        last = rng.randint(2, 8)
        for n in range(1, last + 3):
            kind = "complete" if n == last and r % 4 else "step"
            data.append((f"r{r}", n, kind, at(r * 30 + rng.randrange(300))))
    df = spark.createDataFrame(data, "rca_id string, step_number long, step_type string, at timestamp")
    want = investigate.step_stream_filter(df).select("rca_id", "step_number", "step_type")
    got = run_in_batches(spark, df, "at", lambda s: settled.step_stream(s, idle_s=3600), parts=5, mix_s=300)
    assert sorted(rows(got)) == sorted(rows(want)) and want.count() < df.count()
    assert state_rows() == 0


def test_a_missing_step_holds_the_rest_until_the_end(spark):
    df = spark.createDataFrame([("r", n, "complete" if n == 5 else "step", at(n)) for n in (1, 2, 4, 5, 6)],
                               "rca_id string, step_number long, step_type string, at timestamp")
    got = run_in_batches(spark, df, "at", lambda s: settled.step_stream(s, idle_s=60), parts=2)
    assert [r.step_number for r in got.orderBy("step_number").collect()] == [1, 2, 4, 5]


def test_merged_detectors(spark):
    rng = random.Random(5)
    keys = "tenant_id string, service string, bucket long, at timestamp, anomaly_type string, severity string, confidence double, "
    stat = [("t", rng.choice("ab"), b, at(60 * b), "error_rate_spike", rng.choice(["LOW", "HIGH"]), 0.5, 4.0, 7.0, 2.0) for b in range(0, 40, 2)]
    sem = [("t", rng.choice("ab"), b, at(60 * b), "new_error_pattern", rng.choice(["MEDIUM", "CRITICAL"]), 0.7, 0.3, "near") for b in range(0, 40, 3)]
    s = spark.createDataFrame(stat, keys + "z_score double, current_value double, baseline_mean double")
    m = spark.createDataFrame(sem, keys + "similarity double, nearest_message string")
    want = anomaly.merge_detectors(s, m, ["tenant_id", "service", "bucket"])
    src = [flows.scratch(spark, n) for n in ("stat", "sem")]
    out, state = (flows.scratch(spark, n) for n in ("out", "state"))
    seen = []
    for i in range(4):
        for path, df, data in ((src[0], s, stat), (src[1], m, sem)):
            part = data[i * len(data) // 3:(i + 1) * len(data) // 3] if i < 3 else []
            frame = spark.createDataFrame(part, df.schema)
            (settled.with_tick(frame, "at") if i == 3 else frame).coalesce(1).write.mode("append").parquet(path)
        streams = [spark.readStream.schema(df.schema).parquet(path) for path, df in zip(src, (s, m))]
        merged = settled.merge_detectors_stream(*streams, ["tenant_id", "service", "bucket"], lateness="0 seconds")
        (merged.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
         .start().awaitTermination())
        seen.append(spark.read.schema(want.schema).parquet(out).count())
    got = spark.read.schema(want.schema).parquet(out)
    assert sorted(map(str, rows(got.select(want.columns)))) == sorted(map(str, rows(want)))
    assert 0 < seen[1] < seen[-1]  # single results come out as the watermark passes, not at the end only
    assert {"combined", "error_rate_spike", "new_error_pattern"} == {r.anomaly_type for r in got.collect()}


def test_results_of_timers_do_not_pass_through_the_driver(spark):
    tenants = spark.createDataFrame([("a", "standard", 1.0), ("b", "premium", 1.0)], "tenant_id string, model_tier string, token_budget_usd_daily double").coalesce(1)
    events = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("tenant_id"), F.timestamp_seconds(1704067200 + F.col("id") * 997).alias("at"),
        F.lit(1).alias("kind"), F.concat(F.lit("i"), "id").alias("id"), F.lit("LOW").alias("severity"), F.lit(0).cast("long").alias("nano"))
    routed = settled.route_stream(flows.as_stream(settled.with_tick(events, "at")), tenants)
    out = flows.scratch(spark, "routed")
    query = (routed.writeStream.format("parquet").option("path", out).option("checkpointLocation", flows.scratch(spark, "routed-state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    # The last micro-batch has no input, only timers: its results are written by the tasks that made them.
    files = spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 400 and len(files) > 1
