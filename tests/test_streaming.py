"""Several micro-batches, restarts and late rows: the streaming forms equal the batch forms."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from emberwatch.operators import anomaly, correlate
from emberwatch.sources.topics import read_topic, to_messages, write_topic
from emberwatch.streaming import flows, stateful
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def feed(spark, path, df, parts, order):
    """Yield after writing each time slice of ``df`` as one more file."""
    n = df.count()
    ordered = df.orderBy(*order).collect()
    for i in range(parts):
        part = ordered[i * n // parts:(i + 1) * n // parts]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
        yield


def run_in_batches(spark, df, build, order, parts=4):
    """One availableNow run per slice, restarting from the checkpoint each time."""
    src, out, state = (flows.scratch(spark, n) for n in ("in", "out", "state"))
    for _ in feed(spark, src, df, parts, order):
        stream = build(spark.readStream.schema(df.schema).parquet(src))
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


def timeline(spark, seed, n=160):
    rng = random.Random(seed)
    t, data = 0, []
    for i in range(n):
        t += rng.choice([1, 5, 30, 61, 100])
        data.append((rng.choice("xy"), f"a{i:04d}", rng.choice("abc"), rng.choice(["LOW", "HIGH"]), T0 + dt.timedelta(seconds=t)))
    return spark.createDataFrame(data, "tenant_id string, alert_id string, service string, severity string, created_at timestamp")


def test_correlation_over_batches(spark):
    df = timeline(spark, 1)
    got = run_in_batches(spark, df, lambda s: stateful.correlate_stream(s, window_s=60), ["created_at"])
    cols = ["incident_id", "tenant_id", "is_cascade", "at", "alert_id", "service", "severity", "created_at"]
    assert set(rows(got.select(*cols))) == set(rows(correlate.correlate(df, window_s=60).select(*cols)))


def test_cooldown_over_batches(spark):
    df = timeline(spark, 2).select("tenant_id", "service", F.col("alert_id").alias("id"), F.col("created_at").alias("ts"))
    got = run_in_batches(spark, df, lambda s: stateful.cooldown_stream(s, cooldown_s=60), ["ts"])
    assert sorted(rows(got)) == sorted(rows(anomaly.alert_cooldown(df, cooldown_s=60).select("tenant_id", "service", "id", "ts")))


def test_novelty_over_batches_and_eviction(spark):
    rng = random.Random(3)
    data = [("t", rng.choice("ab"), i, T0 + dt.timedelta(seconds=i), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(data, "tenant_id string, service string, id long, ts timestamp, embedding array<float>")
    got = run_in_batches(spark, df, lambda s: stateful.novelty_stream(s), ["ts"], parts=3)
    want = {r.id: round(r.similarity, 6) for r in anomaly.semantic_novelty(df).collect()}
    assert {r.id: round(r.similarity, 6) for r in got.collect()} == want
    small = run_in_batches(spark, df, lambda s: stateful.novelty_stream(s, max_size=5, evict=4), ["ts"], parts=2)
    assert small.count() > len(want)  # forgotten patterns become novel again


def test_zscore_over_batches(spark):
    rng = random.Random(8)
    data = [(rng.choice("tu"), "s", 60 * b, rng.choice([0, 0, 1, 4]), rng.randint(1, 9)) for b in sorted(rng.sample(range(200), 120))]
    df = spark.createDataFrame(data, "tenant_id string, service string, bucket long, errors long, volume long")
    got = run_in_batches(spark, df, lambda s: stateful.zscore_stream(s, window_s=1200, bucket_s=60), ["bucket"])
    want = anomaly.zscore(df, window_s=1200, bucket_s=60)

    def plain(x):
        return {(r.tenant_id, r.bucket, r.metric): (r.current_value, r.baseline_points, *(None if v is None else round(v, 9) for v in (
            r.baseline_mean, r.baseline_std, r.z_score))) for r in x.collect()}

    assert plain(got) == plain(want) and got.count() == want.count() > 120


def test_correlator_keeps_no_more_than_the_window(spark):
    """One service floods a window, then another service makes one cascade of all of it."""
    n = 4000
    df = spark.range(n).select(F.lit("t").alias("tenant_id"), F.format_string("a%05d", "id").alias("alert_id"), F.lit("x").alias("service"),
                               F.lit("LOW").alias("severity"), F.timestamp_millis(F.col("id") * 10).alias("created_at"))
    last = spark.createDataFrame([("t", "b", "y", "LOW", dt.datetime.fromtimestamp(n / 100, dt.timezone.utc))], df.schema)
    got = run_in_batches(spark, df.unionByName(last), lambda s: stateful.correlate_stream(s, window_s=60), ["created_at"], parts=2)
    assert got.where("is_cascade").count() == n + 1 and got.where("NOT is_cascade").count() == n


def test_buckets_close_with_the_watermark(spark):
    data = [("t", "s", "ERROR" if i % 3 else "INFO", T0 + dt.timedelta(seconds=10 * i), i) for i in range(60)]
    df = spark.createDataFrame(data, "tenant_id string, service string, level string, ts timestamp, log_id long")
    got = flows.run_to_table(flows.bucket_counts_stream(flows.as_stream(df), lateness="0 seconds"))
    batch = anomaly.bucket_counts(df).where(F.col("bucket") + 60 <= int(T0.timestamp()) + 590)
    cols = ["tenant_id", "service", "bucket", "errors", "volume"]
    assert sorted(rows(got.select(*cols))) == sorted(rows(batch.select(*cols))) and got.count() == 9


def test_log_sink_writes_each_row_once_on_replay(spark):
    df = spark.range(20).select(F.col("id").alias("log_id"), F.lit("t").alias("tenant_id"), F.lit("bad-trace").alias("trace_id"),
                                F.timestamp_seconds(F.col("id") * 200_000).alias("ts"), F.lit(None).cast("map<string,string>").alias("metadata"))
    src, out = flows.scratch(spark, "src"), flows.scratch(spark, "out")
    df.write.parquet(src)
    for _ in range(2):  # the second run has lost its checkpoint and sees the batch again
        stream = spark.readStream.schema(df.schema).parquet(src)
        flows.log_sink(stream, out, flows.scratch(spark, "cp"), trigger={"availableNow": True}).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 20 and got.where("trace_id IS NOT NULL").count() == 0
    assert "week" in got.columns


def test_log_sink_sends_bad_batches_to_dead_letters(spark):
    uid = "3f2b8c1e-9a4d-4c6b-8e2f-0123456789ab"
    df = spark.createDataFrame([(1, uid, uid, T0), (2, "nope", uid, T0)], "log_id int, tenant_id string, trace_id string, ts timestamp"
                               ).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    for rows_in, stored, dead in ((df, 0, 2), (df.where("log_id = 1"), 1, 0)):
        out, bad = flows.scratch(spark, "out"), flows.scratch(spark, "dead")
        flows.log_sink(flows.as_stream(rows_in), out, flows.scratch(spark, "cp"), trigger={"availableNow": True},
                       dead_letters=bad, dedup_traces=True).awaitTermination()
        for path, n in ((out, stored), (bad, dead)):
            if n:
                assert spark.read.parquet(path).count() == n
            else:
                assert not os.path.exists(path.removeprefix("file:"))


def test_log_sink_drops_repeats_before_bad_traces_become_null(spark):
    df = spark.createDataFrame([(1, "t", "same", T0), (2, "t", "same", T0), (3, "t", "other", T0), (4, "t", None, T0), (5, "t", None, T0)],
                               "log_id int, tenant_id string, trace_id string, ts timestamp").withColumn("metadata", F.lit(None).cast("map<string,string>"))
    out = flows.scratch(spark, "out")
    flows.log_sink(flows.as_stream(df), out, flows.scratch(spark, "cp"), trigger={"availableNow": True}, dedup_traces=True).awaitTermination()
    assert {r.log_id for r in spark.read.parquet(out).collect()} == {1, 3, 4, 5}


def test_dead_letters_keep_long_rows_whole(spark):
    df = spark.createDataFrame([(1, "nope", "x" * 9000, T0)], "log_id int, tenant_id string, message string, ts timestamp").withColumns(
        {"trace_id": F.lit("a"), "metadata": F.lit(None).cast("map<string,string>")})
    bad = flows.scratch(spark, "dead")
    flows.log_sink(flows.as_stream(df), flows.scratch(spark, "out"), flows.scratch(spark, "cp"), trigger={"availableNow": True},
                   dead_letters=bad).awaitTermination()
    kept = spark.read.parquet(bad).select(F.get_json_object("original_payload", "$.message").alias("m")).first().m
    assert kept == "x" * 9000


def test_change_log_merges_on_read(spark):
    df = spark.createDataFrame([("a", 1, "old", T0), ("a", 2, "new", T0 + dt.timedelta(1)), ("b", 1, "only", T0)],
                               "id string, seq int, v string, created_at timestamp")
    path = flows.scratch(spark, "log")
    flows.change_log_sink(flows.as_stream(df), path, flows.scratch(spark, "cp"), trigger={"availableNow": True}).awaitTermination()
    got = {r.id: (r.v, r.created_at) for r in flows.read_current(spark, path, ["id"], seq="seq").collect()}
    assert got["a"][0] == "new" and got["b"][0] == "only"
    assert got["a"][1] == got["b"][1]  # creation time of the first version stays
    snapshot = flows.scratch(spark, "snapshot")
    flows.compact_changes(spark, path, snapshot, ["id"], seq="seq")
    spark.createDataFrame([("b", 2, "newer", T0 + dt.timedelta(2))], df.schema).write.parquet(f"{snapshot}/batch=0")
    later = {r.id: (r.v, r.created_at) for r in flows.read_current(spark, snapshot, ["id"], seq="seq").collect()}
    assert later == {"a": ("new", got["a"][1]), "b": ("newer", got["b"][1])}


def test_topics_by_files(spark):
    base, cp = flows.scratch(spark, "topics"), flows.scratch(spark, "cp")
    df = spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, x int")
    write_topic(to_messages(flows.as_stream(df)), topic="alerts", checkpoint=cp, path=base, available_now=True).awaitTermination()
    got = flows.run_to_table(read_topic(spark, topic="alerts", path=base))
    assert sorted(rows(got.select("key", F.get_json_object("value", "$.x")))) == [("t1", "1"), ("t2", "2")]
