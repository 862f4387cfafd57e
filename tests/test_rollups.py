"""Rollups after several micro-batches, a replay and compaction against aggregates of all rows."""

import datetime as dt
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.operators import evaluate, metrics
from emberwatch.streaming import flows, rollups
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def in_batches(spark, df, partial, parts=3, replay=True):
    """Path of the rollup after a run per part, the last one run twice: its commit is lost in between."""
    src, path, state = (flows.scratch(spark, n) for n in ("in", "rollup", "state"))
    data = df.collect()

    def run():
        stream = spark.readStream.schema(df.schema).parquet(src)
        rollups.rollup_sink(stream, partial, path, state, trigger={"availableNow": True}).awaitTermination()

    for i in range(parts):
        part = data[i * len(data) // parts:(i + 1) * len(data) // parts]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(src)
        run()
    folders = {n for n in os.listdir(path.removeprefix("file:")) if n.startswith("batch=")}
    if replay:
        commits = f"{state.removeprefix('file:')}/commits"
        last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
        for name in (last, f".{last}.crc"):
            if os.path.exists(f"{commits}/{name}"):
                shutil.move(f"{commits}/{name}", f"{commits}/../{name}-lost")
        run()
    assert len(folders) == parts and folders == {n for n in os.listdir(path.removeprefix("file:")) if n.startswith("batch=")}
    return path


@pytest.fixture(scope="module")
def evals(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), f"e{i}", at(rng.uniform(0, 50)), rng.choice([None, 0.5, 0.71, 0.9]), rng.choice([0.6, 0.8]),
             rng.choice(["ground_truth", "similarity", "heuristic"]), rng.choice([None, 0.001, 0.25])) for i in range(300)]
    return spark.createDataFrame(data, "tenant_id string, eval_id string, evaluated_at timestamp, faithfulness_score double, "
                                       "hallucination_score double, eval_mode string, cost_usd double")


def test_evaluations(spark, evals):
    tenants = spark.createDataFrame([("a",), ("b",), ("none",)], "tenant_id string")
    path = in_batches(spark, evals, rollups.eval_partials)
    partials = rollups.read_partials(spark, path)
    want = evaluate.eval_summary(evals, tenants)
    assert sorted(rows(rollups.eval_summary_of(partials, tenants).select(want.columns))) == sorted(rows(want))
    seen = {r.tenant_id: (r.passed, r.seen) for r in rollups.pass_rate_of(partials).collect()}
    last = evals.groupBy("tenant_id").agg(F.count_if(evaluate.is_passed()).alias("p"), F.count("*").alias("n")).collect()
    assert seen == {r.tenant_id: (r.p, r.n) for r in last}
    # A period of whole hours.
    some = rollups.read_partials(spark, path, start="2024-01-01 10:00:00", end="2024-01-02 00:00:00")
    part = evals.where("evaluated_at >= '2024-01-01 10:00:00' AND evaluated_at < '2024-01-02 00:00:00'")
    assert sorted(rows(rollups.eval_summary_of(some, tenants).select(want.columns))) == sorted(rows(evaluate.eval_summary(part, tenants)))
    # Compacted, with a later batch beside it.
    out = flows.scratch(spark, "compact")
    rollups.compact(spark, path, out, rollups.merge_evals)
    rollups.eval_partials(evals).write.parquet(f"{out}/batch=7")
    twice = rollups.pass_rate_of(rollups.read_partials(spark, out)).collect()
    assert {r.tenant_id: (r.passed, r.seen) for r in twice} == {t: (2 * p, 2 * n) for t, (p, n) in seen.items()}


def test_counters(spark):
    rng = random.Random(2)
    data = [(rng.choice(["m", "n"]), rng.choice(["x", None]), rng.choice("ab"), at(rng.uniform(0, 9)), rng.randrange(5)) for _ in range(200)]
    df = spark.createDataFrame(data, "metric string, label string, tenant_id string, at timestamp, value long")
    path = in_batches(spark, df, rollups.counter_partials)
    want = metrics.metric_counters(df, ["metric", "label", "tenant_id"], value="value")
    got = rollups.counters_of(rollups.read_partials(spark, path))
    assert sorted(map(str, rows(got.select(want.columns)))) == sorted(map(str, rows(want)))
    assert rollups.merge_counters(rollups.read_partials(spark, path)).agg(F.sum("value")).first()[0] == sum(r[4] for r in data)


def test_histograms(spark):
    rng = random.Random(3)
    bounds = {"s": metrics.SCORES, "t": metrics.TOOL_SECONDS}
    data = [(rng.choice("st"), rng.choice("ab"), at(rng.uniform(0, 9)), rng.choice([None, 0.0, 0.1, 0.7, 0.75, 1.0, 3.0, 99.0])) for _ in range(300)]
    df = spark.createDataFrame(data, "metric string, tenant_id string, at timestamp, value double")
    path = in_batches(spark, df, rollups.histogram_partials(bounds))
    columns = ["metric", "tenant_id", "le", "bucket_count", "count", "sum"]
    got = rollups.histograms_of(rollups.read_partials(spark, path), bounds).withColumn("sum", F.round("sum", 6))
    want = []
    for m, own in bounds.items():
        one = metrics.latency_histogram(df.where(F.col("metric") == m), F.col("value"), ["tenant_id"], own, positive_only=False)
        want += rows(one.withColumn("metric", F.lit(m)).withColumn("sum", F.round("sum", 6)).select(columns))
    assert sorted(rows(got.select(columns))) == sorted(want) and len(want) == 2 * (12 + 9)


def test_quantiles_of_any_period(spark):
    """Merged sketches are within the stated rank error, and a sketch's size is bounded."""
    rng = np.random.default_rng(4)
    values = np.exp(rng.normal(5, 1, 60_000)).round(2)
    hours = rng.integers(0, 24, len(values))
    df = spark.createDataFrame([("a" if i % 3 else "b", at(int(h)), float(v)) for i, (h, v) in enumerate(zip(hours, values))],
                               "tenant_id string, created_at timestamp, ms double")
    path = in_batches(spark, df, rollups.quantile_partials("ms", "created_at"))
    for lo, hi in ((0, 24), (3, 4), (10, 20)):
        part = rollups.read_partials(spark, path, start=f"2024-01-01 {lo:02d}:00:00", end=f"2024-01-0{1 + hi // 24} {hi % 24:02d}:00:00")
        got = {r.tenant_id: r for r in rollups.quantiles_of(part, {"p50": 0.5, "p95": 0.95}).collect()}
        for tenant in "ab":
            own = np.sort(values[(hours >= lo) & (hours < hi) & ((np.arange(len(values)) % 3 > 0) == (tenant == "a"))])
            assert got[tenant].rows == len(own)
            for name, rank in (("p50", 0.5), ("p95", 0.95)):
                place = np.searchsorted(own, got[tenant][name], side="right") / len(own)
                assert abs(place - rank) <= 0.005 + 1 / len(own)
    merged = rollups.merge_quantiles(rollups.read_partials(spark, path).withColumn("hour", F.lit(T0)))
    assert merged.agg(F.max(F.length("sketch"))).first()[0] < 40_000


def test_run_folder_can_be_dropped(spark):
    from emberwatch.session import clear_run, run_dir, saved

    kept = saved(spark.range(5), "five")
    assert kept.count() == 5 and os.path.isdir(run_dir(spark).removeprefix("file:"))
    assert clear_run(spark) and not os.path.isdir(run_dir(spark).removeprefix("file:"))
    assert saved(spark.range(3), "three").count() == 3
