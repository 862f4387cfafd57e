"""Ordered operators against straightforward one-row-at-a-time folds, with chunk borders everywhere."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.operators import anomaly, correlate, evaluate
from emberwatch.operators.ordered import running, with_chunk
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def sequences(n_keys, seed, max_len=60, mean_gap=20, services="abc"):
    """Random timelines per tenant; many equal times, gaps around the window."""
    rng = random.Random(seed)
    out = []
    for k in range(n_keys):
        t, gap = 0, rng.choice([1, 5, mean_gap, 4 * mean_gap])
        for i in range(rng.randint(1, max_len)):
            t += rng.choice([0, rng.randint(0, gap), gap, 60])
            out.append((f"t{k}", f"{i:05d}", rng.choice(services[:rng.randint(1, len(services))]),
                        rng.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL"]), t))
    return out


def brute_correlate(seq, window):
    by, out = {}, set()
    for tenant, aid, svc, _sev, t in sorted(seq, key=lambda r: (r[0], r[4], r[1])):
        win = [a for a in by.get(tenant, []) if a[2] >= t - window] + [(aid, svc, t)]
        if len({a[1] for a in win}) > 1:
            out |= {(tenant, True, aid, m[0]) for m in win}
            win = []
        else:
            out.add((tenant, False, aid, aid))
        by[tenant] = win
    return out


@pytest.mark.parametrize("chunk_s", [1, 60, 100_000])
def test_correlate_equals_fold(spark, chunk_s):
    seq = sequences(150, seed=chunk_s)
    df = spark.createDataFrame([(a, b, c, d, at(t)) for a, b, c, d, t in seq],
                               "tenant_id string, alert_id string, service string, severity string, created_at timestamp")
    got = correlate.correlate(df, window_s=60, chunk_s=chunk_s)
    trigger = {r[0]: r for r in rows(got.select("incident_id", "tenant_id", "is_cascade").distinct())}
    members = {}
    for inc, alert in rows(got.select("incident_id", "alert_id")):
        members.setdefault(inc, []).append(alert)
    got_set = {(trigger[i][1], trigger[i][2], max(m), a) for i, m in members.items() for a in m}
    assert got_set == brute_correlate(seq, 60)


@pytest.mark.parametrize("chunk_s", [60, 90, 100_000])
def test_cooldown_equals_fold(spark, chunk_s):
    seq = sequences(150, seed=7 + chunk_s)
    df = spark.createDataFrame([(a, c, b, at(t)) for a, b, c, _d, t in seq],
                               "tenant_id string, service string, id string, ts timestamp")
    last, want = {}, set()
    for tenant, aid, svc, _sev, t in sorted(seq, key=lambda r: (r[4], r[1])):
        if (tenant, svc) not in last or t - last[tenant, svc] >= 60:
            last[tenant, svc] = t
            want.add((tenant, svc, aid))
    got = anomaly.alert_cooldown(df, cooldown_s=60, chunk_s=chunk_s)
    assert {r[:3] for r in rows(got)} == want


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_novelty_equals_fold(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    centres = rng.standard_normal((6, 8))
    data = []
    for k in range(3):
        for i in range(25 if k else 40):
            v = centres[rng.integers(6)] + 0.35 * rng.standard_normal(8)
            data.append((f"t{k % 2}", f"s{k}", i, at(int(i // 2)), [float(x) for x in v]))
    df = spark.createDataFrame(data, "tenant_id string, service string, id long, ts timestamp, embedding array<float>")
    stored, want = {}, {}
    for tenant, svc, i, _t, v in sorted(data, key=lambda r: (r[3], r[2])):
        v = np.array(v, dtype="float32").astype("float64")
        v /= np.linalg.norm(v)
        near = stored.setdefault((tenant, svc), [])
        best = max((round(float(v @ u), 9) for u in near), default=None)
        if best is None or best < 0.7:
            near.append(v)
            if best is not None:
                want[tenant, svc, i] = round(best, 6)
    got = anomaly.semantic_novelty(df, threshold=0.7, block_rows=block_rows)
    assert {(r.tenant_id, r.service, r.id): round(r.similarity, 6) for r in got.collect()} == want
    assert want


def test_hot_key_results_do_not_depend_on_chunks(spark):
    """One tenant holds nearly all rows."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("tenant_id"),
        F.format_string("%08d", "id").alias("alert_id"), F.concat(F.lit("s"), (F.col("id") * 7919 % 3).cast("string")).alias("service"),
        F.lit("LOW").alias("severity"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 13 % 90_000).alias("created_at"))
    a, b = (correlate.correlate(df, window_s=5, chunk_s=c).agg(
        F.count("*"), F.count_if("is_cascade"), F.sum(F.hash("incident_id", "alert_id").cast("long"))).first()
        for c in (60, 1_000_000))
    assert a == b and a[1] > 0


def test_running_aggregates_cross_chunks(spark):
    df = spark.createDataFrame([("k", i, at(i * 7), i % 3 if i % 4 else None) for i in range(40)],
                               "key string, id int, ts timestamp, x int")
    got = running(with_chunk(df, F.col("ts"), 20), ["key"], ["ts", "id"],
                  {"s": ("sum", "x"), "n": ("count", "x"), "m": ("max", "x")}).orderBy("id").collect()
    xs = [i % 3 if i % 4 else None for i in range(40)]
    for i, r in enumerate(got):
        seen = [x for x in xs[:i + 1] if x is not None]
        assert (r.s, r.n, r.m) == ((sum(seen), len(seen), max(seen)) if seen else (None, 0, None))


def test_running_pass_rate(spark):
    data = [("t", f"e{i:03d}", at(i * 1000), 0.9 if i % 3 else 0.7, 0.8) for i in range(30)]
    df = spark.createDataFrame(data, "tenant_id string, eval_id string, evaluated_at timestamp, "
                                     "faithfulness_score double, hallucination_score double")
    got = evaluate.running_pass_rate(df, chunk_s=3000).orderBy("eval_id").collect()
    ok = 0
    for i, r in enumerate(got):
        ok += bool(i % 3)
        assert r.pass_rate == pytest.approx(ok / (i + 1))
