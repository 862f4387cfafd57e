import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberwatch.functions.scoring import distance_severity, zscore_severity
from emberwatch.operators import anomaly
from tests.conftest import rows

BASE = dt.datetime(2024, 1, 15, 10, 0, tzinfo=dt.timezone.utc)
LOG = "tenant_id string, service string, level string, ts timestamp, log_id long"


def logs(spark, counts, level="ERROR", tenant="t"):
    """``counts[i]`` events in the i-th minute; the last entry is the current minute."""
    data, n = [], 0
    for i, count in enumerate(counts):
        for j in range(count):
            data.append((tenant, "svc", level, BASE + dt.timedelta(seconds=60 * i + j), n))
            n += 1
    return spark.createDataFrame(data, LOG)


def detect(spark, counts, **kw):
    scored = anomaly.zscore(anomaly.bucket_counts(logs(spark, counts, **kw)))
    return anomaly.spike_priority(anomaly.zscore_anomalies(scored)).collect()


def test_spike_is_critical_and_error_wins(spark):
    (r,) = detect(spark, [1, 2, 3, 1, 2, 3, 1, 2, 20])
    assert (r.anomaly_type, r.severity, r.confidence, r.z_score) == ("error_rate_spike", "CRITICAL", 1.0, 23.2186)
    assert (r.current_value, r.baseline_mean, r.baseline_points) == (20.0, 1.875, 8)


def test_info_spike_is_volume(spark):
    (r,) = detect(spark, [1, 2, 3, 1, 2, 3, 1, 2, 20], level="INFO")
    assert r.anomaly_type == "volume_spike"


@pytest.mark.parametrize("counts", [[1, 2, 3, 2, 1, 3, 2, 1, 3], [2] * 11, [2, 2, 2, 2]])
def test_no_anomaly(spark, counts):
    assert detect(spark, counts) == []


def test_flat_baseline_has_no_zscore(spark):
    scored = anomaly.zscore(anomaly.bucket_counts(logs(spark, [2] * 8 + [50])))
    assert scored.where(F.col("z_score").isNotNull()).count() == 0


def test_event_crossing_is_the_first_over_threshold(spark):
    got = anomaly.zscore_per_event(logs(spark, [1, 2, 3, 1, 2, 3, 1, 2, 20])).where("metric = 'errors'").collect()
    # mean 1.875, population deviation 0.780625: the fifth error is the first above three deviations.
    assert [(r.count_at_crossing, r.z_score) for r in got] == [(5, 4.0032)]


def test_severity_bounds(spark):
    z = spark.createDataFrame([(3.1,), (3.9,), (4.0,), (5.0,), (7.0,)], "z double")
    assert [r[0] for r in z.select(zscore_severity(F.col("z"))).collect()] == ["LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    d = spark.createDataFrame([(0.3,), (0.31,), (0.5,), (0.7,), (0.71,)], "d double")
    assert [r[0] for r in d.select(distance_severity(F.col("d"))).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL"]


def test_cold_start_known_and_novel(spark):
    def unit(i):
        return [1.0 if j == i else 0.0 for j in range(4)]

    data = [("t", "a", 1, BASE, unit(0)), ("t", "a", 2, BASE, unit(0)), ("t", "a", 3, BASE, unit(1)),
            ("t", "a", 4, BASE, unit(1)), ("t", "b", 5, BASE, unit(0)), ("u", "a", 6, BASE, unit(2))]
    df = spark.createDataFrame(data, "tenant_id string, service string, id long, ts timestamp, embedding array<float>")
    got = anomaly.semantic_novelty(df)
    assert rows(got.select("id", "distance")) == [(3, 1.0)]


def test_merge_prefers_statistical_on_ties_and_takes_max_confidence(spark):
    stat = spark.createDataFrame([(1, "error_rate_spike", "HIGH", 0.4, 6.0, 9.0, 2.0), (2, "volume_spike", "LOW", 0.1, 3.2, 9.0, 2.0)],
                                 "k int, anomaly_type string, severity string, confidence double, z_score double, current_value double, baseline_mean double")
    sem = spark.createDataFrame([(1, "new_error_pattern", "HIGH", 0.6, 0.4, "x"), (3, "new_error_pattern", "MEDIUM", 0.35, 0.65, "")],
                                "k int, anomaly_type string, severity string, confidence double, similarity double, nearest_message string")
    got = {r.k: r for r in anomaly.anomaly_description(anomaly.merge_detectors(stat, sem, ["k"])).collect()}
    assert (got[1].anomaly_type, got[1].severity, got[1].confidence, got[1].wire_type) == ("combined", "HIGH", 0.6, "combined")
    assert got[2].wire_type == "statistical" and got[3].wire_type == "semantic"
    assert got[3].description == "Novel error pattern detected: similarity=0.65 below threshold=0.7"
    assert got[1].description == "Multiple anomaly signals: statistical Z-score=6.0, semantic similarity=0.4"


def test_verdicts(spark):
    cand = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "alert_id string")
    verdicts = spark.createDataFrame([("a", " yes - real"), ("b", "NO"), ("c", "maybe yes")], "alert_id string, verdict string")
    assert {r[0] for r in rows(anomaly.verdict_filter(cand, verdicts))} == {"a", "d"}


def evict_one_by_one(ids, max_size, batch):
    stored = []
    for i in ids:
        stored.append(i)
        if len(stored) > max_size:
            stored = stored[batch:]
    return stored


def test_eviction(spark):
    sizes = {"small": 10, "one": 11, "edge": 13, "next": 14, "big": 250}
    df = spark.createDataFrame([(t, i, BASE + dt.timedelta(seconds=i // 3)) for t, n in sizes.items() for i in range(n)],
                               "tenant_id string, id int, ts timestamp")
    for chunk in (5, 3600):
        left = anomaly.evict_oldest(df, max_size=10, batch=3, chunk_s=chunk)
        assert sorted(rows(left.select("tenant_id", "id"))) == sorted(
            (t, i) for t, n in sizes.items() for i in evict_one_by_one(range(n), 10, 3))


def test_every_error_log_of_the_chain_has_a_vector(spark):
    """1,200 vectors with gaps between their ids: all of them enter, and no error log is dropped."""
    from types import SimpleNamespace

    from emberwatch.plans.chain import log_vectors

    embeddings = spark.range(1200).selectExpr("id * 3 AS vec_id", "array(cast(id AS float)) AS embedding")
    logs = spark.range(3000).selectExpr("id AS log_id", "'t' AS tenant_id", "'s' AS service", "'ERROR' AS level", "timestamp_seconds(id) AS ts")
    got = {r.id: r.embedding[0] for r in log_vectors(SimpleNamespace(spark=spark, embeddings=embeddings), logs).collect()}
    assert got == {i: float(i % 1200) for i in range(3000)}


def test_description_has_plain_numbers(spark):
    """Numbers as in the rule's own text: no exponent below 0.001 or from 1e7 on."""
    df = spark.createDataFrame([("new_error_pattern", None, None, None, 0.0004, "m"), ("error_rate_spike", 3.5, 12345678.0, 0.0123, None, None)],
                               "anomaly_type string, z_score double, current_value double, baseline_mean double, similarity double, nearest_message string"
                               ).withColumns({"severity": F.lit("LOW"), "confidence": F.lit(0.5)})
    got = {r.anomaly_type: r.description for r in anomaly.anomaly_description(df).collect()}
    assert "similarity=0.0004 below" in got["new_error_pattern"]
    assert "Z-score=3.5, current=12345678.0 errors/bucket vs baseline mean=0.0123" in got["error_rate_spike"]
