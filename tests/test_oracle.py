"""Every registered query against its DuckDB statement, and the shape of its plan."""

import pytest

import __spark_entry__ as entry_point
from check_oracle import compare
from emberwatch.plans import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
EAGER = {"semantic_novelty", "log_sink", "pipeline_alerts", "pipeline_incidents", "weekly_layout", "topic_logs", *[n for n in QUERIES if n.startswith(("stream_", "rollup_"))]}
TOP_K = ("recent_errors", "query_logs", "service_dependencies", "recent_logs", "investigations", "bm25_topk", "vector_topk")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, name):
    ok, line = compare(spark, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert ok, line


def test_only_approximate_results_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == {"vector_topk_ann", "rollup_percentiles"}


def test_registered():
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert {"tenant_id", "service", "bucket", "severity", "z_score"} <= set(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_plan_has_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in TOP_K:
        assert "WindowGroupLimit" in plan
