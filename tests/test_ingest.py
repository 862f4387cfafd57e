import datetime as dt
import json

from pyspark.sql import functions as F

from emberwatch.operators import ingest
from emberwatch.schemas import REQUIRED_FIELDS
from emberwatch.sources.tables import read_weekly, week_label, week_start, write_weekly
from tests.conftest import rows

NOW = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
GOOD = {"service": "api", "level": "INFO", "message": "hi", "trace_id": "x", "timestamp": "2024-01-15T10:23:45.123456789Z",
        "metadata": {"tenant_id": "t1"}}


def raw(spark, *records):
    data = [(i, NOW, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(data, "raw_id int, received_at timestamp, value string")


def test_parse_validate_enrich(spark):
    df = raw(spark, GOOD, {**GOOD, "level": "info"}, {**GOOD, "service": ""}, {"message": "x"}, '{"service": "api"',
             {**GOOD, "timestamp": "soon", "metadata": None, "trace_id": ""}, {**GOOD, "timestamp": "2024-01-15T12:23:45+02:00"})
    parsed = ingest.log_parse(df)
    assert parsed.count() == 6  # the broken JSON is gone
    ts = {r.raw_id: r.ts.isoformat() for r in parsed.select("raw_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("s"), "ts").collect()}
    ok, bad = ingest.log_validate(parsed)
    assert {(r.raw_id, r.reject_reason) for r in bad.collect()} == {
        (1, "level is not valid"), (2, "service is required"), (3, "service is required")}
    text = {r.raw_id: r.s for r in parsed.select("raw_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("s")).collect()}
    assert text[0] == "2024-01-15 10:23:45.123456" and text[5].startswith("2024-05-01") and text[6].startswith("2024-01-15 10:23:45")
    assert len(ts) == 6
    rich = {r.raw_id: r for r in ingest.tenant_extract(ingest.log_enrich(ok, now=F.lit(NOW))).collect()}
    assert rich[0].tenant_id == "t1" and rich[0].trace_id == "x"
    assert rich[5].tenant_id == "unknown" and rich[5].trace_id.startswith("gen-") and rich[5].metadata == {}


def test_required_fields_checks_presence_not_value(spark):
    df = raw(spark, {f: None for f in REQUIRED_FIELDS["alerts"]}, {"alert_id": "a", "tenant_id": "t"}, "nonsense")
    ok, bad = ingest.required_fields(df, REQUIRED_FIELDS["alerts"])
    assert rows(ok.select("raw_id")) == [(0,)]
    assert {r.raw_id: r.missing for r in bad.collect()} == {
        1: ["service", "anomaly_type", "severity"], 2: REQUIRED_FIELDS["alerts"]}


def test_dead_letter_keeps_the_payload_unless_told(spark):
    df = raw(spark, "x" * 6000).withColumn("why", F.lit("bad"))
    assert len(ingest.dead_letter(df, topic="logs.raw", reason="why", payload="value", seen="received_at").first().original_payload) == 6000
    r = ingest.dead_letter(df, topic="logs.raw", reason="why", payload="value", seen="received_at", max_chars=5000).first()
    assert (r.original_topic, r.failure_reason, len(r.original_payload)) == ("logs.raw", "bad", 5000)


def test_dedup_is_local_to_the_batch(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, ""), (4, 1, ""), (5, 2, "a"), (6, 2, None)],
                               "log_id int, batch int, trace_id string")
    got = ingest.batch_dedup_trace(df, batch="batch", order="log_id")
    assert {r.log_id for r in got.collect()} == {1, 3, 4, 5, 6}


def test_upsert_and_partial_update(spark):
    base = spark.createDataFrame([("a", 1, "old", 10), ("b", 1, "keep", 10)], "id string, seq int, v string, created_at int")
    new = spark.createDataFrame([("a", 3, "new", 30), ("a", 2, "mid", 20), ("c", 1, "add", 5)], base.schema)
    got = {r.id: (r.v, r.created_at) for r in ingest.upsert_latest(base, new, ["id"], seq="seq").collect()}
    assert got == {"a": ("new", 10), "b": ("keep", 10), "c": ("add", 5)}
    got = {r.id: r.v for r in ingest.upsert_latest(base, new, ["id"], seq="seq", do_nothing=True).collect()}
    assert got == {"a": "old", "b": "keep", "c": "add"}
    upd = spark.createDataFrame([("a", "x"), ("zzz", "y")], "id string, v string")
    assert {r.id: r.v for r in ingest.update_by_key(base, upd, ["id"], ["v"]).collect()} == {"a": "x", "b": "keep"}


def test_alert_label_rules(spark):
    alerts = spark.createDataFrame([("a", "t", None), ("b", "t", "was"), ("c", "t", None)], "alert_id string, tenant_id string, ground_truth string")
    labels = spark.createDataFrame([("a", "t", "  long enough text\n", 1), ("b", "t", "short", 1), ("c", "other", "long enough text", 1)],
                                   "alert_id string, tenant_id string, label string, seq int")
    assert {r.alert_id: r.ground_truth for r in ingest.alert_label(alerts, labels).collect()} == {
        "a": "long enough text", "b": "was", "c": None}


def test_sink_rows_and_tenants(spark):
    uid = "3f2b8c1e-9a4d-4c6b-8e2f-0123456789ab"
    df = spark.createDataFrame([(uid, uid, None), ("nope", "bad", {"k": "v"})], "tenant_id string, trace_id string, metadata map<string,string>")
    got = ingest.sink_rows(df).collect()
    assert [(r.trace_id, r.metadata) for r in got] == [(uid, {}), (None, {"k": "v"})]
    assert rows(ingest.bad_tenants(df).select("tenant_id")) == [("nope",)]


def test_weekly_layout_prunes(spark, tmp_path):
    days = [dt.datetime(2024, 12, 28, tzinfo=dt.timezone.utc) + dt.timedelta(days=i) for i in range(10)]
    df = spark.createDataFrame([(i, "t", d, "{}") for i, d in enumerate(days)], "log_id int, tenant_id string, ts timestamp, metadata string")
    labels = {r[0]: r[1] for r in df.select(week_start(F.col("ts")).cast("string"), week_label(F.col("ts"))).distinct().collect()}
    assert labels == {"2024-12-23": "logs_y2024_w52", "2024-12-30": "logs_y2025_w01", "2025-01-06": "logs_y2025_w02"}
    write_weekly(df, str(tmp_path / "logs"), parts=4)
    got = read_weekly(spark, str(tmp_path / "logs"), start="2024-12-31 00:00:00", end="2025-01-02 00:00:00")
    assert sorted(r.log_id for r in got.collect()) == [3, 4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week" in plan and "GreaterThanOrEqual(ts" in plan


def test_tasks_are_kept_small_unless_set(spark):
    from emberwatch.session import ADVISORY, prepare

    other = spark.newSession()
    assert prepare(other).conf.get(ADVISORY) == "16MB"
    other.conf.set(ADVISORY, "8MB")
    assert prepare(other).conf.get(ADVISORY) == "8MB"


def test_lines_of_orders_are_dealt_by_their_number(spark, monkeypatch):
    from emberwatch.plans import fixtures, registry

    folder = "/root/testdata/sf0.001"
    names = ["eval_summary", "investigations", "rca_insert_once", "rca_upsert"]
    want = {n: sorted(rows(registry.queries()[n](spark, folder))) for n in names}
    monkeypatch.setattr(fixtures, "LINES_PER_TASK", 500)
    other = spark.newSession()
    for broadcast in ("-1", "10MB"):
        other.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        tasks = rows(fixtures.Tables(other, folder).lines.groupBy(F.spark_partition_id()).count())
        assert len(tasks) >= 12 and max(n for _, n in tasks) < 1000
        for n in names:
            assert sorted(rows(registry.queries()[n](other, folder))) == want[n]
