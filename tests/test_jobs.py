import json

import pytest
from pyspark.sql import functions as F

from logkeep.functions.patterns import TopicSelector
from logkeep.operators import catalog, status
from logkeep.plans.jobs import BackupJob, RestoreJob
from logkeep.sources import kafka
from logkeep.sources.storage import Storage

CLUSTER = kafka.Cluster("b1:9092,b2:9092", "SASL_SSL", "PLAIN", "login", {"client.id": "x"})


def test_job_checks():
    one = (TopicSelector("glob", "*"),)
    for bad in (dict(selectors=()), dict(workers=0), dict(batch_size=0), dict(root="")):
        with pytest.raises(ValueError):
            BackupJob(**{"backup_id": "b", "root": "/r", "selectors": one, **bad})
    with pytest.raises(ValueError):
        RestoreJob("r", "/r")
    with pytest.raises(ValueError):
        TopicSelector("prefix", "a")


def test_kafka_batch_options():
    got = kafka.batch_options(CLUSTER, topics=["a", "b"], starting={"a": {0: 5}},
                              max_records_per_partition=1000)
    assert got["subscribe"] == "a,b" and got["endingOffsets"] == "latest"
    assert json.loads(got["startingOffsets"]) == {"a": {"0": 5}}
    assert got["includeHeaders"] == "true" and got["maxRecordsPerPartition"] == "1000"
    assert got["kafka.security.protocol"] == "SASL_SSL" and got["kafka.client.id"] == "x"
    assert kafka.batch_options(CLUSTER, pattern="a.*")["subscribePattern"] == "a.*"
    with pytest.raises(ValueError):
        kafka.batch_options(CLUSTER, topics=["a"], pattern="b")


def test_kafka_stream_and_producer_options():
    got = kafka.stream_options(CLUSTER, assign={"a": [0]}, max_offsets_per_trigger=9)
    assert got["maxOffsetsPerTrigger"] == "9" and json.loads(got["assign"]) == {"a": [0]}
    out = kafka.producer_options(CLUSTER)
    assert (out["kafka.acks"], out["kafka.enable.idempotence"], out["kafka.retries"]) == ("all", "true", "5")


def test_kafka_records_keep_their_origin(spark):
    from helpers import make_log, message

    rows = make_log(spark, [message("t", 2, 7, headers=[("a", b"1")])]).withColumn("target_topic", F.lit("u"))
    row = kafka.to_records(rows).first()
    assert (row.topic, row.partition, row.key) == ("u", 2, b"k")
    assert [(h.key, bytes(h.value)) for h in row.headers] == [
        ("a", b"1"), ("original-timestamp-micros", b"1704067207000000"),
        ("original-partition", b"2"), ("original-offset", b"7")]


def test_storage_uris():
    assert Storage("local", "/data", "p/").uri() == "file:///data/p"
    s3 = Storage("s3", "bucket", "/a/b", endpoint="http://minio:9000", path_style=True)
    assert s3.uri() == "s3a://bucket/a/b"
    assert s3.hadoop_conf()["fs.s3a.path.style.access"] == "true"
    assert Storage("gcs", "bucket").uri() == "gs://bucket"
    assert Storage("azure", "c@acc").uri() == "abfss://c@acc.dfs.core.windows.net"
    with pytest.raises(ValueError):
        Storage("ftp", "x").uri()


def test_phases(spark):
    cases = {(3, 0, 0): "Pending", (3, 1, 1): "Running", (3, 3, 0): "Completed",
             (3, 2, 1): "PartiallyCompleted", (3, 0, 3): "Failed"}
    df = spark.createDataFrame(list(cases), "planned bigint, done bigint, failed bigint")
    rows = status.job_phase(df).collect()
    assert {(r.planned, r.done, r.failed): r.phase for r in rows} == cases


def test_deleted_job_can_return(spark):
    rows = [("a", 1, "Pending", False), ("a", 2, "Running", True), ("a", 3, "Pending", False),
            ("b", 1, "Running", False), ("b", 2, "Running", True)]
    events = spark.createDataFrame(rows, "job_id string, seq bigint, phase string, deleted boolean")
    events = events.withColumn("ts", F.timestamp_seconds("seq"))
    assert [(r.job_id, r.phase) for r in catalog.latest_state(events).collect()] == [("a", "Pending")]
    assert [r.job_id for r in catalog.deleted_jobs(events).collect()] == ["b"]


def test_transitions(spark):
    rows = [("a", 1, "Pending"), ("a", 2, "Running"), ("a", 5, "Running"), ("a", 9, "Suspended"),
            ("a", 30, "Suspended"), ("b", 4, "Suspended")]
    events = spark.createDataFrame(rows, "job_id string, seq bigint, phase string")
    got = catalog.illegal_transitions(events, width=4).collect()
    assert {(r.job_id, r.seq, r.problem) for r in got} == {
        ("a", 5, "already running"), ("a", 30, "not running"), ("b", 4, "not running")}


def test_histogram_is_cumulative(spark):
    facts = spark.createDataFrame([("a", 1), ("a", 10), ("a", 11), ("a", 99)], "k string, v bigint")
    rows = status.histogram(facts, "v", [10, 50], ["k"]).collect()
    assert {r.le: r.bucket_count for r in rows} == {"10": 2, "50": 3, "+Inf": 4}
    assert rows[0].total_sum == 121
