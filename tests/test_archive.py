import datetime as dt
import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import at, make_log, message, same_rows
from logkeep.functions.patterns import TopicSelector
from logkeep.functions.paths import parse_key, storage_key
from logkeep.operators import manifests, replay, segments
from logkeep.plans import restore
from logkeep.plans.backup import adopt_objects, run_backup
from logkeep.plans.jobs import BackupJob, RestoreJob
from logkeep.schemas import LOG_COLUMNS
from logkeep.session import scratch_path
from logkeep.sinks import catalog as job_log
from logkeep.sinks.archive import write_rows
from logkeep.sinks.segmentfiles import topic_metadata_objects, write_objects, write_texts
from logkeep.sources import segmentfiles
from logkeep.sources.archive import read_archive, read_backups, read_segments, read_topics
from logkeep.sources.filelog import read_log
from logkeep.sources.storage import list_objects, list_segments

ALL = (TopicSelector("glob", "*"),)


def odd_messages():
    """Every kind of key, value and header, and names that contain each other."""
    rows = []
    for topic in ("orders", "orders-v2", "a.segment-1", "2024"):
        for partition in (1, 10, 11):
            rows += [
                message(topic, partition, 0, key=None, value=None),
                message(topic, partition, 1, key=b"", value=b"", headers=[("h", None), ("h", b"")]),
                message(topic, partition, 5, key=b"\x00\xff", value=b"\xc3\x28"),
                message(topic, partition, 6, key=b"k", value=b"x", headers=[("h", b"\x01"), ("h", b"\x01")]),
                message(topic, partition, 9),
            ]
    return rows


@pytest.fixture(scope="module")
def log(spark):
    return make_log(spark, odd_messages()).cache()


@pytest.fixture(scope="module", params=["count", "offset", "interval"])
def job(request, spark, log):
    job = BackupJob("b1", scratch_path(spark, "archive"), ALL, batch_size=2,
                    segmentation=request.param)
    run_backup(log, job, timestamp=at(100))
    return job


def restored(spark, job, **more):
    path = scratch_path(spark, "out")
    rows = restore.restored_rows(spark, RestoreJob("r1", job.root, "b1", **more))
    restore.restore_to_files(rows, path)
    return read_log(spark, path)


def test_roundtrip(spark, log, job):
    assert same_rows(restored(spark, job), log)


def test_only_the_named_partition_and_topic(spark, log, job):
    got = restored(spark, job, selectors=(TopicSelector("exact", "orders"),),
                   partition_filter={"orders": [1]})
    assert same_rows(got, log.where("topic = 'orders' AND partition = 1"))


def test_partition_filter_cases(spark, log):
    def left(wanted):
        return replay.filter_partitions(log, wanted)

    assert same_rows(left({}), log)
    assert same_rows(left({"orders": []}), log.where("topic <> 'orders'"))
    assert same_rows(left({"orders": [10]}), log.where("topic <> 'orders' OR partition = 10"))


def test_renamed_and_collision(spark, log, job):
    mapping = {"orders": "all", "orders-v2": "all"}
    got = restored(spark, job, mapping=mapping)
    names = F.when(F.col("topic").startswith("orders"), "all").otherwise(F.col("topic"))
    assert same_rows(got, log.withColumn("topic", names))
    existing = spark.createDataFrame([("2024",)], "topic string")
    create = restore.topics_needed(spark, RestoreJob("r", job.root, "b1", mapping=mapping), existing)
    found = {r.target_topic: (r.partitions, r.collision) for r in create.collect()}
    assert found == {"all": (3, True), "a.segment-1": (3, False)}


def test_restore_from_objects(spark, log):
    root = scratch_path(spark, "objects")
    job = BackupJob("b1", root, ALL, batch_size=2, layout="objects")
    run_backup(log, job, timestamp=at(100))
    assert same_rows(restored(spark, job, layout="objects"), log)
    some = restored(spark, job, layout="objects", selectors=(TopicSelector("glob", "orders"),),
                    partition_filter={"orders": [1, 11]})
    assert same_rows(some, log.where("topic = 'orders' AND partition <> 10"))
    assert restored(spark, job, layout="objects", selectors=(TopicSelector("exact", "no"),)).isEmpty()
    assert os.path.exists(f"{root}/backups/b1/metadata/topics/orders-v2.json")
    with open(f"{root}/backups/b1/topics/2024/partition-1/segment-000000.json.gz", "wb") as f:
        f.write(gzip.compress(b"[{"))
    again = RestoreJob("r", root, "b1", layout="objects")
    assert restore.unreadable_objects(spark, again, "b1").first().segment == 0
    left = restore.restored_rows(spark, again)
    assert left.count() == log.count() - 2
    rows = restore.run_restore(spark, again, scratch_path(spark, "out"))
    assert {r.topic: r.status for r in rows.collect()}["2024"] == "pending"
    states = job_log.read_events(spark, root).where("job_id = 'r'").orderBy(F.desc("seq"))
    assert states.first().phase == "PartiallyCompleted"


def test_adopted_objects(spark, log):
    root = scratch_path(spark, "foreign")
    cut = segments.by_count(log, 3)
    write_objects(cut, root, "old", compressed=False).count()
    adopt_objects(spark, root, "old", at(7))
    job = RestoreJob("r", root, backup_timestamp=at(50), layout="objects")
    path = scratch_path(spark, "out")
    rows = restore.run_restore(spark, job, path).collect()
    assert {(r.topic, r.messages, r.status) for r in rows} == {
        (t, 15, "completed") for t in ("orders", "orders-v2", "a.segment-1", "2024")}
    assert same_rows(read_log(spark, path), log)
    assert not read_backups(spark, root).first().compression


def test_landed_log(spark, log):
    job = BackupJob("b1", scratch_path(spark, "archive"), (TopicSelector("glob", "orders*"),),
                    batch_size=4, land=True)
    run_backup(log, job, timestamp=at(100))
    assert same_rows(restored(spark, job), log.where("topic LIKE 'orders%'"))


def test_total_order(spark, job):
    path = scratch_path(spark, "out")
    rows = restore.restored_rows(spark, RestoreJob("r1", job.root, "b1"))
    restore.restore_to_files(rows, path, total_order=True)
    parts = sorted(glob.glob(f"{path}/*/part-*.parquet"))
    seen = [(r.topic, r.partition, r.offset) for p in parts for r in read_log(spark, p).collect()]
    assert seen == sorted(seen) and len(seen) == 60


def test_point_in_time(spark, log, job):
    moment = at(5)
    got = restored(spark, job, backup_timestamp=moment)
    assert same_rows(got, log.where(F.col("timestamp") <= F.lit(moment)))


def test_backup_is_found_by_time(spark, job):
    early, late = (RestoreJob("r", job.root, backup_timestamp=at(s)) for s in (50, 150))
    assert restore.chosen_backup(spark, late) == "b1"
    assert restore.chosen_backup(spark, early) is None
    with pytest.raises(LookupError):
        restore.restored_rows(spark, early)
    with pytest.raises(LookupError):
        restore.restored_rows(spark, RestoreJob("r", job.root, "b1x"))


def test_manifest_has_real_offsets(spark, job):
    rows = read_segments(spark, job.root)
    archive = read_archive(spark, job.root, "b1")
    want = archive.groupBy("topic", "partition", "segment").agg(
        F.min("offset").alias("start_offset"), F.max("offset").alias("end_offset"),
        F.count(F.lit(1)).alias("message_count"),
    )
    assert same_rows(rows.select(*want.columns), want)
    again = manifests.segment_checksums(archive.drop("row_hash"))
    stored = rows.select("backup_id", "topic", "partition", "segment", "message_count", "checksum")
    assert same_rows(again.select(*stored.columns), stored)


def test_job_states(spark, job):
    events = [r.phase for r in job_log.read_events(spark, job.root).where("job_id = 'b1'")
              .orderBy("seq").collect()]
    assert events == ["Running", "Completed"]
    with pytest.raises(ValueError):
        job_log.record(spark, job.root, "b1", "backup", "PartiallyCompleted")
    assert read_backups(spark, job.root).first().config["segmentation"] == job.segmentation
    assert read_topics(spark, job.root).count() == 4


def test_restore_prunes_folders(spark, job):
    rows = restore.restored_rows(
        spark, RestoreJob("r", job.root, "b1", selectors=(TopicSelector("regex", "^orders$"),))
    )
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "RLIKE(topic" in plan.split("PartitionFilters")[1]


def test_run_restore_reports_progress(spark, job):
    path = scratch_path(spark, "out")
    rows = restore.run_restore(spark, RestoreJob("r9", job.root, "b1", mapping={"orders": "o2"}), path)
    found = {r.topic: (r.partitions_total, r.partitions_completed, r.messages, r.status)
             for r in rows.collect()}
    assert found["o2"] == (3, 3, 15, "completed") and len(found) == 4
    with pytest.raises(LookupError):
        restore.run_restore(spark, RestoreJob("r8", job.root, "none"), path + "x")
    last = job_log.read_events(spark, job.root).where("job_id = 'r8'").orderBy(F.desc("seq")).first()
    assert last.phase == "Failed" and "no backup" in last.error


def test_skip_existing_keeps_one_of_two(spark):
    rows = [message("t", 0, o, seconds=0) for o in range(2)] + [
        message("t", 0, 2, seconds=0, value=b""), message("t", 0, 3, seconds=0, value=None),
        message("t", 0, 4, seconds=0, key=b"kv", value=b""),
    ]
    archive = make_log(spark, rows).withColumn("target_topic", F.lit("t"))
    held = make_log(spark, [message("t", 0, 77, seconds=0), message("t", 0, 78, seconds=0, value=b"")])
    left = sorted(r.offset for r in replay.skip_existing(archive, held, width=1).collect())
    assert left == [1, 3, 4]


def test_skip_existing_with_many_copies(spark):
    rows = [message("t", 0, o, seconds=0) for o in range(500)]
    archive = make_log(spark, rows).withColumn("target_topic", F.lit("t"))
    held = make_log(spark, [message("t", 0, o, seconds=0) for o in range(123)])
    left = sorted(r.offset for r in replay.skip_existing(archive, held, width=10).collect())
    assert left == list(range(123, 500))


def test_chunks(spark):
    def sizes(n, workers):
        topics = spark.createDataFrame([(f"t{i:02}",) for i in range(n)], "topic string")
        rows = replay.restore_chunks(topics, workers).groupBy("worker_id").count().collect()
        return {r.worker_id: r["count"] for r in rows}

    assert sizes(7, 3) == {0: 3, 1: 3, 2: 1}
    assert sizes(4, 3) == {0: 2, 1: 2}


def test_rewriting_a_batch_replaces_it(spark, log):
    root = scratch_path(spark, "archive")
    cut = segments.by_absolute_offset(log, 4)
    for _ in range(2):
        write_rows(cut, root, "b1", batch=3)
    assert same_rows(read_archive(spark, root, "b1").select(*LOG_COLUMNS), log)
    with pytest.raises(ValueError):
        write_rows(cut, root, "../b1")


# Segment objects.


@pytest.fixture(scope="module", params=[True, False])
def objects(request, spark, log):
    root = scratch_path(spark, "objects")
    cut = segments.by_count(log, 2)
    out = f"{root}-manifest"
    write_objects(cut, root, "b1", compressed=request.param).write.parquet(out)
    return root, spark.read.parquet(out), cut, request.param


def test_object_roundtrip(spark, objects):
    root, _, cut, _ = objects
    got = segmentfiles.messages(segmentfiles.scan(spark, f"{root}/backups"))
    assert same_rows(got.select(*cut.columns), cut)
    some = segmentfiles.scan(spark, segmentfiles.topic_folders(root, "b1", ["orders"]))
    assert {r.topic for r in some.select("topic").distinct().collect()} == {"orders"}


def test_object_format(objects):
    root, _, _, compressed = objects
    name = "segment-000000.json" + (".gz" if compressed else "")
    path = f"{root}/backups/b1/topics/orders/partition-1/{name}"
    with (gzip.open if compressed else open)(path, "rb") as f:
        rows = json.loads(f.read())
    assert rows[0] == {"Offset": 0, "Partition": 1, "Key": None, "Value": None,
                       "Timestamp": "2024-01-01T00:00:00.000000Z", "Headers": []}
    assert rows[1]["Key"] == "" and rows[1]["Headers"][0] == {"Key": "h", "Value": None}
    left = glob.glob(f"{root}/backups/**/.segment*", recursive=True)
    assert [p for p in left if not p.endswith(".crc")] == []


def test_object_manifest(spark, objects):
    root, manifest, _, _ = objects
    for row in manifest.collect():
        assert os.path.getsize(f"{root}/{row.storage_key}") == row.size_bytes
    listed = list_segments(spark, root)
    assert manifests.manifest_against_objects(manifest, listed).isEmpty()
    assert list_objects(spark, f"{root}/backups", "segment-*").count() == manifest.count()


def test_rows_and_not_their_json_are_shuffled(log):
    plan = write_objects(segments.by_count(log, 2), "/none", "b1")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("AS json#") < plan.index("Exchange")  # printed from the top


def test_foreign_object_forms(spark):
    """Offset times, nanoseconds, null headers, as other writers give them."""
    root = scratch_path(spark, "foreign")
    folder = f"{root}/backups/b/topics/t/partition-3"
    os.makedirs(folder)
    text = (
        '[{"Offset":0,"Partition":3,"Key":"AP8=","Value":null,"Timestamp":"2024-01-01T00:00:07.179575123Z","Headers":[]},'
        '{"Offset":5,"Partition":3,"Key":null,"Value":"aGk=","Timestamp":"2024-01-01T00:00:08+02:00","Headers":[{"Key":"h","Value":"AQ=="}]},'
        '{"Offset":6,"Partition":3,"Key":"","Value":"","Timestamp":"2024-01-01T00:00:09Z","Headers":null}]'
    )
    with open(f"{folder}/segment-000000.json", "w") as f:
        f.write(text)
    with open(f"{folder}/segment-000001.json", "w") as f:
        f.write(text[:100])
    with open(f"{folder}/segment-1000000.json", "w") as f:
        f.write("[]")
    scanned = segmentfiles.scan(spark, f"{root}/backups")
    rows = segmentfiles.messages(scanned).orderBy("offset").collect()
    assert [(r.key, r.value) for r in rows] == [(b"\x00\xff", None), (None, b"hi"), (b"", b"")]
    times = [r.t for r in segmentfiles.messages(scanned).orderBy("offset")
             .select(F.unix_micros("timestamp").alias("t")).collect()]
    zone = dt.timezone.utc
    assert times == [int(t.timestamp() * 10**6) for t in (
        dt.datetime(2024, 1, 1, 0, 0, 7, 179575, zone), dt.datetime(2023, 12, 31, 22, 0, 8, 0, zone),
        dt.datetime(2024, 1, 1, 0, 0, 9, 0, zone))]
    bad = segmentfiles.quarantine(scanned).collect()
    assert [(r.topic, r.partition, r.segment) for r in bad] == [("t", 3, 1)]


def test_reading_a_broken_object_takes_no_pass_for_each_message(spark):
    """An object of 4,000 messages with one of a wrong type, and one whose message lacks its offset."""
    root = scratch_path(spark, "broken")
    folder = f"{root}/backups/b/topics/t/partition-0"
    os.makedirs(folder)
    rows = [{"Offset": n, "Partition": 0, "Key": None, "Value": None, "Timestamp": None, "Headers": []} for n in range(4000)]
    for number, change in enumerate(({}, {"Value": [1]}, {"Offset": None})):
        with gzip.open(f"{folder}/segment-{number:06d}.json.gz", "wt") as f:
            json.dump([*rows[:-1], {**rows[-1], **change}], f)
    for number, text in ((3, ""), (4, "[]"), (5, "["), (6, "[1]"), (7, json.dumps(rows[0]))):
        with open(f"{folder}/segment-{number:06d}.json", "w") as f:
            f.write(text)
    scanned = segmentfiles.scan(spark, f"{root}/backups")
    assert scanned.where("broken").count() == 4  # one row for each object, not for each message
    assert sorted(r.segment for r in segmentfiles.quarantine(scanned).collect()) == [1, 2, 5, 6]
    got = segmentfiles.messages(scanned).groupBy("segment").count().collect()
    assert sorted(map(tuple, got)) == [(0, 4000), (7, 1)]


def test_keys(spark):
    df = spark.createDataFrame([("a.segment-1", 10, 7), ("t", 0, 1234567)],
                               "topic string, partition int, segment bigint")
    key = storage_key(F.lit("b"), F.col("topic"), F.col("partition"), F.col("segment"), "/p/q/")
    rows = df.withColumn("key", key).withColumn("k", parse_key(F.col("key"))).collect()
    assert rows[0].key == "p/q/backups/b/topics/a.segment-1/partition-10/segment-000007.json.gz"
    assert rows[1].key.endswith("segment-1234567.json.gz")
    assert [(r.k.topic, r.k.partition, r.k.segment, r.k.compressed) for r in rows] == [
        ("a.segment-1", 10, 7, True), ("t", 0, 1234567, True)]
    # A prefix written twice by older archives is still understood.
    twice = spark.createDataFrame([("p/p/backups/b/topics/t/partition-1/segment-000001.json",),
                                   ("p/backups/b/topics/t/partition-1/other.json",)], "key string")
    got = twice.select(parse_key(F.col("key")).alias("k")).collect()
    assert got[0].k.partition == 1 and not got[0].k.compressed and got[1].k is None


def test_topic_metadata_objects(spark):
    root = scratch_path(spark, "meta")
    topics = spark.createDataFrame([("t", 3, 2, {"a": "b"})],
                                   "name string, partitions int, replication_factor smallint, config map<string,string>")
    write_texts(topic_metadata_objects(topics, "b"), root).count()
    with open(f"{root}/backups/b/metadata/topics/t.json") as f:
        assert json.load(f) == {"Name": "t", "Partitions": 3, "ReplicationFactor": 2, "Config": {"a": "b"}}


def test_whole_error_text_is_kept(spark, log):
    job = BackupJob("b1", scratch_path(spark, "archive"), ALL)
    with pytest.raises(Exception) as raised:
        run_backup(log.drop("timestamp"), job)
    event = job_log.read_events(spark, job.root).where("phase = 'Failed'").first()
    assert event.error == str(raised.value) and len(event.error) > 0


def test_running_jobs_are_not_started_again(spark, log):
    job = BackupJob("b1", scratch_path(spark, "archive"), ALL, segmentation="offset")
    job_log.begin(spark, job.root, "b1", "backup")
    with pytest.raises(ValueError, match="already running"):
        run_backup(log, job)
    job_log.stop(spark, job.root, "b1")
    with pytest.raises(ValueError, match="not running"):
        job_log.stop(spark, job.root, "b1")
    run_backup(log, job, timestamp=at(100))
    job_log.delete(spark, job.root, "b1")
    assert restore.chosen_backup(spark, RestoreJob("r", job.root, "b1")) is None
    with pytest.raises(LookupError):
        job_log.delete(spark, job.root, "b1")


def test_landed_copy_is_deleted(spark, log):
    root = scratch_path(spark, "archive")
    before = set(glob.glob(f"{os.path.dirname(root)}/landed-*"))
    run_backup(log, BackupJob("b1", root, ALL, land=True), timestamp=at(100))
    assert set(glob.glob(f"{os.path.dirname(root)}/landed-*")) == before


def test_skipping_shuffles_no_payload(spark, job):
    rows = restore.chosen_rows(spark, RestoreJob("r", job.root, "b1"), "b1")
    target = rows.select(*LOG_COLUMNS).where("offset < 2")
    left = replay.skip_existing(rows, target)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert same_rows(left.select(*LOG_COLUMNS), rows.where("offset >= 2").select(*LOG_COLUMNS))


def test_kafka_waves_come_from_one_stored_copy(spark, job, monkeypatch):
    seen = []
    monkeypatch.setattr(restore.kafka, "write_topics", lambda rows, cluster: seen.append(
        [(r.segment, r.topic) for r in rows.collect()]))
    rows = restore.chosen_rows(spark, RestoreJob("r", job.root, "b1"), "b1").where("segment <> 1")
    restore.restore_to_kafka(rows, None, job.root, "kafka", segments_per_wave=1)
    assert [len({s for s, _ in wave}) for wave in seen] == [1] * len(seen)
    assert sum(map(len, seen)) == rows.count() and 1 not in {s for wave in seen for s, _ in wave}


def test_selectors_become_subscriptions():
    from logkeep.sources.kafka import selector_options
    names = (TopicSelector("exact", "a"), TopicSelector("glob", "b.c"))
    assert selector_options(names) == {"subscribe": "a,b.c"}
    pattern = selector_options((TopicSelector("exact", "a.b"), TopicSelector("glob", "o*"),
                                TopicSelector("regex", "[[]x")))["subscribePattern"]
    assert pattern == "(?:a\\.b)|(?:(?s)^o.*\\z)|(?:(?s:.*)(?:[\\[]x)(?s:.*))"
    with pytest.raises(ValueError):
        selector_options(())


def test_object_store_settings():
    from logkeep.sources.storage import Storage
    minio = Storage("s3", "bucket", endpoint="http://minio:9000", region="x", path_style=True)
    assert minio.arrow_options() == {"force_virtual_addressing": False, "region": "x",
                                     "endpoint_override": "minio:9000", "scheme": "http"}
    assert Storage("local", "/tmp").arrow_options() == {}
