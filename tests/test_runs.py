import datetime as dt
import gzip
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from helpers import at, make_log, message, random_log, same_rows
from logkeep.functions.patterns import TopicSelector
from logkeep.operators import catalog as states
from logkeep.operators import segments
from logkeep.plans import report, restore
from logkeep.plans.backup import adopt_objects, run_backup
from logkeep.plans.jobs import BackupJob, RestoreJob
from logkeep.session import scratch_path, stored
from logkeep.sinks import archive as sink
from logkeep.sinks import catalog as job_log
from logkeep.sinks import commits
from logkeep.sinks.facts import read_facts
from logkeep.sinks.segmentfiles import write_objects
from logkeep.sources import segmentfiles
from logkeep.sources.archive import read_archive, read_backups, read_segments, snapshot_of
from logkeep.sources.filelog import read_log

ALL = (TopicSelector("glob", "*"),)
SIZES = {("a", 0): 60, ("a", 1): 25, ("b", 0): 5}


@pytest.fixture(scope="module")
def log(spark):
    return make_log(spark, random_log(21, SIZES)).cache()


def restored(spark, root, **more):
    path = scratch_path(spark, "out")
    restore.restore_to_files(restore.restored_rows(spark, RestoreJob("x", root, "b", **more)), path)
    return read_log(spark, path)


def failing(log, topic="a", offset=None):
    here = (F.col("topic") == topic) & (F.lit(True) if offset is None else F.col("offset") == offset)
    return log.withColumn("value", F.when(here, F.raise_error(F.lit("disk is gone")).cast("binary")).otherwise(F.col("value")))


# Records that are created only if absent.


def test_one_of_many_writers_creates_a_record(spark):
    path, made = scratch_path(spark, "records"), []

    def create(i):
        made.append(commits.create_if_absent(spark, f"{path}/000000000000.json", json.dumps({"by": i})))

    threads = [threading.Thread(target=create, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(made) == [False] * 7 + [True]
    assert commits.newest(spark, path)[0] == 0
    left = [n for n, _ in commits.children(spark, path) if not n.endswith(".crc")]
    assert left == ["000000000000.json"]


def test_appends_of_many_writers_are_all_kept(spark):
    path = scratch_path(spark, "records")

    def add(i):
        commits.append(spark, path, lambda number, last: {"seen": [*(last or {"seen": []})["seen"], i]})

    threads = [threading.Thread(target=add, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    number, record = commits.newest(spark, path)
    assert number == 5 and sorted(record["seen"]) == list(range(6))


# The job log.


def test_one_of_two_drivers_starts_a_job(spark):
    root, answers = scratch_path(spark, "root"), []

    def start():
        try:
            job_log.begin(spark, root, "b", "backup")
            answers.append("started")
        except ValueError:
            answers.append("refused")

    threads = [threading.Thread(target=start) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(answers) == ["refused"] * 4 + ["started"]


def test_crashed_job_starts_again_after_its_lease(spark, log):
    root = scratch_path(spark, "root")
    job_log.begin(spark, root, "b", "backup")  # and its driver dies
    with pytest.raises(ValueError, match="already running"):
        run_backup(log, BackupJob("b", root, ALL))
    assert job_log.phase_of(spark, root, "b", lease=-1) == "Failed"
    job_log.begin(spark, root, "b", "backup", lease=-1)
    seen = [(r.phase, r.error) for r in job_log.read_events(spark, root).orderBy("seq").collect()]
    assert seen == [("Running", None), ("Failed", job_log.LOST), ("Running", None)]


def test_heartbeats_keep_a_job_running(spark):
    root = scratch_path(spark, "root")
    job_log.begin(spark, root, "b", "backup")
    first = job_log.last_event(spark, root, "b")["ts"]
    with job_log.beating(spark, root, "b", seconds=0.05):
        threading.Event().wait(1)
        assert job_log.last_event(spark, root, "b")["ts"] > first
        assert job_log.read_events(spark, root).count() == 1
        assert job_log.read_events(spark, root, beats=True).count() == 2
        assert states.latest_state(job_log.read_events(spark, root, beats=True)).count() == 1
    assert job_log.last_event(spark, root, "b")["ts"] == first


def test_silent_jobs_are_listed_as_failed(spark):
    rows = [("a", 1, at(0), "Running", False), ("b", 1, at(0), "Running", False), ("b", 1, at(900), "Running", False),
            ("c", 1, at(0), "Completed", False)]
    events = spark.createDataFrame(rows, "job_id string, seq bigint, ts timestamp, phase string, deleted boolean")
    found = states.with_liveness(states.latest_state(events), at(1000))
    assert {r.job_id: r.phase for r in found.collect()} == {"a": "Failed", "b": "Running", "c": "Completed"}


def test_stopped_restore_keeps_its_kind_and_starts_again(spark, log):
    root = scratch_path(spark, "root")
    run_backup(log, BackupJob("b", root, ALL))
    job_log.begin(spark, root, "r", "restore", backup_id="b")
    job_log.stop(spark, root, "r")
    listed = states.list_jobs(report.job_states(spark, root), "restore").collect()
    assert [(r.job_id, r.phase, r.error, r.backup_id) for r in listed] == [("r", "Failed", job_log.STOPPED, "b")]
    restore.run_restore(spark, RestoreJob("r", root, "b"), scratch_path(spark, "out"))
    assert job_log.phase_of(spark, root, "r") == "Completed"


# Snapshots.


@pytest.mark.parametrize("layout", ["archive", "objects"])
def test_run_that_dies_leaves_the_backup(spark, log, layout):
    job = BackupJob("b", scratch_path(spark, "root"), ALL, batch_size=4, layout=layout)
    run_backup(log, job, timestamp=at(10))
    with pytest.raises(Exception, match="disk is gone"):
        run_backup(failing(log, offset=log.where("topic = 'a' AND partition = 0").agg(F.max("offset")).first()[0]), job)
    assert same_rows(restored(spark, job.root, layout=layout), log)
    assert read_segments(spark, job.root).agg(F.sum("message_count")).first()[0] == 90
    assert read_backups(spark, job.root).count() == 1
    fewer = log.where("topic = 'b'")
    run_backup(fewer, job, timestamp=at(20))
    assert same_rows(restored(spark, job.root, layout=layout), fewer)
    assert same_rows(stored(restored(spark, job.root, layout=layout)), fewer)
    kept = [n for n, _ in commits.children(spark, f"{job.root}/catalog/segments/backup_id=b")]
    assert kept == [f"snapshot={snapshot_of(spark, job.root, 'b')['snapshot']}"]
    if layout == "archive":
        assert read_archive(spark, job.root).count() == 5
        assert len(commits.children(spark, f"{job.root}/data/backup_id=b")) == 1
    else:
        assert not os.path.exists(f"{job.root}/backups/b/topics")
        assert len(os.listdir(f"{job.root}/runs/backup_id=b")) == 1


def test_run_that_dies_before_its_commit(spark, log, monkeypatch):
    job = BackupJob("b", scratch_path(spark, "root"), ALL, batch_size=4)
    run_backup(log, job)

    def die(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(sink, "commit", die)
    with pytest.raises(KeyboardInterrupt):
        run_backup(log.where("topic = 'b'"), job)
    monkeypatch.undo()
    assert same_rows(restored(spark, job.root), log)
    assert read_archive(spark, job.root).count() == 90


def test_second_of_two_commits_on_one_snapshot_fails(spark, log):
    root = scratch_path(spark, "root")
    run_backup(log, BackupJob("b", root, ALL))
    base, _ = sink.base_of(spark, root, "b")
    old = snapshot_of(spark, root, "b")
    entry = sink.entry_of(at(0), True, {})
    sink.commit(spark, root, "b", base, old["snapshot"], entry, streams=old["streams"])
    with pytest.raises(RuntimeError, match="committed first"):
        sink.commit(spark, root, "b", base, "other", entry)
    assert same_rows(restored(spark, root), log)


# Objects by manifest.


def object_backup(spark, log, **more):
    job = BackupJob("b", scratch_path(spark, "root"), ALL, batch_size=10, layout="objects", **more)
    run_backup(log, job)
    return job


@pytest.mark.parametrize("held", [8 << 20, 0])
def test_objects_are_read_in_pieces(spark, log, monkeypatch, held):
    monkeypatch.setattr(segmentfiles, "HELD_BYTES", held)
    monkeypatch.setattr(segmentfiles, "PIECE", 11)
    monkeypatch.setattr(segmentfiles, "BATCH_ROWS", 3)
    for packed in (True, False):
        job = object_backup(spark, log, compression=packed)
        assert same_rows(restored(spark, job.root, layout="objects"), log)


def test_objects_are_neither_listed_nor_read_twice(spark, log, monkeypatch):
    job = object_backup(spark, log)
    opened = []
    real = segmentfiles.open_named
    monkeypatch.setattr(segmentfiles, "open_named", lambda *a: opened.append(1) or real(*a))
    path = scratch_path(spark, "out")
    restore.run_restore(spark, RestoreJob("r", job.root, "b", layout="objects"), path)
    assert opened == [1] and same_rows(read_log(spark, path), log)
    rows = restore.restored_rows(spark, RestoreJob("x", job.root, "b", layout="objects"))
    files = rows.inputFiles()
    assert files and not any("/backups/" in f for f in files)


def test_damage_of_every_kind_condemns_the_object(spark, log):
    job = object_backup(spark, log)
    home = f"{job.root}/backups/b/topics/a/partition-0"
    whole = gzip.decompress(open(f"{home}/segment-000000.json.gz", "rb").read())
    damage = {0: whole[:-1], 1: b"", 2: whole.replace(b'"Offset"', b'"offset"'), 3: b"[]"}
    for number, data in damage.items():
        with open(f"{home}/segment-{number:06d}.json.gz", "wb") as f:
            f.write(gzip.compress(data))
    with open(f"{home}/segment-000004.json.gz", "wb") as f:
        f.write(b"no gzip")
    os.remove(f"{home}/segment-000005.json.gz")
    again = RestoreJob("r", job.root, "b", layout="objects")
    bad = {(r.topic, r.partition, r.segment) for r in restore.unreadable_objects(spark, again, "b").collect()}
    assert bad == {("a", 0, n) for n in range(6)}
    restore.run_restore(spark, again, scratch_path(spark, "out"))
    failed = read_facts(spark, job.root, "r").where("status = 'failed' AND operation = 'get'")
    errors = [r.error for r in failed.orderBy("file").collect()]
    assert errors == ["checksum differs"] * 5 + ["missing object"]
    assert job_log.phase_of(spark, job.root, "r") == "PartiallyCompleted"


def test_adopted_objects_are_checked_by_their_content(spark, log):
    root = scratch_path(spark, "foreign")
    write_objects(segments.by_count(log, 10), root, "b", compressed=False).count()
    adopt_objects(spark, root, "b", at(7))
    home = f"{root}/backups/b/topics/a/partition-0"
    text = open(f"{home}/segment-000000.json").read()
    for number, changed in enumerate((text[:-1], text.replace('"Value":"', '"Value":["x"],"x":"', 1), text + "x", "[1]")):
        with open(f"{home}/segment-{number:06d}.json", "w") as f:
            f.write(changed)
    job = RestoreJob("r", root, "b", layout="objects")
    bad = {r.segment for r in restore.unreadable_objects(spark, job, "b").collect()}
    assert bad == {0, 1, 2, 3}
    assert restore.restored_rows(spark, job).count() == 90 - 40


def test_old_objects_under_the_id_are_not_restored(spark, log):
    job = object_backup(spark, log)
    write_objects(segments.by_count(log, 1), job.root, "b", compressed=False).count()
    assert same_rows(restored(spark, job.root, layout="objects"), log)


def test_manifest_has_the_times_of_its_segments(spark, log):
    want = segments.by_count(log, 10).groupBy("topic", "partition", "segment").agg(
        F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))
    for layout in ("archive", "objects"):
        job = BackupJob("b", scratch_path(spark, "root"), ALL, batch_size=10, layout=layout)
        run_backup(log, job)
        assert same_rows(read_segments(spark, job.root).select(*want.columns), want)


def test_objects_after_the_moment_are_not_opened(spark, log):
    job = object_backup(spark, log)
    moment = log.where("topic = 'a' AND partition = 0").agg(F.percentile_approx("timestamp", 0.5)).first()[0]
    asked = RestoreJob("x", job.root, "b", layout="objects", backup_timestamp=moment)
    opened = restore.open_objects(spark, asked, "b")
    named = read_segments(spark, job.root)
    assert 0 < segmentfiles.named_facts(opened).count() == named.where(F.col("first_time") <= F.lit(moment)).count() < named.count()
    want = log.where(F.col("timestamp") <= F.lit(moment))
    assert same_rows(restored(spark, job.root, layout="objects", backup_timestamp=moment), want)


# Facts.


def test_facts_of_a_backup(spark, log):
    job = object_backup(spark, log)
    facts = read_facts(spark, job.root, "b").collect()
    named = read_segments(spark, job.root).collect()
    assert sorted(f.file for f in facts) == sorted(s.storage_key for s in named)
    assert all(f.duration_ms >= 0 and f.attempt is not None and f.status == "ok" and f.ts for f in facts)
    archive = BackupJob("b", scratch_path(spark, "root"), ALL, batch_size=10, workers=3, seed=5)
    run_backup(log, archive)
    found = read_facts(spark, archive.root, "b")
    assert found.agg(F.sum("messages")).first()[0] == 90
    assert found.where("duration_ms < 0 OR ts IS NULL OR worker_id IS NULL").isEmpty()
    workers = report.worker_totals(spark, archive.root).collect()
    assert sum(w.messages for w in workers) == 90 and {w.job_id for w in workers} == {"b"}


def test_facts_add_up_over_runs_and_failures_say_why(spark, log):
    job = BackupJob("b", scratch_path(spark, "root"), ALL, batch_size=10)
    run_backup(log, job)
    run_backup(log.where("topic = 'b'"), job)
    with pytest.raises(Exception, match="disk is gone"):
        run_backup(failing(log), job)
    assert read_facts(spark, job.root, "b").agg(F.sum("messages")).first()[0] == 95
    line = report.errors(spark, job.root, "b").first()
    assert line.message.startswith("Worker 0 - job: ") and "disk is gone" in line.message
    row = report.job_report(spark, job.root).first()
    assert (row.phase, row.topics, row.messages, row.errors) == ("Failed", 2, 95, 1)


def test_report_of_an_archive_without_facts(spark):
    root = scratch_path(spark, "root")
    job_log.record(spark, root, "b", "backup", "Pending")
    row = report.job_report(spark, root).first()
    assert (row.job_id, row.phase, row.messages, row.errors) == ("b", "Pending", 0, 0)


def test_totals_of_a_bounded_run_shuffle_no_rows(spark, log, monkeypatch):
    """Distinct offsets of each segment would be shuffled row by row; only streams need them."""
    real, plans, root = sink.file_totals, [], scratch_path(spark, "root")

    def totals(*args, **more):
        found = real(*args, **more)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(sink, "file_totals", totals)
    run_backup(log, BackupJob("b", root, ALL, batch_size=7))
    assert len(plans) == 1 and "distinct" not in plans[0]
    assert read_segments(spark, root, "b").agg(F.sum("message_count")).first()[0] == log.count()


# Replay in waves.


def test_restore_in_waves_goes_on_where_it_broke_off(spark, log, monkeypatch):
    root, path = scratch_path(spark, "root"), scratch_path(spark, "out")
    run_backup(log, BackupJob("b", root, ALL, batch_size=5))
    job = RestoreJob("r", root, "b", segments_per_wave=3)
    real, calls = restore._write_files, []

    def write(rows, folder):
        calls.append(folder.rsplit("/", 1)[1])
        if len(calls) == 3:
            real(rows.limit(2), folder)  # a part of the third wave arrives
            raise ConnectionError("target is gone")
        real(rows, folder)

    monkeypatch.setattr(restore, "_write_files", write)
    with pytest.raises(ConnectionError):
        restore.run_restore(spark, job, path)
    assert job_log.phase_of(spark, root, "r") == "Failed"
    progress = restore.run_restore(spark, job, path).collect()
    assert {r.status for r in progress} == {"completed"} and same_rows(read_log(spark, path), log)
    assert calls == [f"wave-{n:09d}" for n in (0, 1, 2, 2, 3)]
    restore.run_restore(spark, job, path)  # a finished one starts anew
    assert same_rows(read_log(spark, path), log) and calls[5:] == [f"wave-{n:09d}" for n in range(4)]


def many_segments(spark, segments, messages):
    """Rows of one topic-partition, so many messages in each segment."""
    return spark.range(segments * messages, numPartitions=1).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"),
        F.expr(f"id div {messages}").alias("segment"))


@pytest.mark.parametrize("largest, together", [(1 << 18, 4), (4, 2), (1, 1)])
def test_many_small_waves_are_joined(spark, monkeypatch, largest, together):
    monkeypatch.setattr(restore, "WAVES", 5, raising=False)
    monkeypatch.setattr(restore, "WAVE_ROWS", largest, raising=False)
    seen, rows = [], many_segments(spark, 20, 2)
    restore.replay_in_waves(
        spark, scratch_path(spark, "root"), "r", rows, lambda wave, n: seen.append({r.segment for r in wave.collect()}), 1)
    assert seen == [set(range(n, n + together)) for n in range(0, 20, together)]


def test_joined_waves_go_on_where_they_broke_off(spark, monkeypatch):
    monkeypatch.setattr(restore, "WAVES", 5, raising=False)
    root, rows, sent = scratch_path(spark, "root"), many_segments(spark, 20, 2), []

    def write(wave, number):
        if len(sent) == 2:
            sent.append([])
            raise ConnectionError("target is gone")
        sent.append([r.offset for r in wave.collect()])

    with pytest.raises(ConnectionError):
        restore.replay_in_waves(spark, root, "r", rows, write, 1)
    restore.replay_in_waves(spark, root, "r", rows, write, 1)
    assert len(sent) == 6 and sorted(sum(sent, [])) == list(range(40))


def test_kafka_restore_names_missing_topics(spark, log, monkeypatch):
    from logkeep.sources.kafka import Cluster
    root, made, sent = scratch_path(spark, "root"), [], []
    run_backup(log, BackupJob("b", root, ALL))
    monkeypatch.setattr(restore.kafka, "write_topics", lambda rows, cluster: sent.append(rows.count()))
    existing = spark.createDataFrame([("b",)], "topic string")
    restore.run_restore_to_kafka(spark, RestoreJob("r", root, "b", mapping={"a": "a2"}), Cluster("x:1"),
                                 existing=existing, create=lambda rows: made.extend(r.target_topic for r in rows))
    assert made == ["a2"] and sum(sent) == 90 and job_log.phase_of(spark, root, "r") == "Completed"


def test_object_store_settings_reach_the_session(spark):
    from logkeep.sources.storage import Storage, use_storage
    use_storage(spark, Storage("s3", "bucket", endpoint="http://minio:9000", path_style=True))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert conf.get("fs.s3a.endpoint") == "http://minio:9000" and conf.get("fs.s3a.path.style.access") == "true"


def test_moments_are_in_utc(spark):
    root = scratch_path(spark, "root")
    job_log.record(spark, root, "b", "backup", "Pending")
    ts = job_log.read_events(spark, root).select(F.unix_seconds("ts").alias("t")).first().t
    assert abs(ts - dt.datetime.now(dt.timezone.utc).timestamp()) < 60


def test_message_of_every_size_passes(spark):
    rows = [message("t", 0, o, value=b"x" * n) for o, n in enumerate((0, 1, 3_000_000, 10))]
    log = make_log(spark, rows)
    job = object_backup(spark, log)
    assert same_rows(restored(spark, job.root, layout="objects"), log)
