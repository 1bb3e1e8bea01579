"""Queries on whole runs: facts, snapshots, restores by manifest, streams with state, replays."""

import datetime as dt

from pyspark.sql import functions as F

from logkeep.functions.patterns import TopicSelector
from logkeep.plans import report, restore
from logkeep.plans.backup import run_backup
from logkeep.plans.jobs import BackupJob, RestoreJob
from logkeep.session import scratch_path
from logkeep.sinks import catalog as job_log
from logkeep.sinks.facts import read_facts
from logkeep.sinks.segmentfiles import write_objects
from logkeep.operators import hashtree, segments, status
from logkeep.sources.archive import read_archive, read_segments
from logkeep.sources.filelog import read_log, stream_log
from logkeep.streaming.backup import run_scheduled
from logkeep.streaming.compaction import compact
from workload import logs
from workload import sqlparts as sql
from workload.jobs import restored, run_stream
from workload.registry import query
from workload.segmenting import ROWS_SQL, WALK_SQL, as_text
from workload.selecting import BUCKET_SQL

EVERY = (TopicSelector("glob", "*"),)


@query("facts_of_backup", f"""WITH {sql.LINEITEM}
SELECT 'nightly' AS job_id, topic, {BUCKET_SQL} AS worker_id, count(*) AS messages, CAST(sum({sql.size_sql()}) AS BIGINT) AS bytes
FROM lineitem_log GROUP BY topic""")
def facts_of_backup(spark, sf_dir):
    """Counters of a finished backup, from the facts of its own tasks."""
    job = BackupJob("nightly", scratch_path(spark, "facts"), EVERY, workers=3, seed=42, batch_size=1000)
    run_backup(logs.log(spark, sf_dir, "lineitem"), job)
    return status.message_counters(read_facts(spark, job.root, "nightly")).drop("tasks")


@query("facts_of_objects", f"""WITH {sql.ORDERS}, segmented AS (SELECT *, {sql.count_segment_sql(100)} AS segment FROM orders_log)
SELECT 'put' AS operation, 'ok' AS status, count(*) AS operations FROM (SELECT DISTINCT topic, "partition", segment FROM segmented)""")
def facts_of_objects(spark, sf_dir):
    """One storage operation for each object that a backup wrote."""
    job = BackupJob("nightly", scratch_path(spark, "facts"), EVERY, batch_size=100, layout="objects")
    run_backup(logs.log(spark, sf_dir, "orders"), job)
    return status.storage_operations(read_facts(spark, job.root))


def damaged_objects(spark, sf_dir):
    """A backup into objects of which every fifth was overwritten since."""
    job = BackupJob("nightly", scratch_path(spark, "damaged"), EVERY, batch_size=100, layout="objects")
    log = logs.log(spark, sf_dir, "orders")
    run_backup(log, job)
    bad = segments.by_count(log, 100).where("segment % 5 = 2")
    write_objects(bad, job.root, "nightly", json=F.lit('{"Offset": 1}')).count()
    return job


@query("facts_of_restore", f"""WITH {sql.ORDERS}, segmented AS (SELECT *, {sql.count_segment_sql(100)} AS segment FROM orders_log),
whole AS (SELECT topic, "partition", bool_and(segment % 5 <> 2) AS whole, count(*) AS n, sum(CASE WHEN segment % 5 <> 2 THEN 1 ELSE 0 END) AS kept
  FROM segmented GROUP BY topic, "partition")
SELECT 'put' AS operation, topic, CASE WHEN whole THEN 'ok' ELSE 'failed' END AS status, CAST(sum(kept) AS BIGINT) AS messages,
  max(CASE WHEN NOT whole THEN 'Worker 0 - ' || topic || '-partition-' || "partition" || ': backup holds ' || kept || ' of ' || n || ' messages' END) AS error
FROM whole GROUP BY topic, whole
UNION ALL
SELECT 'get', topic, CASE WHEN segment % 5 = 2 THEN 'failed' ELSE 'ok' END, count(*) FILTER (WHERE segment % 5 <> 2),
  max(CASE WHEN segment % 5 = 2 THEN 'Worker 0 - ' || topic || '-partition-' || "partition" || ': checksum differs' END)
FROM segmented GROUP BY topic, segment % 5 = 2""")
def facts_of_restore(spark, sf_dir):
    """What a restore read and wrote, and why some of it failed."""
    job = damaged_objects(spark, sf_dir)
    restore.run_restore(spark, RestoreJob("r", job.root, "nightly", layout="objects"), scratch_path(spark, "out"))
    found = status.error_rows(read_facts(spark, job.root, "r"))
    return found.groupBy("operation", "topic", "status").agg(
        F.sum("messages").alias("messages"),
        F.max(F.when(F.col("status") == "failed", F.col("message"))).alias("error"))


@query("facts_of_stream", f"""WITH {sql.EVENTS}
SELECT topic, count(*) AS messages, CAST(sum({sql.size_sql()}) AS BIGINT) AS bytes FROM events_log GROUP BY topic""")
def facts_of_stream(spark, sf_dir):
    """Facts add up over micro-batches; a batch that is replayed replaces its own."""
    job = BackupJob("continuous", scratch_path(spark, "facts"), EVERY, batch_size=100, segmentation="offset")
    run_stream(spark, job, logs.log_path(spark, sf_dir, "events"), scratch_path(spark, "checkpoint"), files=2)
    return read_facts(spark, job.root).groupBy("topic").agg(
        F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"))


@query("report_of_runs", f"""WITH {sql.ORDERS}, segmented AS (SELECT *, {sql.count_segment_sql(100)} AS segment FROM orders_log)
SELECT 'nightly' AS job_id, 'backup' AS kind, 'Completed' AS phase, count(DISTINCT topic) AS topics, count(*) AS messages, 0 AS errors FROM orders_log
UNION ALL SELECT 'good', 'restore', 'Completed', count(DISTINCT topic), count(*), 0 FROM orders_log WHERE topic = 'orders.f' HAVING count(*) > 0
UNION ALL SELECT 'none', 'restore', 'Failed', 0, 0, 1""")
def report_of_runs(spark, sf_dir):
    """Phase, topics, messages and errors of each job, from its events and facts."""
    job = BackupJob("nightly", scratch_path(spark, "report"), EVERY, batch_size=100)
    run_backup(logs.log(spark, sf_dir, "orders"), job)
    only = (TopicSelector("exact", "orders.f"),)
    restore.run_restore(spark, RestoreJob("good", job.root, "nightly", selectors=only), scratch_path(spark, "out"))
    try:
        restore.run_restore(spark, RestoreJob("none", job.root, "weekly"), scratch_path(spark, "out"))
    except LookupError:
        pass
    return report.job_report(spark, job.root).select("job_id", "kind", "phase", "topics", "messages", "errors")


@query("totals_of_backups", f"""WITH {sql.EVENTS}
SELECT 'first' AS backup_id, count(DISTINCT topic) AS topics_discovered, count(DISTINCT topic) AS topics_backed_up, count(*) AS messages,
  CAST(sum({sql.size_sql()}) AS BIGINT) AS bytes FROM events_log
UNION ALL SELECT 'second', count(DISTINCT topic), count(DISTINCT topic), count(*), CAST(sum({sql.size_sql()}) AS BIGINT) FROM events_log WHERE "partition" = 1""")
def totals_of_backups(spark, sf_dir):
    """Totals of each backup of an archive, from its manifest and facts."""
    root, log = scratch_path(spark, "totals"), logs.log(spark, sf_dir, "events")
    run_backup(log, BackupJob("first", root, EVERY, batch_size=50))
    for part in (0, 1):  # repeated: the newer snapshot alone counts
        run_backup(log.where(F.col("partition") == part), BackupJob("second", root, EVERY, segmentation="offset"))
    return report.backup_totals(spark, root).drop("last_backup_time")


@query("latency_of_runs", f"""WITH {sql.ORDERS}, segmented AS (SELECT *, {sql.count_segment_sql(100)} AS segment FROM orders_log)
SELECT 'put' AS operation, count(*) AS operations, true AS counted_once FROM (SELECT DISTINCT topic, "partition", segment FROM segmented)""")
def latency_of_runs(spark, sf_dir):
    """Histogram of measured durations: every object is in the last bucket, none in a smaller one only."""
    job = BackupJob("nightly", scratch_path(spark, "latency"), EVERY, batch_size=100, layout="objects")
    run_backup(logs.log(spark, sf_dir, "orders"), job)
    bars = report.durations(spark, job.root, "nightly")
    widest = F.max(F.when(F.col("le") == "+Inf", F.col("bucket_count"))).alias("operations")
    return bars.groupBy("operation").agg(
        widest, (F.max("bucket_count") == F.max("total_count")).alias("counted_once"))


@query("objects_rewritten", f"""WITH {sql.LINEITEM} SELECT {ROWS_SQL} FROM lineitem_log WHERE topic = 'lineitem.r' AND "partition" < 3""")
def objects_rewritten(spark, sf_dir):
    """Three object backups under one id, each smaller, the last without compression: a restore
    gives the last one's messages, though objects of the others might still lie there."""
    root, log = scratch_path(spark, "rewritten"), logs.log(spark, sf_dir, "lineitem")
    for rows, packed in ((log, True), (log.where("topic = 'lineitem.r'"), True),
                         (log.where("topic = 'lineitem.r' AND partition < 3"), False)):
        run_backup(rows, BackupJob("same", root, EVERY, batch_size=500, layout="objects", compression=packed))
    # what a stranger left under the plain keys is not the backup's
    write_objects(segments.by_count(log.where("topic = 'lineitem.a'"), 5000), root, "same").count()
    path = scratch_path(spark, "out")
    restore.run_restore(spark, RestoreJob("r", root, "same", layout="objects"), path)
    return as_text(read_log(spark, path))


@query("backup_repeated", f"""WITH {sql.ORDERS}
SELECT 'after a failure' AS moment, {ROWS_SQL} FROM orders_log
UNION ALL SELECT 'after a repeat', {ROWS_SQL} FROM orders_log WHERE topic <> 'orders.o'""")
def backup_repeated(spark, sf_dir):
    """A repeated backup that dies half-way leaves the earlier one; a whole one replaces it."""
    root, log = scratch_path(spark, "repeated"), logs.log(spark, sf_dir, "orders")
    job = BackupJob("same", root, EVERY, batch_size=500)
    run_backup(log, job)
    broken = log.withColumn("value", F.when(
        (F.col("topic") == "orders.f") & (F.col("offset") == 3), F.raise_error(F.lit("disk is gone")).cast("binary")
    ).otherwise(F.col("value")))
    try:
        run_backup(broken, job)
    except Exception:
        pass
    kept = restored(spark, job, backup_id="same").withColumn("moment", F.lit("after a failure"))
    run_backup(log.where("topic <> 'orders.o'"), job)
    again = restored(spark, job, backup_id="same").withColumn("moment", F.lit("after a repeat"))
    return kept.unionByName(again)


@query("backup_raced", """SELECT 'a' AS driver, 'started' AS answer UNION ALL SELECT 'b', 'refused' UNION ALL SELECT 'c', 'started'
UNION ALL SELECT CAST(count(*) AS VARCHAR), 'events' FROM (SELECT unnest(range(5))) WHERE (SELECT count(*) FROM orders) > 0""")
def backup_raced(spark, sf_dir):
    """Two drivers start one job: one is refused; after its lease a silent job is started again."""
    root = scratch_path(spark, "raced")
    answers = []
    for driver, lease in (("a", 300), ("b", 300), ("c", -1)):
        try:
            job_log.begin(spark, root, "nightly", "backup", lease=lease)
            answers.append((driver, "started"))
        except ValueError:
            answers.append((driver, "refused"))
    run_backup(logs.log(spark, sf_dir, "orders"), BackupJob("other", root, EVERY, segmentation="offset"))
    events = job_log.read_events(spark, root).agg(F.count(F.lit(1)).cast("string").alias("driver"))
    return spark.createDataFrame(answers, "driver string, answer string").unionByName(
        events.withColumn("answer", F.lit("events")))


def in_three_runs(spark, sf_dir, name, cuts, job, after_run=None):
    """A log that grows between three scheduled runs on one checkpoint."""
    source, checkpoint = scratch_path(spark, "growing"), scratch_path(spark, "checkpoint")
    whole = logs.log(spark, sf_dir, name)
    moment = F.col("timestamp")
    first, second = (F.lit(c).cast("timestamp") for c in cuts)
    for part in (moment < first, (moment >= first) & (moment < second), moment >= second):
        whole.where(part).write.mode("append").parquet(source)
        run_scheduled(stream_log(spark, source), job, checkpoint, timestamp="2024-02-01 00:00:00")
        if after_run is not None:
            after_run(spark, job.root, job.backup_id)
    return job


@query("stream_by_count", f"""WITH {sql.ORDERS} SELECT {ROWS_SQL}, {sql.count_segment_sql(100)} AS segment FROM orders_log""")
def stream_by_count(spark, sf_dir):
    """Segments of 100 messages over three runs are those of one bounded run."""
    job = BackupJob("counted", scratch_path(spark, "counted"), EVERY, batch_size=100)
    in_three_runs(spark, sf_dir, "orders", ("1994-06-01", "1997-02-03"), job)
    return as_text(read_archive(spark, job.root), "segment")


@query("stream_compacted", f"""WITH {sql.ORDERS}, segmented AS (SELECT *, {sql.count_segment_sql(100)} AS segment FROM orders_log)
SELECT {ROWS_SQL}, segment, count(*) OVER (PARTITION BY topic, "partition", segment) AS message_count FROM segmented""")
def stream_compacted(spark, sf_dir):
    """Three runs, each followed by a compaction: rows, segments and manifest stay those of one bounded run."""
    job = BackupJob("packed", scratch_path(spark, "packed"), EVERY, batch_size=100)
    in_three_runs(spark, sf_dir, "orders", ("1994-06-01", "1997-02-03"), job, after_run=compact)
    manifest = read_segments(spark, job.root, "packed").select("topic", "partition", "segment", "message_count")
    rows = read_archive(spark, job.root, "packed").join(manifest, ["topic", "partition", "segment"])
    return as_text(rows, "segment", "message_count")


@query("stream_by_interval", f"{WALK_SQL} SELECT topic, \"partition\", \"offset\", segment FROM walk")
def stream_by_interval(spark, sf_dir):
    """Segments by size and elapsed time over three runs are those of one bounded run."""
    job = BackupJob("timed", scratch_path(spark, "timed"), EVERY, batch_size=20, segmentation="interval",
                    interval_seconds=86_400)
    in_three_runs(spark, sf_dir, "events", ("2024-01-09 07:00:00", "2024-01-20"), job)
    return read_archive(spark, job.root).select("topic", "partition", "offset", "segment")


@query("stream_replayed", f"""WITH {sql.ORDERS} SELECT {ROWS_SQL}, {sql.count_segment_sql(70)} AS segment FROM orders_log""")
def stream_replayed(spark, sf_dir):
    """A lost checkpoint reads everything again: repeats fall into the segments that they were in."""
    job = BackupJob("again", scratch_path(spark, "again"), EVERY, batch_size=70)
    source = scratch_path(spark, "source")
    logs.log(spark, sf_dir, "orders").write.parquet(source)
    for _ in range(2):
        run_scheduled(stream_log(spark, source), job, scratch_path(spark, "checkpoint"))
    return as_text(read_archive(spark, job.root, "again", deduplicate=True), "segment")


@query("replay_resumed", f"""WITH {sql.ORDERS} SELECT {ROWS_SQL}, true AS broken_off FROM orders_log""")
def replay_resumed(spark, sf_dir):
    """A replay that breaks off in its third wave and is started again writes every message once."""
    job = BackupJob("nightly", scratch_path(spark, "waves"), EVERY, batch_size=50)
    run_backup(logs.log(spark, sf_dir, "orders"), job)
    path, sent = scratch_path(spark, "out"), []
    rows = restore.restored_rows(spark, RestoreJob("r", job.root, "nightly"))

    def write(wave_rows, number):
        if len(sent) == 2:
            sent.append(None)
            raise ConnectionError("target is gone")
        sent.append(number)
        wave_rows.write.parquet(f"{path}/wave-{number}")  # fails if a wave came twice

    broken = False
    for _ in range(2):
        try:
            restore.replay_in_waves(spark, job.root, "r", rows, write, 1)
        except ConnectionError:
            broken = True
    return as_text(read_log(spark, path)).withColumn("broken_off", F.lit(broken))


CHANGES_SQL = """CASE WHEN "offset" % 211 = 7 THEN 'lost' WHEN "offset" % 211 = 107 THEN 'doubled' WHEN "offset" % 211 = 207 THEN 'changed' END"""


def altered(log):
    """A log of which some messages are lost, some doubled and some changed."""
    place = F.col("offset") % 211
    left = log.where(place != 7).withColumn(
        "value", F.when(place == 207, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("value")))
    return left.unionByName(log.where(place == 107))


@query("archive_diff", f"""WITH {sql.ORDERS}
SELECT topic, "partition", "offset", {CHANGES_SQL} AS finding FROM orders_log WHERE topic <> 'orders.p' AND finding IS NOT NULL
UNION ALL SELECT topic, "partition", "offset", 'lost' FROM orders_log WHERE topic = 'orders.p'""")
def archive_diff(spark, sf_dir):
    """An archive against a log in which messages are lost, doubled and changed, and a topic is gone."""
    log = logs.log(spark, sf_dir, "orders")
    job = BackupJob("nightly", scratch_path(spark, "compared"), EVERY, batch_size=500)
    run_backup(log, job)
    other = altered(log.where("topic <> 'orders.p'"))
    return hashtree.compare(read_archive(spark, job.root, "nightly"), other, width=64)


@query("archive_same", f"""WITH {sql.LINEITEM}
SELECT count(*) AS messages, CAST(0 AS BIGINT) AS differing FROM lineitem_log""")
def archive_same(spark, sf_dir):
    """Two backups of one log, cut differently, hold the same."""
    root, log = scratch_path(spark, "compared"), logs.log(spark, sf_dir, "lineitem")
    run_backup(log, BackupJob("one", root, EVERY, batch_size=1000))
    run_backup(log, BackupJob("two", root, EVERY, batch_size=77, segmentation="offset"))
    one, two = (hashtree.leaves(read_archive(spark, root, name), 256) for name in ("one", "two"))
    differing = hashtree.differing_ranges(one, two).count()
    return one.agg(F.sum("messages").alias("messages")).withColumn("differing", F.lit(differing).cast("bigint"))


@query("point_in_time_pruned", f"""WITH {sql.EVENTS}, segmented AS (SELECT *, {sql.count_segment_sql(25)} AS segment FROM events_log),
objects AS (SELECT topic, "partition", segment, min("timestamp") AS first_time FROM segmented GROUP BY topic, "partition", segment),
opened AS (SELECT topic, count(*) AS opened FROM objects WHERE first_time <= TIMESTAMP '2024-01-10 12:00:00' GROUP BY topic)
SELECT topic, count(DISTINCT "partition") AS partitions_total, count(DISTINCT "partition") AS partitions_completed,
  CAST(count_if("timestamp" <= TIMESTAMP '2024-01-10 12:00:00') AS BIGINT) AS messages, coalesce(any_value(opened), 0) AS opened
FROM events_log LEFT JOIN opened USING (topic) GROUP BY topic""")
def point_in_time_pruned(spark, sf_dir):
    """A restore up to a time opens only objects that can hold messages before it."""
    job = BackupJob("nightly", scratch_path(spark, "moment"), EVERY, batch_size=25, layout="objects")
    run_backup(logs.log(spark, sf_dir, "events"), job)
    moment = dt.datetime(2024, 1, 10, 12, tzinfo=dt.timezone.utc)
    rows = restore.run_restore(
        spark, RestoreJob("r", job.root, "nightly", backup_timestamp=moment, layout="objects"), scratch_path(spark, "out"))
    opened = read_facts(spark, job.root, "r").where("operation = 'get'").groupBy("topic").agg(
        F.count(F.lit(1)).alias("opened"))
    return rows.join(opened, "topic", "left").na.fill({"opened": 0}).select(
        "topic", "partitions_total", "partitions_completed", "messages", "opened")


@query("archive_damaged", f"""WITH {sql.EVENTS}, segmented AS (SELECT *, {sql.count_segment_sql(50)} AS segment FROM events_log)
SELECT topic, "partition", segment, count(*) AS messages,
  CAST(count_if("offset" % 7 = 1 OR "offset" % 7 = 3 OR ("offset" % 7 = 5 AND "value" IS NOT NULL)) AS BIGINT) AS damaged
FROM segmented GROUP BY topic, "partition", segment""")
def archive_damaged(spark, sf_dir):
    """Stored hashes tell which messages were changed in the archive: key, time, a value lost."""
    job = BackupJob("nightly", scratch_path(spark, "damage"), EVERY, batch_size=50)
    run_backup(logs.log(spark, sf_dir, "events"), job)
    place = F.col("offset") % 7
    rows = read_archive(spark, job.root, "nightly").withColumn(
        "key", F.when(place == 1, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("key"))).withColumn(
        "timestamp", F.when(place == 3, F.col("timestamp") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("timestamp"))).withColumn(
        "value", F.when(place == 5, F.lit(None)).otherwise(F.col("value")))
    return restore.verify_rows(rows)
