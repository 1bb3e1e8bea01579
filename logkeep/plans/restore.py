"""Restore from the archive."""

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logkeep.functions.messages import message_size, row_hash
from logkeep.operators import replay, status, topics
from logkeep.operators.catalog import live_backups
from logkeep.operators.ordering import BUCKET_ROWS
from logkeep.schemas import LOG_SCHEMA
from logkeep.session import scratch_path, sized_shuffles, stored
from logkeep.sinks import catalog, commits
from logkeep.sinks import facts as job_facts
from logkeep.sinks.archive import checked_id
from logkeep.sources import kafka, segmentfiles
from logkeep.sources.archive import (
    read_archive, read_backups, read_below, read_segments, read_topics, snapshot_of)
from logkeep.sources.filelog import read_log
from logkeep.sources.storage import use_storage


def chosen_backup(spark, job):
    """Id of the backup to restore: the named one, or the newest in time.

    Deleted backups are not restored. One catalog row reaches the driver. None if there is
    no such backup.
    """
    if job.backup_id:  # two small files tell
        event = catalog.last_event(spark, job.root, job.backup_id)
        gone = event is not None and event["deleted"] and event["kind"] == "backup"
        return None if gone or snapshot_of(spark, job.root, job.backup_id) is None else job.backup_id
    backups = live_backups(read_backups(spark, job.root), catalog.read_events(spark, job.root))
    row = replay.latest_backup(backups, job.backup_timestamp).first()
    return row["backup_id"] if row and row["backup_id"] else None


def _wanted(rows, job):
    return replay.filter_partitions(topics.select_for_restore(rows, job.selectors), job.partition_filter)


def _chosen(rows, job):
    return replay.rename_topics(_wanted(rows, job), job.mapping)


def in_time(job):
    """Whether a segment may hold messages up to the job's moment; those of unknown times may."""
    if job.layout != "objects" or job.backup_timestamp is None:
        return F.lit(True)
    return F.coalesce(F.col("first_time") <= F.lit(job.backup_timestamp), F.lit(True))


def open_objects(spark, job, backup_id):
    """Stored messages and facts of the objects that the manifest names and the job chooses.

    Objects whose first message is later than the job's moment are not opened.
    """
    named = _wanted(read_segments(spark, job.root, backup_id), job).where(in_time(job))
    return segmentfiles.open_named(named, job.root, job.storage)


def chosen_rows(spark, job, backup_id, opened=None):
    """Archived rows that the job's selectors and partitions choose, with ``target_topic``.

    Topic and partition predicates prune folders, or choose the objects that are opened;
    ``opened`` are objects opened before.
    """
    if job.layout == "objects":
        rows = segmentfiles.named_messages(open_objects(spark, job, backup_id) if opened is None else opened)
    else:
        rows = read_archive(spark, job.root, backup_id, deduplicate=True)
    return _chosen(rows, job)


def restored_rows(spark, job, target=None, opened=None, backup_id=None):
    """Rows to replay. ``target`` is the log of the target, whose messages are not repeated
    unless the job overwrites; without it the target is empty.
    """
    use_storage(spark, job.storage)
    backup_id = backup_id or chosen_backup(spark, job)
    if backup_id is None:
        raise LookupError(f"no backup for restore {job.restore_id}")
    rows = chosen_rows(spark, job, backup_id, opened)
    if job.backup_timestamp is not None:
        rows = replay.up_to(rows, job.backup_timestamp)
    if target is not None and not job.overwrite_existing:
        rows = replay.skip_existing(rows, target)
    return rows


def unreadable_objects(spark, job, backup_id, opened=None):
    return segmentfiles.named_quarantine(open_objects(spark, job, backup_id) if opened is None else opened)


def restore_folder(path, restore_id):
    return f"{path}/restore-{checked_id(restore_id)}"


def restore_to_files(rows, path, total_order=False, restore_id="files"):
    """Replay into files, each in replay order; on request also one after another.

    Every restore has a folder of its own below the target's path. A repeated restore
    replaces that folder; rows of the target and of other restores stay.
    """
    ordered = replay.in_total_order(rows) if total_order else replay.in_replay_order(rows)
    _write_files(ordered, restore_folder(path, restore_id))


def _write_files(ordered, folder):
    ordered.select(
        F.col("target_topic").alias("topic"), "partition", "offset", "key", "value",
        "timestamp", "headers",
    ).write.mode("overwrite").parquet(folder)


#: Waves are taken as asked up to this number; many more small ones would cost a job and a journal
#: record for every few messages. Messages of one topic-partition that a joined wave may hold.
WAVES, WAVE_ROWS = 64, BUCKET_ROWS


def _wave_segments(rows, asked):
    """Segments of one wave: as many as asked, or a multiple of that where there are many waves.

    So many go together that ``WAVES`` are left, but no more than have ``WAVE_ROWS`` messages of
    one topic-partition: what a task holds stays bounded, and waves grow with messages, not segments.
    """
    sizes = rows.groupBy("topic", "partition", "segment").agg(F.count(F.lit(1)).alias("n"))
    seen = sizes.agg(F.min("segment"), F.max("segment"), F.max("n")).first()
    if seen[0] is None:
        return asked
    wanted = -(-(seen[1] // asked - seen[0] // asked + 1) // WAVES)
    return asked * max(1, min(wanted, WAVE_ROWS // (asked * seen[2])))


def replay_in_waves(spark, root, restore_id, rows, write, segments_per_wave, start=None):
    """Replay waves of consecutive segments one after another, ``write(rows, wave)`` each.

    A wave has ``segments_per_wave`` segments of each topic-partition; where that would make
    more than ``WAVES`` waves, consecutive small ones are joined (see ``_wave_segments``). The rows are stored once, a folder for each wave, and a journal in the archive's catalog
    notes every finished wave. A replay that was broken off goes on behind the last finished
    one when it is started again under its id, with the rows stored then. ``start`` is called
    before the first wave of a new replay only.
    """
    folder = f"{root}/catalog/replays/restore_id={checked_id(restore_id)}"
    _, last = commits.newest(spark, folder)
    if last is None or last["finished"] or not commits.children(spark, last["path"]):
        if start is not None:
            start()
        together = _wave_segments(rows, int(segments_per_wave))
        wave = F.expr(f"segment div {together}").alias("wave")
        path = scratch_path(spark, "waves")
        rows.select("*", wave).write.partitionBy("wave").parquet(path)
        last = {"path": path, "done": -1, "finished": False}
        commits.append(spark, folder, lambda number, record: last)
    laid = spark.read.schema(f"{_ddl(rows)}, wave bigint").parquet(last["path"])
    waves = [r.wave for r in laid.select("wave").distinct().orderBy("wave").collect()]
    for number in (w for w in waves if w > last["done"]):
        write(laid.where(F.col("wave") == number).drop("wave"), number)
        commits.append(spark, folder, lambda _, record: {**record, "done": number})
    commits.append(spark, folder, lambda _, record: {**record, "finished": True})
    commits.delete(spark, last["path"])


def restore_to_files_in_waves(spark, root, rows, path, restore_id, segments_per_wave):
    """Replay into files wave by wave; every wave has its folder, which a repeat replaces."""
    home = restore_folder(path, restore_id)

    def write(wave_rows, number):
        _write_files(replay.in_replay_order(wave_rows), f"{home}/wave-{number:09d}")

    replay_in_waves(spark, root, restore_id, rows, write, segments_per_wave,
                    start=lambda: commits.delete(spark, home))


def _check(rows, topic, *by):
    """Messages and order-free hash of each partition of ``topic``."""
    return rows.groupBy(F.col(topic).alias("topic"), "partition", *by).agg(
        F.count(F.lit(1)).alias("messages"),
        F.bit_xor(row_hash(F.col(topic))).alias("hash"),
        F.sum(message_size()).alias("bytes"),
    )


def restored_files(spark, path, restore_id):
    """Stored totals of each topic-partition in each file of a restore's folder."""
    rows = read_below(spark, LOG_SCHEMA, restore_folder(path, restore_id), recursiveFileLookup="true")
    if "_metadata" not in rows.columns and rows.isEmpty():
        rows = rows.withColumn("_metadata", F.struct(
            F.lit("").alias("file_path"), F.lit(None).cast("timestamp").alias("file_modification_time")))
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("closed_at"))
    return stored(_check(rows, "topic", *place), "restored")


def partition_outcomes(spark, job, backup_id, planned, files, opened=None):
    """Expected and restored messages of each target partition, and whether it is complete.

    ``planned`` are the rows to restore, ``files`` the totals of what was written. A partition
    is complete when the backup still holds the messages its manifest names, and the restored
    folder as many as planned, with the same hash of all their fields.
    """
    place = ["topic", "partition"]
    target = F.col("target_topic").alias("topic")
    named = _chosen(read_segments(spark, job.root, backup_id), job).groupBy(target, "partition").agg(
        F.sum(F.when(in_time(job), F.col("message_count")).otherwise(0)).alias("_named"))
    held = chosen_rows(spark, job, backup_id, opened).groupBy(target, "partition").agg(
        F.count(F.lit(1)).alias("_held"))
    wanted = _check(planned, "target_topic").select(
        *place, F.col("messages").alias("_expected"), F.col("hash").alias("_hash"))
    found = files.groupBy(*place).agg(F.sum("messages").alias("messages"), F.bit_xor("hash").alias("hash"))
    none = F.lit(0).cast("long")
    joined = named.join(held, place, "left").join(wanted, place, "left").join(found, place, "left").select(
        *place, "_hash", "hash", *[F.coalesce(c, none).alias(c) for c in ("_named", "_held", "_expected", "messages")])
    whole = F.col("_named") == F.col("_held")
    same = F.col("hash").eqNullSafe(F.col("_hash")) & (F.col("messages") == F.col("_expected"))
    error = F.when(~whole, F.concat(F.lit("backup holds "), F.col("_held"), F.lit(" of "), F.col("_named"),
                                    F.lit(" messages"))).when(
        ~same, F.concat(F.lit("restored "), F.col("messages"), F.lit(" of "), F.col("_expected"), F.lit(" messages")))
    return joined.select(*place, "messages", F.when(whole & same, "ok").otherwise("failed").alias("status"),
                         error.alias("error"))


def progress(spark, job, backup_id, planned, path, opened=None):
    """Planned and restored partitions and messages of each target topic."""
    files = restored_files(spark, path, job.restore_id)
    return _progress(partition_outcomes(spark, job, backup_id, planned, files, opened), job.restore_id)


def _progress(outcomes, restore_id):
    facts = outcomes.withColumn("job_id", F.lit(restore_id))
    return status.topic_progress(facts.select("job_id", "topic", "partition"), facts)


def _facts(job, files, outcomes, opened, started):
    """Facts of a restore: a put for each file, a get for each object, failures with their reason."""
    place = ["topic", "partition"]
    put = job_facts.of_files(
        files.withColumnsRenamed({"messages": "message_count", "bytes": "size_bytes"}).join(
            outcomes.select(*place, "status", "error"), place, "left").na.fill({"status": "ok"}),
        job.restore_id, started)
    lost = outcomes.where("status = 'failed'").join(files, place, "left_anti")
    found = put.unionByName(job_facts.of_missing(lost, job.restore_id, started))
    if opened is not None:
        found = found.unionByName(job_facts.of_opened(segmentfiles.named_facts(opened), job.restore_id))
    return job_facts.by_worker(found, job.workers)


def verify_archive(spark, root, backup_id):
    """Rows per segment whose stored hash is not that of their fields."""
    return verify_rows(read_archive(spark, root, backup_id))


def verify_rows(rows):
    """The same for archived rows from anywhere."""
    wrong = F.sum((row_hash() != F.col("row_hash")).cast("long")).alias("damaged")
    return rows.groupBy("topic", "partition", "segment").agg(F.count(F.lit(1)).alias("messages"), wrong)


def _held(spark, job, path):
    """What the target's path holds from others than this restore; None if nothing."""
    try:
        files = read_log(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    own = f"/restore-{job.restore_id}/"
    return files.where(~F.contains(F.input_file_name(), F.lit(own)))


def run_restore(spark, job, path, target=None):
    """Restore into files and record the job's states; gives the progress rows.

    Messages that ``target``, by default the log at ``path``, holds already are not written
    again unless the job overwrites. Unreadable segment objects make the job
    PartiallyCompleted, with their number as its error. Objects are opened once. With
    ``segments_per_wave`` a restore that was broken off goes on where it was.
    """
    about = {"backup_id": job.backup_id, "target_id": path}
    use_storage(spark, job.storage)
    catalog.begin(spark, job.root, job.restore_id, "restore", **about)
    started, opened = dt.datetime.now(dt.timezone.utc), None
    try:
        with catalog.beating(spark, job.root, job.restore_id):
            backup_id = chosen_backup(spark, job)
            if target is None and not job.overwrite_existing:
                target = _held(spark, job, path)
            if job.layout == "objects" and backup_id is not None:
                opened = open_objects(spark, job, backup_id)
            planned = restored_rows(spark, job, target, opened, backup_id)
            with sized_shuffles(planned):
                if target is not None and not job.overwrite_existing:
                    planned = stored(planned, "restore")  # read once more to check the result
                if job.segments_per_wave:
                    restore_to_files_in_waves(
                        spark, job.root, planned, path, job.restore_id, job.segments_per_wave)
                else:
                    restore_to_files(planned, path, restore_id=job.restore_id)
                files = restored_files(spark, path, job.restore_id)
                outcomes = stored(partition_outcomes(spark, job, backup_id, planned, files, opened), "outcomes")
                rows = _progress(outcomes, job.restore_id)
                job_facts.write(_facts(job, files, outcomes, opened, started),
                                job.root, job.restore_id, f"{started.timestamp():.6f}")
            done = F.col("partitions_completed")
            counts = rows.agg(
                F.sum("partitions_total").alias("planned"), F.sum(done).alias("done"),
                F.sum(F.col("partitions_total") - done).alias("failed"),
            )
            phase = status.job_phase(counts.na.fill(0)).first()["phase"]
            phase = "Completed" if phase == "Pending" else phase  # nothing was planned
            bad = segmentfiles.named_quarantine(opened).count() if opened is not None else 0
            if bad:
                about["error"] = f"{bad} unreadable segments left out"
                phase = "PartiallyCompleted" if phase == "Completed" else phase
    except Exception as error:
        job_facts.record_failure(spark, job.root, job.restore_id, "put", error, started)
        catalog.record(spark, job.root, job.restore_id, "restore", "Failed", error=str(error), **about)
        raise
    catalog.record(spark, job.root, job.restore_id, "restore", phase, **about)
    return rows


def restore_to_kafka(rows, cluster, root, restore_id, segments_per_wave=10_000):
    """Replay into Kafka in waves of consecutive segments.

    A Kafka partition takes its messages one after another. Waves bound what one
    task holds of a large partition; the order across waves is the loop's. Where
    several source topics go to one target, each keeps its own order. A replay that was broken
    off sends only the wave again in which that happened.
    """
    replay_in_waves(rows.sparkSession, root, restore_id, rows,
                    lambda wave_rows, _: kafka.write_topics(wave_rows, cluster), segments_per_wave)


def _ddl(rows):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def run_restore_to_kafka(spark, job, cluster, target=None, existing=None, create=None):
    """Restore into a cluster and record the job's states.

    Where the job creates topics, ``create(rows)`` gets those that the target lacks (one row
    each, see ``topics_needed``) before the replay; ``existing`` names those that it has.
    """
    about = {"backup_id": job.backup_id, "target_id": cluster.bootstrap_servers}
    use_storage(spark, job.storage)
    catalog.begin(spark, job.root, job.restore_id, "restore", **about)
    started = dt.datetime.now(dt.timezone.utc)
    try:
        with catalog.beating(spark, job.root, job.restore_id):
            rows = restored_rows(spark, job, target)
            if job.create_topics and create is not None:
                have = existing if existing is not None else spark.createDataFrame([], "topic string")
                create(topics_needed(spark, job, have).collect())
            restore_to_kafka(rows, cluster, job.root, job.restore_id, job.segments_per_wave or 10_000)
    except Exception as error:
        job_facts.record_failure(spark, job.root, job.restore_id, "put", error, started)
        catalog.record(spark, job.root, job.restore_id, "restore", "Failed", error=str(error), **about)
        raise
    catalog.record(spark, job.root, job.restore_id, "restore", "Completed", **about)


def topics_needed(spark, job, existing):
    """Topics the target lacks."""
    backup_id = chosen_backup(spark, job)
    source = read_topics(spark, job.root, backup_id)
    source = topics.select_for_restore(source.withColumnRenamed("name", "topic"), job.selectors)
    return replay.topics_to_create(source, existing, job.mapping)


def validate(requests, backups, known_topics, selectors):
    """Problems of restore requests: missing backups and selectors without topic."""
    missing = replay.missing_backups(requests, backups).select(
        F.col("request_id").alias("subject"), F.lit("backup not found").alias("problem")
    )
    unmatched = (
        topics.selector_coverage(known_topics, selectors)
        .where(F.col("topics_matched") == 0)
        .select(
            F.concat_ws(":", "type", "pattern").alias("subject"),
            F.lit("selector matches no topic").alias("problem"),
        )
    )
    return missing.unionByName(unmatched)
