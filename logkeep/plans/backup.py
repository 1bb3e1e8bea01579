"""Backup of a topic log into the archive."""

import contextlib
import datetime as dt

from pyspark.sql import functions as F

from logkeep.operators import segments, topics
from logkeep.operators.manifests import topic_manifest
from logkeep.session import input_bytes, landed, sized_shuffles, stored
from logkeep.sinks import archive as sink
from logkeep.sinks import catalog, facts
from logkeep.sinks.segmentfiles import RESULT as OBJECT_RESULT
from logkeep.sinks.segmentfiles import topic_metadata_objects, write_objects, write_texts
from logkeep.sources import segmentfiles
from logkeep.sources.storage import list_segments, use_storage


def segmented(log, job):
    """Selected rows with their segment."""
    chosen = topics.select_for_backup(log, job.selectors)
    if job.segmentation == "offset":
        return segments.by_offset(chosen, job.batch_size)
    if job.segmentation == "interval":
        return segments.by_size_or_interval(chosen, job.batch_size, job.interval_seconds)
    return segments.by_count(chosen, job.batch_size)


def run_backup(log, job, topic_facts=None, timestamp=None):
    """Write rows, segment manifest, topics and the catalog entry as a new snapshot.

    Rows segmented by count or interval already sit per offset range, so the
    writer moves them only when segmenting did not. An earlier backup of the same id stays
    restorable until the new one is whole; then it is replaced and removed. One fact for each
    file or object, from the task that wrote it, is added to the job's facts.
    """
    spark = log.sparkSession
    use_storage(spark, job.storage)
    catalog.begin(spark, job.root, job.backup_id, "backup", backup_id=job.backup_id)
    started = dt.datetime.now(dt.timezone.utc)
    try:
        with catalog.beating(spark, job.root, job.backup_id):
            totals = _write(spark, log, job, topic_facts, timestamp, started)
    except Exception as error:
        facts.record_failure(spark, job.root, job.backup_id, "put", error, started)
        catalog.record(spark, job.root, job.backup_id, "backup", "Failed",
                       backup_id=job.backup_id, error=str(error))
        raise
    catalog.record(spark, job.root, job.backup_id, "backup", "Completed", backup_id=job.backup_id)
    return totals


def _write(spark, log, job, topic_facts, timestamp, started):
    base, _ = sink.base_of(spark, job.root, job.backup_id)
    snapshot = sink.new_snapshot()
    # Objects keep their plain keys unless an earlier run's may still be needed under them.
    prefix = f"runs/backup_id={job.backup_id}/{snapshot}" if job.layout == "objects" and base >= 0 else ""
    # Segmenting scans a log more than once: a source that is no file may grow meanwhile.
    land = job.land or input_bytes(log) is None
    chosen = topics.select_for_backup(log, job.selectors)
    streams = []
    with landed(chosen) if land else contextlib.nullcontext(log) as log, sized_shuffles(log):
        rows = segmented(log, job)
        if job.layout == "objects":
            # The objects are written by the action that stores their manifest.
            objects = write_objects(rows, job.root, job.backup_id, job.compression,
                                    storage=job.storage, prefix=prefix)
            sink.store_manifest(objects, job.root, job.backup_id, snapshot)
            written = facts.of_objects(
                sink.stored_manifest(spark, job.root, job.backup_id, snapshot, OBJECT_RESULT), job.backup_id)
        else:
            streams = [{"stream": f"run-{snapshot}", "last_batch": None}]
            sink.write_rows(rows, job.root, job.backup_id, cluster=job.segmentation == "offset",
                            stream=streams[0]["stream"])
            files = stored(sink.file_totals(
                sink.read_batch(spark, job.root, job.backup_id, streams[0]["stream"], 0), offsets=False), "files")
            sink.write_manifest(spark, job.root, job.backup_id, snapshot, files, compressed=job.compression)
            written = facts.of_files(files, job.backup_id, started)
    facts.write(facts.by_worker(written, job.workers, job.seed), job.root, job.backup_id, snapshot)
    totals, entry = describe(spark, job, snapshot, topic_facts, timestamp, prefix)
    sink.commit(spark, job.root, job.backup_id, base, snapshot, entry, job.layout, prefix, streams)
    return totals


def describe(spark, job, snapshot, topic_facts=None, timestamp=None, prefix=""):
    """Write topics and segment pages of a snapshot whose manifest is stored; gives its totals by
    topic and its catalog entry."""
    own = sink.stored_manifest(spark, job.root, job.backup_id, snapshot)
    totals = topic_manifest(own)
    sink.write_topics(with_facts(totals, topic_facts), job.root, job.backup_id, snapshot)
    sink.write_pages(own, job.root, job.backup_id, snapshot)
    names = totals.select("topic").orderBy("topic").collect()
    if job.layout == "objects":
        described = with_facts(totals, topic_facts)
        write_texts(topic_metadata_objects(described, job.backup_id, prefix), job.root, job.storage).count()
    moment = timestamp or dt.datetime.now(dt.timezone.utc)
    config = {"batch_size": job.batch_size, "segmentation": job.segmentation,
              "workers": job.workers, "seed": job.seed, **job.config}
    entry = sink.entry_of(moment, job.compression, config, [r.topic for r in names])
    return totals, entry


def adopt_objects(spark, root, backup_id, timestamp, topic_facts=None):
    """Catalog entries for segment objects that another tool wrote.

    Counts and offsets come from one scan of the objects, sizes from their
    listing; unreadable objects get no entry. They are the result (stored rows), and their
    number is recorded with the job, whose phase is then Failed; each is a failed fact.
    """
    base, _ = sink.base_of(spark, root, backup_id)
    snapshot, started = sink.new_snapshot(), dt.datetime.now(dt.timezone.utc)
    folder = f"{root}/backups/{backup_id}/topics"
    place = ["topic", "partition", "segment"]
    scanned = segmentfiles.scan(spark, folder)
    counts = segmentfiles.messages(scanned).groupBy(*place).agg(
        F.min("offset").alias("start_offset"),
        F.max("offset").alias("end_offset"),
        F.count(F.lit(1)).alias("message_count"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )
    listed = list_segments(spark, folder).select(*place, "size_bytes", "storage_key", "compressed")
    manifest = stored(
        counts.join(listed, place).select(
            F.lit(backup_id).alias("backup_id"), *place, "start_offset", "end_offset",
            "message_count", "size_bytes", "storage_key",
            F.lit(None).cast("string").alias("checksum"), "first_time", "last_time", "compressed",
        )
    )
    compressed = bool(manifest.agg(F.max("compressed")).first()[0])
    sink.store_manifest(manifest.drop("compressed"), root, backup_id, snapshot)
    totals = topic_manifest(manifest)
    sink.write_topics(with_facts(totals, topic_facts), root, backup_id, snapshot)
    sink.write_pages(manifest, root, backup_id, snapshot)
    names = [r.topic for r in totals.select("topic").orderBy("topic").collect()]
    left_out = stored(segmentfiles.quarantine(scanned), "left-out")
    read = facts.of_adopted(manifest, left_out, backup_id, started)
    facts.write(facts.by_worker(read), root, backup_id, snapshot)
    entry = sink.entry_of(timestamp, compressed, {"layout": "objects"}, names)
    sink.commit(spark, root, backup_id, base, snapshot, entry, "objects")
    bad = left_out.count()
    about = {"error": f"{bad} unreadable segments left out"} if bad else {}
    catalog.record(spark, root, backup_id, "backup", "Failed" if bad else "Completed",
                   backup_id=backup_id, **about)
    return left_out


def with_facts(totals, topic_facts):
    """Topic rows with replication and config from a supplied topics table."""
    seen = totals.select(F.col("topic").alias("name"), "partitions")
    if topic_facts is None:
        return seen.withColumn("replication_factor", F.lit(1).cast("smallint")).withColumn(
            "config", F.create_map().cast("map<string,string>")
        )
    facts = topic_facts.select("name", "replication_factor", "config")
    return seen.join(facts, "name", "left")
