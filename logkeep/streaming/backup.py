"""Continuous and scheduled backup with Structured Streaming."""

import contextlib
import datetime as dt
import threading

from logkeep.operators.segments import by_absolute_offset
from logkeep.operators.topics import select_for_backup
from logkeep.plans.backup import describe
from logkeep.session import landed, sized_shuffles
from logkeep.sinks import archive as sink
from logkeep.sinks import catalog, facts
from logkeep.sources.archive import read_pieces
from logkeep.sources.storage import use_storage
from logkeep.streaming import segments

#: Local property in which Spark keeps the id of a running query's checkpoint.
QUERY_ID = "sql.streaming.queryId"


def start_backup(stream, job, checkpoint, interval_seconds=None):
    """Stream a log into the archive.

    Without an interval all available rows are taken and the query ends (a scheduled run);
    the checkpoint makes the next run go on where this one ended. Segments are ranges of
    absolute offsets, or closed by count or by size and interval (see ``streaming.segments``);
    either way they do not depend on where batches end. A micro-batch has a folder
    of its own, named by its checkpoint and number: a replayed batch replaces itself, and a
    new checkpoint adds to what older ones wrote. Bound the rows of a trigger at the source
    (files or offsets per trigger): a batch is shuffled once, sized by its files.

    While the query runs its driver gives signs of life; a query that fails leaves the job Failed.
    """
    if job.layout != "archive":
        raise ValueError("streams write the archive layout")
    spark = stream.sparkSession
    use_storage(spark, job.storage)
    catalog.begin(spark, job.root, job.backup_id, "backup", backup_id=job.backup_id)
    chosen = select_for_backup(stream, job.selectors)

    def write(batch, batch_id):
        write_batch(batch, job, batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID), batch_id)

    writer = (
        chosen.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .queryName(f"backup-{job.backup_id}")
    )
    if interval_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{interval_seconds} seconds")
    try:
        query = writer.start()
    except Exception as error:
        _failed(spark, job, error)
        raise
    threading.Thread(target=_attend, args=(spark, query, job), daemon=True).start()
    return query


def write_batch(batch, job, stream, number):
    """Archive one micro-batch: rows, the state after them, and what each file added.

    Offset ranges need one pass over the batch; other segments count it first, so it is landed.
    """
    spark, started = batch.sparkSession, dt.datetime.now(dt.timezone.utc)
    land = job.segmentation != "offset"
    with landed(batch) if land else contextlib.nullcontext(batch) as rows, sized_shuffles(rows):
        if land:
            before = segments.state_before(spark, job.root, job.backup_id, stream, number)
            found, state = segments.cut(rows, job, before)
        else:
            found = by_absolute_offset(rows, job.batch_size)
        sink.write_rows(found, job.root, job.backup_id, batch=number, stream=stream, cluster=not land)
        if land:
            segments.write_state(state, job.root, job.backup_id, stream, number)
    files = sink.file_totals(sink.read_batch(spark, job.root, job.backup_id, stream, number))
    sink.write_pieces(files, job.root, job.backup_id, stream, number, started)


def _attend(spark, query, job):
    """Signs of life of a running query; its failure is recorded."""
    try:
        while not query.awaitTermination(catalog.BEAT_SECONDS):
            catalog.beat(spark, job.root, job.backup_id)
    except Exception as error:
        with contextlib.suppress(Exception):  # the session may be gone
            _failed(spark, job, error)


def _failed(spark, job, error):
    """Record a running job as failed, once."""
    def decide(number, last):
        if last is None or last["phase"] != "Running":
            raise ValueError(catalog.NOT_RUNNING)
        return catalog.event(number + 1, "backup", "Failed", backup_id=job.backup_id, error=str(error))

    with contextlib.suppress(ValueError):
        catalog.append(spark, job.root, job.backup_id, decide)


def finish_run(spark, job, topic_facts=None, timestamp=None):
    """Manifest, topics and catalog entry over all batches written so far, as a new snapshot.

    The pieces that batches recorded are added up; rows are read again only where they
    overlap. The batches since the last snapshot give the facts of this run.
    """
    base, earlier = sink.base_of(spark, job.root, job.backup_id)
    snapshot = sink.new_snapshot()
    streams = sink.write_pieced_manifest(
        spark, job.root, job.backup_id, snapshot, compressed=job.compression)
    known = [s for s in (earlier or {"streams": []})["streams"] if s["last_batch"] is not None]
    new = sink.up_to_batches(read_pieces(spark, job.root, job.backup_id), streams)
    written = facts.of_files(sink.up_to_batches(new, known, beyond=True), job.backup_id)
    facts.write(facts.by_worker(written, job.workers, job.seed), job.root, job.backup_id, snapshot)
    totals, entry = describe(spark, job, snapshot, topic_facts, timestamp)
    sink.commit(spark, job.root, job.backup_id, base, snapshot, entry, streams=streams)
    catalog.record(spark, job.root, job.backup_id, "backup", "Completed", backup_id=job.backup_id)
    return totals


def run_scheduled(stream, job, checkpoint, topic_facts=None, timestamp=None):
    """One scheduled run: all that is new, then manifest and catalog."""
    spark = stream.sparkSession
    query = start_backup(stream, job, checkpoint)
    try:
        with catalog.beating(spark, job.root, job.backup_id):
            query.awaitTermination()
            return finish_run(spark, job, topic_facts, timestamp)
    except Exception as error:
        _failed(spark, job, error)
        raise
