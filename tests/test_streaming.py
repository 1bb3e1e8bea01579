import glob

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import make_log, random_log, same_rows
from logkeep.functions.patterns import TopicSelector
from logkeep.operators.segments import by_absolute_offset, by_count, by_size_or_interval
from logkeep.plans.jobs import BackupJob
from logkeep.schemas import LOG_COLUMNS
from logkeep.session import scratch_path, stored
from logkeep.sources.archive import read_archive, read_segments
from logkeep.sources.filelog import stream_log
from logkeep.sinks import catalog
from logkeep.streaming.backup import finish_run, run_scheduled, start_backup, write_batch
from logkeep.streaming.segments import latest_state
from logkeep.streaming.totals import latest_totals, start_totals

SIZES = {("a.x", 0): 200, ("a.y", 1): 90, ("b", 0): 30}


def run(spark, job, source, checkpoint):
    run_scheduled(stream_log(spark, source, 1), job, checkpoint)


def test_stream_equals_batch_over_several_runs(spark):
    log = make_log(spark, random_log(3, SIZES)).cache()
    source, checkpoint = scratch_path(spark, "source"), scratch_path(spark, "checkpoint")
    job = BackupJob("s", scratch_path(spark, "root"), (TopicSelector("glob", "a.*"),), batch_size=7,
                    segmentation="offset")
    for part in log.randomSplit([1.0, 1.0, 1.0], seed=5):
        part.coalesce(2).write.mode("append").parquet(source)
        run(spark, job, source, checkpoint)
        run(spark, job, source, checkpoint)  # nothing new
    want = by_absolute_offset(log.where("topic <> 'b'"), 7)
    got = read_archive(spark, job.root, "s")
    assert same_rows(got.select(*want.columns), want)
    counts = want.groupBy("topic", "partition", "segment").agg(F.count(F.lit(1)).alias("message_count"))
    assert same_rows(read_segments(spark, job.root).select(*counts.columns), counts)


def test_lost_checkpoint_gives_copies_that_reading_drops(spark):
    log = make_log(spark, random_log(4, SIZES)).cache()
    source = scratch_path(spark, "source")
    job = BackupJob("s", scratch_path(spark, "root"), (TopicSelector("glob", "*"),), segmentation="offset")
    log.coalesce(1).write.parquet(source)
    run(spark, job, source, scratch_path(spark, "checkpoint"))
    assert same_rows(read_archive(spark, job.root, "s", deduplicate=True).select(*LOG_COLUMNS), log)
    # A new checkpoint numbers its batches anew and replaces none of the old ones.
    run(spark, job, source, scratch_path(spark, "checkpoint"))
    assert read_archive(spark, job.root, "s").count() == 2 * log.count()
    once = read_archive(spark, job.root, "s", deduplicate=True).select(*LOG_COLUMNS)
    assert same_rows(stored(once), log)


def test_stop_keeps_what_was_read(spark):
    log = make_log(spark, random_log(8, SIZES)).cache()
    source = scratch_path(spark, "source")
    job = BackupJob("s", scratch_path(spark, "root"), (TopicSelector("glob", "*"),), segmentation="offset")
    log.write.parquet(source)
    query = start_backup(stream_log(spark, source), job, scratch_path(spark, "c"), interval_seconds=1)
    query.processAllAvailable()
    query.stop()
    catalog.stop(spark, job.root, "s")
    assert catalog.phase_of(spark, job.root, "s") == "Suspended"
    finish_run(spark, job)
    assert same_rows(read_archive(spark, job.root, "s").select(*LOG_COLUMNS), log)


def test_streams_refuse_what_they_cannot_write(spark):
    log = make_log(spark, random_log(8, SIZES))
    source = scratch_path(spark, "source")
    log.write.parquet(source)
    job = BackupJob("s", scratch_path(spark, "root"), (TopicSelector("glob", "*"),), layout="objects")
    with pytest.raises(ValueError, match="archive layout"):
        start_backup(stream_log(spark, source), job, scratch_path(spark, "c"))


def test_failed_stream_leaves_the_job_failed(spark):
    source = scratch_path(spark, "source")
    make_log(spark, random_log(8, SIZES)).write.parquet(source)
    job = BackupJob("s", scratch_path(spark, "root"), (TopicSelector("glob", "*"),), segmentation="offset")
    bad = stream_log(spark, source).withColumn("value", F.raise_error(F.lit("broken")).cast("binary"))
    with pytest.raises(Exception, match="broken"):
        run_scheduled(bad, job, scratch_path(spark, "c"))
    assert catalog.phase_of(spark, job.root, "s") == "Failed"
    run(spark, job, source, scratch_path(spark, "c"))  # may be started again
    assert catalog.phase_of(spark, job.root, "s") == "Completed"


def in_batches(spark, log, job, cuts, replay=()):
    """Micro-batches of an ordered log, cut at places of each partition; some come twice."""
    place = F.row_number().over(Window.partitionBy("topic", "partition").orderBy("offset"))
    placed = log.withColumn("_p", place)
    for number, (low, high) in enumerate(zip((0, *cuts), (*cuts, 10**9))):
        for _ in range(1 + (number in replay)):
            write_batch(placed.where((F.col("_p") > low) & (F.col("_p") <= high)).drop("_p"), job, "q", number)


@pytest.mark.parametrize("cuts", [(1, 2, 60), (7, 14, 199)])
def test_count_segments_do_not_depend_on_batches(spark, cuts):
    log = make_log(spark, random_log(11, SIZES)).cache()
    job = BackupJob("s", scratch_path(spark, "root"), (TopicSelector("glob", "*"),), batch_size=7)
    in_batches(spark, log, job, cuts, replay=(1,))
    want = by_count(log, 7)
    assert same_rows(read_archive(spark, job.root, "s").select(*want.columns), want)


@pytest.mark.parametrize(("size", "wait", "cuts", "disorder"), [
    (7, 20, (1, 2, 60), 30), (1, 5, (9,), 0), (500, 10**6, (13, 20), 0)])
def test_interval_segments_do_not_depend_on_batches(spark, size, wait, cuts, disorder):
    log = make_log(spark, random_log(12, SIZES, disorder=disorder)).cache()
    job = BackupJob("s", scratch_path(spark, "root"), (TopicSelector("glob", "*"),), batch_size=size,
                    segmentation="interval", interval_seconds=wait)
    in_batches(spark, log, job, cuts, replay=(1,))
    want = by_size_or_interval(log, size, wait)
    assert same_rows(read_archive(spark, job.root, "s").select(*want.columns), want)


def test_state_is_one_row_a_partition_and_old_states_go(spark):
    log = make_log(spark, random_log(13, SIZES)).cache()
    job = BackupJob("s", scratch_path(spark, "root"), (TopicSelector("glob", "*"),), batch_size=9)
    in_batches(spark, log, job, (10, 20, 30, 40))
    state = latest_state(spark, job.root, "s")
    assert {(r.topic, r.partition): (r.segment, r.open) for r in state.collect()} == {
        key: divmod(n, 9) for key, n in SIZES.items()}
    assert len(glob.glob(f"{job.root}/catalog/state/backup_id=s/stream=q/batch=*")) == 2


def test_new_checkpoint_goes_on_numbering(spark):
    log = make_log(spark, random_log(14, SIZES)).cache()
    job = BackupJob("s", scratch_path(spark, "root"), (TopicSelector("glob", "*"),), batch_size=7)
    late = log.where("offset > 150")
    write_batch(log.where("offset <= 200"), job, "one", 0)
    write_batch(late, job, "two", 0)  # reads a part again
    want = by_count(log, 7)
    finish_run(spark, job)
    got = read_archive(spark, job.root, "s", deduplicate=True).select(*want.columns)
    assert same_rows(stored(got), want)


def test_totals(spark):
    log = make_log(spark, random_log(6, SIZES))
    source, out = scratch_path(spark, "source"), scratch_path(spark, "totals")
    log.repartition(3).write.parquet(source)
    start_totals(stream_log(spark, source, 1), out, scratch_path(spark, "checkpoint")).awaitTermination()
    got = {r.topic: r.messages for r in latest_totals(spark, out).collect()}
    assert got == {"a.x": 200, "a.y": 90, "b": 30}
