import glob

import pytest
from pyspark.sql import functions as F

from helpers import make_log, random_log, same_rows
from logkeep.functions.patterns import TopicSelector
from logkeep.operators.ordering import total_before
from logkeep.operators.segments import by_absolute_offset, by_count
from logkeep.plans.backup import run_backup
from logkeep.plans.jobs import BackupJob
from logkeep.schemas import LOG_COLUMNS
from logkeep.session import scratch_path, stored
from logkeep.sinks import archive as sink
from logkeep.sources.archive import read_archive, read_pieces, read_segments, snapshot_of
from logkeep.streaming.backup import finish_run, write_batch
from logkeep.streaming.compaction import binned, chosen, compact

SIZES = {("a.x", 0): 200, ("a.y", 1): 90, ("b", 0): 30}
EVERY = (TopicSelector("glob", "*"),)


def job_of(spark, **options):
    return BackupJob("s", scratch_path(spark, "root"), EVERY, batch_size=7, **options)


def in_batches(log, job, borders, stream="q", first=0):
    for number, (low, high) in enumerate(zip(borders, borders[1:]), first):
        write_batch(log.where((F.col("offset") >= low) & (F.col("offset") < high)), job, stream, number)


def files(job):
    return glob.glob(f"{job.root}/data/**/*.parquet", recursive=True)


@pytest.fixture(scope="module")
def log(spark):
    return make_log(spark, random_log(21, SIZES)).cache()


def test_many_batches_become_few_files_and_the_stream_goes_on(spark, log):
    job = job_of(spark)
    in_batches(log, job, [0, 10, 20, 35, 50, 70, 90])
    finish_run(spark, job)
    before, segments = len(files(job)), stored(read_segments(spark, job.root, "s"))
    facts = compact(spark, job.root, "s")
    assert facts["messages_before"] == facts["messages_after"] == log.where("offset < 90").count()
    assert facts["files_after"] == len(files(job)) == len(SIZES) < before == facts["files_before"]
    assert same_rows(read_segments(spark, job.root, "s"), segments)
    want = by_count(log, 7)
    assert same_rows(read_archive(spark, job.root, "s").select(*want.columns), want.where("offset < 90"))
    assert same_rows(read_archive(spark, job.root).select(*want.columns), want.where("offset < 90"))
    assert compact(spark, job.root, "s") is None  # nothing new
    write_batch(log.where("offset >= 90"), job, "q", 6)
    assert read_archive(spark, job.root, "s").count() == log.where("offset < 90").count()  # not committed yet
    finish_run(spark, job)
    assert same_rows(read_archive(spark, job.root, "s").select(*want.columns), want)
    compact(spark, job.root, "s")
    assert same_rows(stored(read_archive(spark, job.root, "s", deduplicate=True).select(*want.columns)), want)
    totals = want.groupBy("topic", "partition", "segment").agg(F.count(F.lit(1)).alias("message_count"))
    assert same_rows(read_segments(spark, job.root).select(*totals.columns), totals)


def test_replay_of_a_compacted_batch_adds_nothing(spark, log):
    job = job_of(spark, segmentation="offset")
    in_batches(log, job, [0, 40, 10**9])
    finish_run(spark, job)
    compact(spark, job.root, "s")
    write_batch(log.where("offset >= 40"), job, "q", 1)
    finish_run(spark, job)
    want = by_absolute_offset(log, 7)
    assert same_rows(read_archive(spark, job.root, "s").select(*want.columns), want)
    assert not glob.glob(f"{job.root}/data/**/stream=q/**/*.parquet", recursive=True)


def test_copies_are_left_out(spark, log):
    job = job_of(spark, segmentation="offset")
    in_batches(log, job, [0, 60, 10**9], "old")
    in_batches(log, job, [30, 10**9], "new")
    finish_run(spark, job)
    assert read_archive(spark, job.root, "s").count() > log.count()
    facts = compact(spark, job.root, "s")
    assert facts["messages_before"] > facts["messages_after"] == log.count()
    assert same_rows(read_archive(spark, job.root, "s").select(*LOG_COLUMNS), log)


def test_batches_behind_the_snapshot_stay(spark, log):
    job = job_of(spark, segmentation="offset")
    in_batches(log, job, [0, 50, 100])
    finish_run(spark, job)
    in_batches(log, job, [100, 150], first=2)
    in_batches(log, job, [150, 10**9], "started-since")
    compact(spark, job.root, "s")
    assert same_rows(read_archive(spark, job.root, "s").select(*LOG_COLUMNS), log.where("offset < 100"))
    finish_run(spark, job)
    assert same_rows(read_archive(spark, job.root, "s").select(*LOG_COLUMNS), log)


def test_compaction_that_loses_or_breaks_off_changes_nothing(spark, log, monkeypatch):
    job = job_of(spark, segmentation="offset")
    in_batches(log, job, [0, 50, 10**9])
    finish_run(spark, job)
    commit = sink.commit

    def late(*args, **options):
        monkeypatch.setattr(sink, "commit", commit)
        record = snapshot_of(spark, job.root, "s")
        entry = {k: record[k] for k in ("timestamp", "version", "compression", "config", "topics")}
        commit(spark, job.root, "s", record["number"], record["snapshot"], entry, streams=record["streams"])
        return commit(*args, **options)

    monkeypatch.setattr(sink, "commit", late)
    with pytest.raises(RuntimeError, match="committed first"):
        compact(spark, job.root, "s")
    assert same_rows(read_archive(spark, job.root, "s").select(*LOG_COLUMNS), log)

    def dies(*args, **options):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(sink, "commit", dies)
    with pytest.raises(RuntimeError, match="driver lost"):
        compact(spark, job.root, "s")
    monkeypatch.setattr(sink, "commit", commit)
    assert same_rows(read_archive(spark, job.root, "s").select(*LOG_COLUMNS), log)
    assert read_pieces(spark, job.root, "s").select("stream").distinct().count() == 1
    finish_run(spark, job)
    assert same_rows(read_archive(spark, job.root, "s").select(*LOG_COLUMNS), log)
    assert compact(spark, job.root, "s")["messages_after"] == log.count()


def test_changed_rows_are_refused(spark, log):
    job = job_of(spark, segmentation="offset")
    in_batches(log, job, [0, 10**9])
    finish_run(spark, job)
    spark.read.parquet(sink.batch_folder(job.root, "s", "q", 0)).where("offset % 5 <> 0").write.parquet(
        other := scratch_path(spark, "less"))
    spark.read.parquet(other).write.mode("overwrite").partitionBy("topic", "partition").parquet(
        sink.batch_folder(job.root, "s", "q", 0))
    with pytest.raises(RuntimeError, match="differ"):
        compact(spark, job.root, "s")


def test_nothing_to_compact(spark, log):
    job = job_of(spark)
    assert compact(spark, job.root, "s") is None
    run_backup(log, job)
    assert compact(spark, job.root, "s") is None


def test_files_have_about_the_given_size(spark, log):
    job = job_of(spark, segmentation="offset")
    in_batches(log, job, [0, 10**9])
    pieces, rows = read_pieces(spark, job.root, "s"), read_archive(spark, job.root, "s")
    for size in (3, 50, 10**9):
        sizes = binned(rows, pieces, size).groupBy("topic", "partition", "_bin", "_part").agg(
            F.sum("size_bytes").alias("n"),
            F.count_distinct("segment").alias("segments")).collect()
        largest = pieces.agg(F.max("size_bytes")).first()[0]
        assert all(r.n < size + largest or r.segments == 1 for r in sizes)
        if size == 10**9:
            assert len(sizes) == len(SIZES)
        if size == 3:  # segments are larger: each comes in parts
            assert len(sizes) > pieces.count()


def test_compacted_rows_wait_for_as_many_newer_bytes(spark):
    def sized(**sizes):
        rows = spark.createDataFrame([(k.replace("_", "-"), v) for k, v in sizes.items()], "stream string, size_bytes long")
        streams = [{"stream": k.replace("_", "-"), "last_batch": 3} for k in sizes]
        return sorted(s["stream"] for s in chosen(streams, rows))

    assert sized(q=10, compact_a=100) == ["q"]
    assert sized(q=10, compact_a=100, compact_b=10) == ["compact-b", "q"]
    assert sized(q=50, r=50, compact_a=150, compact_b=60) == ["compact-a", "compact-b", "q", "r"]
    assert sized(compact_a=5, compact_b=5) == []


def test_total_before_equals_a_plain_sum(spark):
    rows = [("k", i * 3, i % 5) for i in range(50)] + [("l", -7, 2), ("l", 4, 9)]
    df = spark.createDataFrame(rows, "k string, at long, n long")
    got = {(r.k, r["at"]): r.t for r in total_before(df, ["k"], "at", "n", "t", width=10).collect()}
    assert got == {(k, at): sum(n for j, b, n in rows if j == k and b < at) for k, at, _ in rows}
