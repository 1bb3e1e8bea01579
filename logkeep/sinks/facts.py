"""Facts of finished tasks: what was written or read, how long it took, how it ended.

Every run of a job adds a folder of facts. They come from the writing itself: an object's from
the task that wrote or read it, a Parquet file's from the totals that make the manifest, so
nothing is scanned for them. A Parquet file took from the close of the file before it in the
same task, the first of a task from the start of the run.
"""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from logkeep.functions.hashing import seeded_bucket
from logkeep.schemas import TASK_FACTS_SCHEMA
from logkeep.sinks.archive import checked_id
from logkeep.sources.archive import read_below

COLUMNS = [c.split()[0] for c in TASK_FACTS_SCHEMA.split(", ")]


def facts_path(root):
    return f"{root}/catalog/facts"


def _facts(rows, job_id, **columns):
    have = {"job_id": F.lit(job_id), **columns}
    kinds = dict(c.split(" ") for c in TASK_FACTS_SCHEMA.split(", "))
    missing = F.lit(None)
    return rows.select(*[
        have.get(c, F.col(c) if c in rows.columns else missing).cast(kinds[c]).alias(c) for c in COLUMNS])


def of_objects(objects, job_id, operation="put"):
    """Facts of written objects, from their manifest rows."""
    return _facts(objects, job_id, messages=F.col("message_count"), bytes=F.col("size_bytes"),
                  operation=F.lit(operation), status=F.lit("ok"), ts=F.col("finished_at"),
                  file=F.col("storage_key"))


def of_files(totals, job_id, started=None, operation="put"):
    """Facts of Parquet files, from totals by file; a file holds rows of one topic-partition.

    Their writing began at ``started``, or at each row's ``started_at``.
    """
    if started is not None:
        totals = totals.withColumn("started_at", F.lit(started))
    per_file = totals.groupBy("topic", "partition", "file", "started_at").agg(
        F.sum("message_count").alias("messages"), F.sum("size_bytes").alias("bytes"),
        F.max("closed_at").alias("ts"),
        *[F.max(c).alias(c) for c in ("status", "error") if c in totals.columns])
    # files of one task carry its number, in the order of their writing
    task = F.regexp_extract("file", r"part-(\d+)-", 1)
    before = F.lag("ts").over(Window.partitionBy("started_at", task).orderBy("ts", "topic", "partition", "file"))
    since = F.coalesce(before, F.col("started_at"))
    took = F.greatest(F.lit(0), F.unix_millis("ts") - F.unix_millis(since))
    more = {} if "status" in per_file.columns else {"status": F.lit("ok")}
    return _facts(per_file.withColumn("duration_ms", took), job_id, operation=F.lit(operation), **more)


def of_adopted(manifest, left_out, job_id, started):
    """Facts of objects that were read to be adopted; unreadable ones failed."""
    took = {"operation": F.lit("get"), "ts": F.lit(started)}
    good = _facts(manifest, job_id, messages=F.col("message_count"), bytes=F.col("size_bytes"),
                  status=F.lit("ok"), file=F.col("storage_key"), **took)
    bad = _facts(left_out, job_id, messages=F.lit(0), bytes=F.lit(0), status=F.lit("failed"),
                 file=F.col("path"), **took)
    return good.unionByName(bad)


def of_opened(opened, job_id):
    """Facts of objects that a restore read."""
    state = F.when(F.col("error").isNull(), "ok").otherwise("failed")
    return _facts(opened, job_id, operation=F.lit("get"), status=state, ts=F.col("finished_at"),
                  file=F.col("storage_key"))


def of_missing(outcomes, job_id, moment):
    """Failed facts of partitions of which nothing was written."""
    return _facts(outcomes, job_id, bytes=F.lit(0), operation=F.lit("put"), ts=F.lit(moment))


def by_worker(facts, workers=1, seed=0):
    """Facts with the worker to which a job's topics are dealt."""
    return facts.withColumn("worker_id", seeded_bucket(F.col("topic"), seed, workers).cast("int"))


def write(facts, root, job_id, run):
    """Add one run's facts; a repeated run replaces its own."""
    path = f"{facts_path(root)}/job_id={checked_id(job_id)}/run={checked_id(run)}"
    facts.drop("job_id").write.mode("overwrite").parquet(path)


def read_facts(spark, root, job_id=None):
    """Facts of one job's runs, or of all jobs."""
    path = facts_path(root)
    home = path if job_id is None else f"{path}/job_id={job_id}"
    return read_below(spark, f"{TASK_FACTS_SCHEMA}, run string", home, basePath=path).drop("run")


def record_failure(spark, root, job_id, operation, error, started):
    """One failed fact for a run that ended early; it names no topic."""
    now = dt.datetime.now(dt.timezone.utc)
    took = F.lit(round((now - started).total_seconds() * 1000))
    rows = _facts(spark.range(1), job_id, worker_id=F.lit(0), messages=F.lit(0), bytes=F.lit(0), duration_ms=took,
                  operation=F.lit(operation), status=F.lit("failed"), ts=F.lit(now), error=F.lit(str(error)))
    write(rows.coalesce(1), root, job_id, f"failed-{now.timestamp():.6f}")
