"""Reports on an archive's jobs, from their events, manifests and facts."""

import datetime as dt

from pyspark.sql import functions as F

from logkeep.operators import catalog as states
from logkeep.operators import status
from logkeep.sinks import catalog
from logkeep.sinks.facts import read_facts
from logkeep.sources.archive import read_segments


def job_states(spark, root, moment=None):
    """Newest state of each job; running jobs without a sign of life are Failed."""
    found = states.latest_state(catalog.read_events(spark, root, beats=True))
    return states.with_liveness(found, moment or dt.datetime.now(dt.timezone.utc), catalog.LEASE_SECONDS)


def job_totals(facts):
    """Topics and messages written without failure, and failures, of each job."""
    written = F.col("operation") == "put"
    ok = written & (F.col("status") == "ok")
    per_topic = facts.groupBy("job_id", "topic").agg(
        F.max(ok & F.col("topic").isNotNull()).alias("_any"),
        F.sum(F.when(ok, F.col("messages")).otherwise(0)).alias("messages"),
        F.count_if(F.col("status") == "failed").alias("errors"))
    return per_topic.groupBy("job_id").agg(
        F.count_if("_any").alias("topics"), F.sum("messages").alias("messages"), F.sum("errors").alias("errors"))


def job_report(spark, root, moment=None):
    """Phase, topics, messages, age and number of errors of each job."""
    totals = job_totals(read_facts(spark, root))
    report = status.job_report(job_states(spark, root, moment), totals)
    return report.join(totals.select("job_id", "errors"), "job_id", "left").na.fill({"errors": 0})


def backup_totals(spark, root):
    """Topics, messages, bytes and last write of each backup's newest snapshot.

    A segment counts as done unless a task failed in its topic-partition.
    """
    place = ["backup_id", "topic", "partition"]
    facts = read_facts(spark, root).withColumnRenamed("job_id", "backup_id").groupBy(*place).agg(
        F.max("ts").alias("finished_at"), F.max(F.col("status") == "failed").alias("_failed"))
    segments = read_segments(spark, root).join(facts, place, "left").withColumn(
        "done", ~F.coalesce("_failed", F.lit(False)))
    return status.backup_totals(segments, "finished_at")


def worker_totals(spark, root, job_id=None):
    return status.worker_totals(read_facts(spark, root, job_id).where("topic IS NOT NULL"))


def restore_totals(spark, root, restore_id):
    return status.restore_totals(read_facts(spark, root, restore_id).where("operation = 'put'"))


def errors(spark, root, job_id):
    """``Worker <n> - <location>: <error>`` of each failed task of a job."""
    return status.error_rows(read_facts(spark, root, job_id).where("status = 'failed'"))


def durations(spark, root, job_id=None):
    """Histogram of task durations by job and operation."""
    facts = read_facts(spark, root, job_id).where("duration_ms IS NOT NULL")
    return status.histogram(facts, "duration_ms", status.DURATION_BOUNDS_MS, ["job_id", "operation"])
