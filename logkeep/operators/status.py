"""Totals, progress, phases and counters computed from manifests and task facts."""

from pyspark.sql import functions as F


# Usual bounds of a duration histogram, in milliseconds. Fixed values.
DURATION_BOUNDS_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def backup_totals(segments, finished_at):
    """Topics, messages and bytes per backup.

    ``segments`` is a manifest with a ``done`` flag per segment and a timestamp
    column named by ``finished_at``.
    """
    done = F.col("done")
    per_topic = segments.groupBy("backup_id", "topic").agg(
        F.min("done").alias("_all"),
        F.sum(F.when(done, F.col("message_count")).otherwise(0)).alias("messages"),
        F.sum(F.when(done, F.col("size_bytes")).otherwise(0)).alias("bytes"),
        F.max(F.when(done, F.col(finished_at))).alias("last_backup_time"),
    )
    return per_topic.groupBy("backup_id").agg(
        F.count(F.lit(1)).alias("topics_discovered"),
        F.count_if("_all").alias("topics_backed_up"),
        F.sum("messages").alias("messages"),
        F.sum("bytes").alias("bytes"),
        F.max("last_backup_time").alias("last_backup_time"),
    )


def worker_totals(facts):
    """Messages, bytes, topics and last sign of life per job and worker."""
    per_topic = facts.groupBy("job_id", "worker_id", "topic").agg(
        F.sum("messages").alias("messages"),
        F.sum("bytes").alias("bytes"),
        F.max("ts").alias("last_heartbeat"),
    )
    return per_topic.groupBy("job_id", "worker_id").agg(
        F.count(F.lit(1)).alias("topics"),
        F.sum("messages").alias("messages"),
        F.sum("bytes").alias("bytes"),
        F.max("last_heartbeat").alias("last_heartbeat"),
    )


def restore_totals(facts):
    """Topics, messages and bytes per restore; failed tasks count for nothing."""
    ok = F.col("status") == "ok"
    per_topic = facts.groupBy("job_id", "topic").agg(
        F.max(ok).alias("_any"),
        F.sum(F.when(ok, F.col("messages")).otherwise(0)).alias("messages"),
        F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("bytes"),
    )
    return per_topic.groupBy("job_id").agg(
        F.count_if("_any").alias("topics_restored"),
        F.sum("messages").alias("messages"),
        F.sum("bytes").alias("bytes"),
    )


def topic_progress(planned, facts):
    """Partitions and messages done of each planned topic.

    ``planned`` holds (job_id, topic, partition). A partition is done when it has
    facts and none of them failed.
    """
    ok = F.col("status") == "ok"
    done = facts.groupBy("job_id", "topic", "partition").agg(
        F.min(ok).alias("_done"), F.sum(F.when(ok, F.col("messages")).otherwise(0)).alias("_m")
    )
    joined = planned.join(done, ["job_id", "topic", "partition"], "left")
    totals = joined.groupBy("job_id", "topic").agg(
        F.count(F.lit(1)).alias("partitions_total"),
        F.count_if(F.coalesce("_done", F.lit(False))).alias("partitions_completed"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("messages"),
    )
    complete = F.col("partitions_completed") == F.col("partitions_total")
    return totals.withColumn("status", F.when(complete, "completed").otherwise("pending"))


def error_rows(failures):
    """``Worker <n> - <location>: <error>`` for each failure, one row each.

    A failure of the whole job names no topic; its location is ``job``.
    """
    location = F.coalesce(
        F.concat(F.col("topic"), F.lit("-partition-"), F.col("partition").cast("string")), F.lit("job"))
    return failures.withColumn(
        "message",
        F.concat(
            F.lit("Worker "), F.col("worker_id").cast("string"), F.lit(" - "), location,
            F.lit(": "), F.col("error"),
        ),
    )


def job_phase(counts):
    """Phase from planned, done and failed counts.

    All done is Completed, some done PartiallyCompleted, none done Failed, once
    nothing is outstanding; before that Running, or Pending without any result.
    """
    planned, done, failed = F.col("planned"), F.col("done"), F.col("failed")
    phase = (
        F.when(done + failed == 0, "Pending")
        .when(done + failed < planned, "Running")
        .when(failed == 0, "Completed")
        .when(done > 0, "PartiallyCompleted")
        .otherwise("Failed")
    )
    return counts.withColumn("phase", phase)


def message_counters(facts):
    """Tasks, messages and bytes by job, topic and worker."""
    return facts.groupBy("job_id", "topic", "worker_id").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("messages").alias("messages"),
        F.sum("bytes").alias("bytes"),
    )


def histogram(facts, value, bounds, keys):
    """Cumulative buckets ``le``, with total count and sum, per key.

    One conditional count per bound in a single aggregation; rows are not copied.
    """
    totals = facts.groupBy(*keys).agg(
        *[F.count_if(F.col(value) <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("total_count"),
        F.sum(value).alias("total_sum"),
    )
    rows = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("bucket_count"))
        for i, b in enumerate(bounds)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("total_count").alias("bucket_count")))
    return totals.select(*keys, "total_count", "total_sum", F.inline(F.array(*rows)))


def storage_operations(facts):
    return facts.groupBy("operation", "status").agg(F.count(F.lit(1)).alias("operations"))


def job_report(states, totals):
    """Phase, topics, messages and time of each job."""
    return states.join(totals, "job_id", "left").select(
        "job_id", "kind", "phase", "created_at", F.col("ts").alias("updated_at"),
        F.coalesce("topics", F.lit(0)).alias("topics"),
        F.coalesce("messages", F.lit(0)).alias("messages"),
        (F.unix_seconds("ts") - F.unix_seconds("created_at")).alias("age_seconds"),
    )
