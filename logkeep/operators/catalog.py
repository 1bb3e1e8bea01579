"""Job and backup catalogs as append-only tables."""

from pyspark.sql import functions as F

from logkeep import schemas
from logkeep.operators.ordering import previous_within


def latest_state(job_events, with_deleted=False):
    """Last event of each job and the time of its first one.

    Jobs whose last event is a tombstone drop out.
    """
    payload = [c for c in job_events.columns if c not in ("job_id", "seq")]
    # events of two writers may share a number: all their fields break the tie
    last = job_events.groupBy("job_id").agg(
        F.max(F.struct("seq", *payload)).alias("_last"),
        F.min("ts").alias("created_at"),
    ).select("job_id", "_last.*", "created_at")
    return last if with_deleted else last.where(~F.col("deleted"))


def deleted_jobs(job_events):
    return latest_state(job_events, with_deleted=True).where("deleted")


def state_of(job_events, job_id):
    """State of one job; the id reaches the scan."""
    return latest_state(job_events.where(F.col("job_id") == job_id))


def with_liveness(states, moment, lease_seconds=300):
    """Running jobs without an event or heartbeat since ``lease_seconds`` before ``moment`` as Failed.

    A heartbeat is an event with the number of the one that it repeats, at a later time.
    """
    silent = F.unix_seconds(F.lit(moment).cast("timestamp")) - F.unix_seconds("ts") > lease_seconds
    lost = (F.col("phase") == "Running") & silent
    return states.withColumn("phase", F.when(lost, "Failed").otherwise(F.col("phase")))


def list_jobs(states, kind, phase=None, source_id=None, storage_id=None,
              backup_id=None, target_id=None, created_from=None, created_to=None):
    """Job states of one kind; unset filters are skipped."""
    wanted = {"phase": phase, "source_id": source_id, "storage_id": storage_id,
              "backup_id": backup_id, "target_id": target_id}
    out = states.where(F.col("kind") == kind)
    for name, value in wanted.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return _between(out, "created_at", created_from, created_to)


def filter_backups(backups, since=None, until=None, topics=None):
    """Backups in a time range that hold any of the topics."""
    out = _between(backups, "timestamp", since, until)
    if topics:
        names = F.array(*[F.lit(t) for t in topics])
        out = out.where(F.arrays_overlap("topics", names))
    return out


def page(backups, limit, offset=0):
    """One page, newest first."""
    return backups.orderBy(F.col("timestamp").desc(), "backup_id").offset(offset).limit(limit)


def _between(df, column, since, until):
    if since is not None:
        df = df.where(F.col(column) >= F.lit(since))
    if until is not None:
        df = df.where(F.col(column) <= F.lit(until))
    return df


#: A day of microseconds, the unit in which jobs number their events.
EVENT_WIDTH = 86_400_000_000


def live_backups(backups, job_events):
    """Backups that were not deleted."""
    gone = deleted_jobs(job_events).where("kind = 'backup'").select(F.col("job_id").alias("backup_id"))
    return backups.join(gone, "backup_id", "left_anti")


def illegal_transitions(job_events, width=EVENT_WIDTH):
    """Starts of a running job and stops of a job that is not running."""
    narrow = job_events.select("job_id", "seq", "phase")
    stepped = previous_within(narrow, ["job_id"], "seq", ["phase"], width=width)
    was_running = F.coalesce(F.col("prev_phase") == "Running", F.lit(False))
    problem = F.when((F.col("phase") == "Running") & was_running, "already running").when(
        (F.col("phase") == "Suspended") & ~was_running, "not running"
    )
    return stepped.withColumn("problem", problem).where(F.col("problem").isNotNull())


def check_backup_jobs(jobs):
    """Reasons why a backup job is refused."""
    return _with_errors(
        jobs,
        (F.col("source_id").isNull(), schemas.NO_SOURCE_CLUSTER),
        (F.col("storage_id").isNull(), schemas.NO_TARGET_STORAGE),
        (F.coalesce(F.col("selectors"), F.lit(0)) < 1, schemas.NO_SELECTOR),
        (F.coalesce(F.col("workers"), F.lit(0)) < 1, schemas.NO_WORKER),
        (F.coalesce(F.col("batch_size"), F.lit(0)) < 1, schemas.NO_BATCH),
    )


def check_restore_jobs(jobs):
    """Reasons why a restore job is refused."""
    no_backup = F.coalesce(F.col("backup_id"), F.lit("")) == ""
    return _with_errors(
        jobs,
        (F.col("storage_id").isNull(), schemas.NO_SOURCE_STORAGE),
        (F.col("target_id").isNull(), schemas.NO_TARGET_CLUSTER),
        (no_backup & F.col("backup_timestamp").isNull(), schemas.NO_BACKUP),
        (F.coalesce(F.col("workers"), F.lit(0)) < 1, schemas.NO_WORKER),
    )


def _with_errors(jobs, *rules):
    found = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))
    return jobs.withColumn("errors", found).withColumn("ok", F.size("errors") == 0)
