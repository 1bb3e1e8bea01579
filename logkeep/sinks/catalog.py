"""Append-only log of job states.

Each job has a folder of numbered events. An event is created only if its number is free, so
of two drivers that start a job at once one is refused. While a job runs, its driver keeps
writing one more small file, the heartbeat, which repeats the running event with the present
time. A running job without a sign of life for ``LEASE_SECONDS`` counts as failed: it is
listed so, and it may be started again.
"""

import contextlib
import datetime as dt
import json
import threading

from pyspark.errors import AnalysisException

from logkeep.schemas import (
    ALREADY_RUNNING, BACKUP_PHASES, JOB_EVENTS_SCHEMA, NOT_RUNNING, RESTORE_PHASES)
from logkeep.sinks import commits

LEASE_SECONDS = 300
BEAT_SECONDS = 30
#: Why a running job counts as failed, and why a restore that was stopped does.
LOST = "no sign of life"
STOPPED = "stopped on request"
_BEAT = "heartbeat.json"


def jobs_path(root):
    return f"{root}/catalog/jobs"


def _folder(root, job_id):
    return f"{jobs_path(root)}/job_id={job_id}"


def _now():
    return dt.datetime.now(dt.timezone.utc)


def event(number, kind, phase, deleted=False, **fields):
    known = BACKUP_PHASES if kind == "backup" else RESTORE_PHASES
    if phase not in known:
        raise ValueError(f"unknown phase of a {kind}: {phase}")
    return {"kind": kind, "seq": number, "ts": _now().isoformat(), "phase": phase, "deleted": deleted,
            **{k: v for k, v in fields.items() if v is not None}}


def append(spark, root, job_id, decide):
    """Append the event that ``decide(number, last event)`` gives."""
    return commits.append(spark, _folder(root, job_id), decide)


def record(spark, root, job_id, kind, phase, deleted=False, **fields):
    """Append one status event of a job; nothing is updated in place.

    ``deleted`` writes a tombstone; segments stay where they are.
    """
    event(0, kind, phase)  # refused before anything is read
    return append(spark, root, job_id, lambda number, last: event(
        number + 1, kind, phase, deleted, **fields))


def read_events(spark, root, beats=False):
    """All job events, on request with the heartbeats of running jobs; none if nothing was recorded yet."""
    reader = spark.read.schema(JOB_EVENTS_SCHEMA).option("pathGlobFilter", "*.json" if beats else "[0-9]*.json")
    try:
        return reader.json(jobs_path(root))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], JOB_EVENTS_SCHEMA)


def last_event(spark, root, job_id):
    """Newest event of a job as a dict, None if it is unknown; the driver reads two small files."""
    folder = _folder(root, job_id)
    _, last = commits.newest(spark, folder)
    if last is None:
        return None
    if last["phase"] == "Running":
        with contextlib.suppress(Exception):  # no heartbeat yet
            beat = json.loads(commits.read_text(spark, f"{folder}/{_BEAT}"))
            if beat["seq"] == last["seq"]:
                return beat
    return last


def _alive(event, lease):
    silent = _now() - dt.datetime.fromisoformat(event["ts"])
    return event["phase"] == "Running" and silent.total_seconds() <= lease


def phase_of(spark, root, job_id, lease=LEASE_SECONDS):
    """Phase of a job, None if it is unknown or deleted."""
    event = last_event(spark, root, job_id)
    if event is None or event["deleted"]:
        return None
    return "Failed" if event["phase"] == "Running" and not _alive(event, lease) else event["phase"]


def begin(spark, root, job_id, kind, lease=LEASE_SECONDS, **fields):
    """Record that a job runs; refused while it runs already.

    A job whose driver gave no sign of life for ``lease`` seconds is recorded as failed first.
    """
    def decide(number, last):
        seen = last_event(spark, root, job_id) if last else None
        if seen is not None and not seen["deleted"] and seen["phase"] == "Running":
            if seen["seq"] != number or _alive(seen, lease):
                raise ValueError(ALREADY_RUNNING)
            return event(number + 1, seen["kind"], "Failed", error=LOST)
        return event(number + 1, kind, "Running", **fields)

    while True:
        _, made = append(spark, root, job_id, decide)
        if made["phase"] == "Running":
            return made


def beat(spark, root, job_id):
    """Repeat the running event with the present time; nothing if the job does not run."""
    folder = _folder(root, job_id)
    _, last = commits.newest(spark, folder)
    if last is not None and last["phase"] == "Running" and not last["deleted"]:
        commits.replace(spark, f"{folder}/{_BEAT}", json.dumps({**last, "ts": _now().isoformat()}))


@contextlib.contextmanager
def beating(spark, root, job_id, seconds=BEAT_SECONDS):
    """Heartbeats of a job from a thread of the driver, while the block runs."""
    done = threading.Event()

    def keep():
        while not done.wait(seconds):
            with contextlib.suppress(Exception):  # a missed beat is no reason to fail
                beat(spark, root, job_id)

    thread = threading.Thread(target=keep, daemon=True, name=f"beat-{job_id}")
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        commits.delete(spark, f"{_folder(root, job_id)}/{_BEAT}")


def stop(spark, root, job_id):
    """Record that a running job was stopped; what it wrote stays.

    A backup is then Suspended. Restores have no such phase: a stopped one is Failed, says so,
    and can be started again.
    """
    def decide(number, last):
        if last is None or last["deleted"] or last["phase"] != "Running":
            raise ValueError(NOT_RUNNING)
        kept = {k: last.get(k) for k in ("source_id", "storage_id", "target_id", "backup_id")}
        if last["kind"] == "backup":
            return event(number + 1, "backup", "Suspended", **kept)
        return event(number + 1, last["kind"], "Failed", error=STOPPED, **kept)

    append(spark, root, job_id, decide)


def delete(spark, root, job_id, kind="backup"):
    """Mark a job as deleted; it is listed and restored no more, its segments stay."""
    def decide(number, last):
        phase = phase_of(spark, root, job_id)
        if phase is None:
            raise LookupError(f"no job {job_id}")
        if phase == "Running":
            raise ValueError(ALREADY_RUNNING)
        return event(number + 1, kind, phase, deleted=True, backup_id=job_id if kind == "backup" else None)

    append(spark, root, job_id, decide)
