"""Writing the Parquet archive and its manifests.

A run writes new folders, beside those of the run before, and its catalog rows under a new
snapshot. Only the commit of a numbered snapshot record makes them the backup's; a run that
dies earlier leaves the backup as it was.
"""

import datetime as dt
import json
import re
import uuid

from pyspark.sql import functions as F

from logkeep.functions.messages import message_size, row_hash
from logkeep.functions.paths import storage_key
from logkeep.operators.manifests import full_manifest, nested_manifest
from logkeep.operators.ordering import BUCKET_ROWS, bucket_of
from logkeep.schemas import ARCHIVE_SCHEMA, SEGMENTS_SCHEMA
from logkeep.sinks import commits
from logkeep.sources.archive import (
    backup_path, data_path, once, overlaps, read_pieces, rows_of_streams, snapshot_of, snapshots_path)

FOLDERS = ("backup_id", "stream", "batch")
#: Stream name of backups that are not streamed.
ONCE = "once"


def checked_id(backup_id):
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", backup_id):
        raise ValueError(f"not usable as a folder name: {backup_id}")
    return backup_id


def clustered(rows, width=BUCKET_ROWS):
    """Bring each (topic, partition, offset range) to one task, in order.

    A hot partition is spread over its ranges; each range becomes one file.
    """
    placed = rows.withColumn("_range", bucket_of("offset", width))
    return (
        placed.repartition("topic", "partition", "_range")
        .sortWithinPartitions("topic", "partition", "_range", "offset")
        .drop("_range")
    )


def write_rows(segmented, root, backup_id, batch=0, cluster=True, codec="zstd", stream=ONCE):
    """Write one batch of a backup; a repeated batch of the same stream replaces itself."""
    stored = segmented.withColumn("size_bytes", message_size()).withColumn(
        "row_hash", row_hash()
    )
    columns = [c for c in ARCHIVE_SCHEMA.fieldNames() if c not in FOLDERS]
    if cluster:
        stored = clustered(stored)
    else:
        stored = stored.sortWithinPartitions("topic", "partition", "offset")
    (
        stored.select(*columns)
        .write.mode("overwrite")
        .partitionBy("topic", "partition")
        .option("compression", codec)
        .parquet(batch_folder(root, backup_id, stream, batch))
    )


def batch_folder(root, backup_id, stream, batch):
    home = f"{backup_path(root, checked_id(backup_id))}/stream={checked_id(stream)}"
    return f"{home}/batch={int(batch)}"


def read_batch(spark, root, backup_id, stream, batch):
    """Rows of one batch, and nothing else listed."""
    folder = batch_folder(root, backup_id, stream, batch)
    return spark.read.schema(ARCHIVE_SCHEMA).option("basePath", data_path(root)).parquet(folder)


def file_totals(rows, offsets=True):
    """Totals of each segment in each file that holds a part of it.

    Distinct ``offsets`` tell whether a stream read a range twice; counting them shuffles every
    row, so a bounded run, of which nothing is read again, leaves them out.

    One aggregation over stored sizes and hashes gives the manifest and, by file, the facts of
    the tasks that wrote them: a file's time is when its task closed it.
    """
    return rows.groupBy(
        "topic", "partition", "segment", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("closed_at"),
    ).agg(
        F.min("offset").alias("start_offset"),
        F.max("offset").alias("end_offset"),
        F.count(F.lit(1)).alias("message_count"),
        *([F.count_distinct("offset").alias("offsets")] if offsets else []),
        F.sum("size_bytes").alias("size_bytes"),
        F.bit_xor("row_hash").alias("checksum"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def added_up(totals):
    """Manifest columns of each segment from totals of its parts."""
    return totals.groupBy("topic", "partition", "segment").agg(
        F.min("start_offset").alias("start_offset"),
        F.max("end_offset").alias("end_offset"),
        F.sum("message_count").alias("message_count"),
        F.sum("size_bytes").alias("size_bytes"),
        F.hex(F.bit_xor("checksum")).alias("checksum"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )


def write_manifest(spark, root, backup_id, snapshot, totals, prefix="", compressed=True):
    """Segment manifest of a backup from its file totals."""
    own = added_up(totals).withColumn("storage_key", storage_key(
        F.lit(backup_id), F.col("topic"), F.col("partition"), F.col("segment"), prefix, compressed))
    store_manifest(own, root, backup_id, snapshot)


def write_pieces(totals, root, backup_id, stream, batch, started):
    """What each file of one micro-batch added, from its file totals."""
    path = f"{root}/catalog/pieces/backup_id={backup_id}/stream={stream}/batch={int(batch)}"
    totals.withColumn("started_at", F.lit(started)).write.mode("overwrite").parquet(path)


def write_pieced_manifest(spark, root, backup_id, snapshot, prefix="", compressed=True):
    """Segment manifest of a streamed backup; gives the streams that it covers.

    Pieces of a segment add up; only segments with overlapping pieces are counted again
    from the rows. Batches that a stream adds meanwhile belong to the next snapshot.
    """
    pieces, place = read_pieces(spark, root, backup_id), ["topic", "partition", "segment"]
    covered = [{"stream": r.stream, "last_batch": r.last_batch} for r in pieces.groupBy("stream").agg(
        F.max("batch").alias("last_batch")).collect()]
    # what a compaction replaced stays replaced, whether or not its stream goes on
    earlier = (snapshot_of(spark, root, backup_id) or {"streams": []})["streams"]
    after = {s["stream"]: s["after"] for s in earlier if s.get("after") is not None}
    ended = {s["stream"]: s["last_batch"] for s in covered}
    covered = [{"stream": s, "last_batch": ended.get(s, after.get(s)), "after": after.get(s)}
               for s in sorted({*ended, *after})]
    pieces = up_to_batches(pieces, covered)
    twice = overlaps(pieces)
    copied = bool(twice.take(1))
    once_only = pieces.join(twice, place, "left_anti") if copied else pieces
    whole = added_up(once_only).withColumn("backup_id", F.lit(backup_id)).withColumn("storage_key", storage_key(
        F.col("backup_id"), *map(F.col, place), prefix, compressed))
    if copied:
        rows = rows_of_streams(spark, root, backup_id, covered)
        again = full_manifest(once(rows.join(twice, place, "left_semi"), twice), prefix, compressed)
        whole = whole.unionByName(again)
    store_manifest(whole, root, backup_id, snapshot)
    return covered


def up_to_batches(rows, streams, beyond=False):
    """Rows of the named streams' batches up to the last one named, or all but those."""
    known = F.lit(False)
    for s in streams:
        known = known | ((F.col("stream") == s["stream"]) & (F.col("batch") <= s["last_batch"]))
    return rows.where(~known if beyond else known)


def new_snapshot():
    """Id under which a run writes its catalog rows before they count."""
    return uuid.uuid4().hex


def _home(root, table, backup_id, snapshot):
    return f"{root}/catalog/{table}/backup_id={checked_id(backup_id)}/snapshot={snapshot}"


def entry_of(timestamp, compression, config, topics=(), version="1"):
    """Catalog entry of a backup; a time without a zone is UTC."""
    moment = dt.datetime.fromisoformat(timestamp) if isinstance(timestamp, str) else timestamp
    moment = moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)
    return {"timestamp": moment.isoformat(), "version": version, "compression": compression,
            "config": {str(k): str(v) for k, v in config.items()}, "topics": list(topics)}


def commit(spark, root, backup_id, base, snapshot, entry, layout="archive", prefix="", streams=(),
           only=None):
    """Make a snapshot the newest one of its backup, if ``base`` still is.

    Until then readers see the snapshot before, whatever was written. Two runs that started
    from the same snapshot cannot both commit. What no snapshot names any more is removed, of
    the streams in ``only`` if that is given.
    """
    number = base + 1
    record = {"number": number, "snapshot": snapshot, "layout": layout, "prefix": prefix,
              "streams": list(streams), **entry}
    folder = f"{snapshots_path(root)}/backup_id={checked_id(backup_id)}"
    if not commits.create_if_absent(spark, f"{folder}/{commits.file_name(number)}", json.dumps(record)):
        raise RuntimeError(f"another run of {backup_id} committed first")
    _sweep(spark, root, backup_id, record, only)
    return record


def base_of(spark, root, backup_id):
    """(number, record) of the newest snapshot, (-1, None) before the first."""
    return commits.newest(spark, f"{snapshots_path(root)}/backup_id={checked_id(backup_id)}")


def _sweep(spark, root, backup_id, record, only=None):
    """Remove rows and catalog rows of superseded and unfinished runs; folders only are listed."""
    kept = {f"stream={s['stream']}" for s in record["streams"]}
    own = f"backup_id={backup_id}"
    for home in (f"{data_path(root)}/{own}", f"{root}/catalog/pieces/{own}"):
        _keep(spark, home, kept, only if only is None else {f"stream={s}" for s in only})
        for s in record["streams"]:
            if s.get("after") is not None:
                folder = f"{home}/stream={s['stream']}"
                _keep(spark, folder, {n for n, _ in commits.children(spark, folder) if (
                    not n.startswith("batch=") or int(n.split("=")[1]) > s["after"])})
    for table in ("segments", "topics", "pages"):
        _keep(spark, f"{root}/catalog/{table}/{own}", {f"snapshot={record['snapshot']}"})
    if record["layout"] == "objects":
        _keep(spark, f"{root}/runs/{own}", {record["prefix"].rsplit("/", 1)[-1]} if record["prefix"] else set())
        if record["prefix"]:
            commits.delete(spark, f"{root}/backups/{backup_id}/topics")


def _keep(spark, folder, kept, only=None):
    for name, _ in commits.children(spark, folder):
        if name not in kept and (only is None or name in only):
            commits.delete(spark, f"{folder}/{name}")


def store_manifest(manifest, root, backup_id, snapshot):
    manifest.drop("backup_id").write.mode("overwrite").parquet(_home(root, "segments", backup_id, snapshot))


def stored_manifest(spark, root, backup_id, snapshot, schema=SEGMENTS_SCHEMA):
    """Segment rows of a snapshot, committed or not."""
    return spark.read.schema(schema).parquet(_home(root, "segments", backup_id, snapshot)).withColumn(
        "backup_id", F.lit(backup_id))


def write_topics(topics, root, backup_id, snapshot):
    topics.write.mode("overwrite").parquet(_home(root, "topics", backup_id, snapshot))


def write_pages(segments, root, backup_id, snapshot):
    """Nested segment lists of a backup, in pages of bounded length."""
    path = _home(root, "pages", backup_id, snapshot)
    nested_manifest(segments).drop("backup_id").write.mode("overwrite").parquet(path)
