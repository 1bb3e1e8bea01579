"""Writing segment objects: one JSON array per segment, under its exact key.

Rows of a segment stream through one task in offset order, straight into the
object; a segment is never held as a whole.
"""

import datetime as dt
import gzip
import hashlib
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import functions as F

from logkeep.functions.messages import message_json
from logkeep.sinks.archive import checked_id
from logkeep.functions.paths import storage_key, topic_metadata_key

RESULT = (
    "backup_id string, topic string, partition int, segment bigint, start_offset bigint, "
    "end_offset bigint, message_count bigint, size_bytes bigint, storage_key string, "
    "checksum string, duration_ms bigint, attempt bigint, finished_at timestamp, "
    "first_time timestamp, last_time timestamp"
)
_RESULT_TYPE = pa.schema(
    [("backup_id", pa.string()), ("topic", pa.string()), ("partition", pa.int32()),
     ("segment", pa.int64()), ("start_offset", pa.int64()), ("end_offset", pa.int64()),
     ("message_count", pa.int64()), ("size_bytes", pa.int64()), ("storage_key", pa.string()),
     ("checksum", pa.string()), ("duration_ms", pa.int64()), ("attempt", pa.int64()),
     ("finished_at", pa.timestamp("us", tz="UTC")), ("first_time", pa.timestamp("us", tz="UTC")),
     ("last_time", pa.timestamp("us", tz="UTC"))]
)


def write_objects(segmented, root, backup_id, compressed=True, json=None, storage=None, prefix=""):
    """Write every segment and return one manifest row per object, with the facts of its writing.

    ``storage`` has the settings of an object store that the root alone does not name. The
    result is lazy: an action on it writes. A repeated task writes the same bytes to the same key.
    """
    checked_id(backup_id)
    group = ["topic", "partition", "segment"]
    # JSON and keys are made of rows in their place: they are longer than what they are made of.
    rows = segmented.repartition(*group).sortWithinPartitions(*group, "offset").select(
        F.lit(backup_id).alias("backup_id"), "topic", "partition", "segment", "offset", "timestamp",
        (message_json() if json is None else json).alias("json"),
        storage_key(
            F.lit(backup_id), F.col("topic"), F.col("partition"), F.col("segment"),
            prefix, compressed,
        ).alias("storage_key"),
    )
    address, options = address_of(root), storage.arrow_options() if storage else {}

    def write(batches):
        return _write(batches, filesystem_of(address, options), compressed)

    return rows.mapInArrow(write, RESULT)


def address_of(root):
    """A Hadoop style root as Arrow's file systems spell it."""
    if root.startswith("file:/") and not root.startswith("file://"):
        return "file://" + root[len("file:") :]
    return root.replace("s3a://", "s3://", 1)


def filesystem_of(address, options):
    """Arrow file system and base path of a root."""
    if options:
        return fs.S3FileSystem(**options), address.split("://", 1)[1]
    return fs.FileSystem.from_uri(address)


def topic_metadata_objects(topics, backup_id, prefix=""):
    """Key and JSON text of the per-topic metadata objects."""
    body = F.to_json(
        F.struct(
            F.col("name").alias("Name"),
            F.col("partitions").alias("Partitions"),
            F.col("replication_factor").alias("ReplicationFactor"),
            F.col("config").alias("Config"),
        )
    )
    return topics.select(
        topic_metadata_key(F.lit(backup_id), F.col("name"), prefix).alias("storage_key"),
        body.alias("text"),
    )


def write_texts(objects, root, storage=None):
    """Write (storage_key, text) rows as one small object each; lazy as above."""
    address, options = address_of(root), storage.arrow_options() if storage else {}

    def write(batches):
        filesystem, base = filesystem_of(address, options)
        for batch in batches:
            for row in batch.to_pylist():
                _put(filesystem, f"{base}/{row['storage_key']}", row["text"].encode())
            yield batch.select(["storage_key"])

    return objects.select("storage_key", "text").mapInArrow(write, "storage_key string")


def _put(filesystem, path, data):
    folder, name = path.rsplit("/", 1)
    filesystem.create_dir(folder, recursive=True)
    staged = f"{folder}/.{name}.{attempt_id()}"
    with filesystem.open_output_stream(staged, compression=None) as sink:
        sink.write(data)
    filesystem.move(staged, path)


class _Object:
    """One open object; it appears under its key when finished."""

    def __init__(self, filesystem, base, row, compressed):
        self.filesystem, self.first = filesystem, row
        self.path = f"{base}/{row['storage_key']}"
        folder = self.path.rsplit("/", 1)[0]
        filesystem.create_dir(folder, recursive=True)
        self.staged = f"{folder}/.{self.path.rsplit('/', 1)[1]}.{id(self)}.{attempt_id()}"
        self.sink = filesystem.open_output_stream(self.staged, compression=None)
        self.digest, self.size = hashlib.sha256(), 0
        self.count, self.last, self.started = 0, None, time.monotonic()
        self.times = []
        # No clock in the gzip head, so that a repeat gives the same bytes.
        self.gzip = gzip.GzipFile("", "wb", 6, fileobj=self, mtime=0) if compressed else None

    def write(self, data):
        self.digest.update(data)
        self.size += len(data)
        self.sink.write(bytes(data))
        return len(data)

    def flush(self):
        pass

    def add(self, joined, count, last, times):
        """Add ``count`` messages, joined by commas, the last of them at offset ``last``.

        ``times`` are the least and the greatest of their times, if they have any.
        """
        sink = self.gzip or self
        sink.write(b"," if self.count else b"[")
        sink.write(joined)
        self.count, self.last = self.count + count, last
        self.times = [*self.times, *(t for t in times if t is not None)]
        self.times = [min(self.times), max(self.times)] if self.times else []

    def finish(self):
        (self.gzip or self).write(b"]")
        if self.gzip:
            self.gzip.close()
        self.sink.close()
        self.filesystem.move(self.staged, self.path)
        row = self.first
        return (row["backup_id"], row["topic"], row["partition"], row["segment"], row["offset"],
                self.last, self.count, self.size, row["storage_key"], self.digest.hexdigest(),
                round(1000 * (time.monotonic() - self.started)), attempt_id(),
                dt.datetime.now(dt.timezone.utc), *(self.times or (None, None)))


def attempt_id():
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.taskAttemptId() if context else 0


def _runs(batch):
    """(first, count) of the rows of one object each."""
    keys = batch.column("storage_key")
    change = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _write(batches, place, compressed):
    filesystem, base = place
    current = None
    for batch in batches:
        done = []
        json, places = batch.column("json").cast(pa.binary()), batch.drop_columns(["json"])
        for first, count in _runs(batch) if batch.num_rows else ():
            row = places.slice(first, 1).to_pylist()[0]
            if current is None or current.first["storage_key"] != row["storage_key"]:
                if current is not None:
                    done.append(current.finish())
                current = _Object(filesystem, base, row, compressed)
            piece = pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), json.slice(first, count))
            joined = pc.binary_join(piece, b",")[0].as_buffer()
            span = pc.min_max(places.column("timestamp").slice(first, count)).as_py()
            current.add(joined, count, places.column("offset")[first + count - 1].as_py(), span.values())
        if done:
            yield _result(done)
    if current is not None:
        yield _result([current.finish()])


def _result(rows):
    columns = [list(c) for c in zip(*rows)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, _RESULT_TYPE)], schema=_RESULT_TYPE
    )
