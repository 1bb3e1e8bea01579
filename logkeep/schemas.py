"""Schemas shared by sources, operators and sinks."""

from pyspark.sql import types as T

HEADERS = T.ArrayType(
    T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]
    )
)

# Same names and types as the Kafka source with includeHeaders=true.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("headers", HEADERS),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# size_bytes and row_hash are stored so that manifests and checks never read
# keys and values again.
ARCHIVE_SCHEMA = T.StructType(
    [
        T.StructField("segment", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("headers", HEADERS),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("row_hash", T.LongType()),
        T.StructField("backup_id", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
    ]
)

SEGMENTS_SCHEMA = (
    "backup_id string, topic string, partition int, segment bigint, "
    "start_offset bigint, end_offset bigint, message_count bigint, "
    "size_bytes bigint, storage_key string, checksum string, first_time timestamp, last_time timestamp"
)
# What one file of a micro-batch added to a segment.
PIECES_SCHEMA = (
    "backup_id string, stream string, batch bigint, topic string, partition int, segment bigint, "
    "start_offset bigint, end_offset bigint, message_count bigint, offsets bigint, "
    "size_bytes bigint, checksum bigint, first_time timestamp, last_time timestamp, file string, closed_at timestamp, started_at timestamp"
)
# A committed state of a backup: its number, the id of its catalog rows, where its rows lie, and
# its entry in the catalog of backups. Of a stream the batches behind ``after`` up to
# ``last_batch`` count; those before were compacted into another stream.
SNAPSHOTS_SCHEMA = (
    "backup_id string, number bigint, snapshot string, layout string, prefix string, "
    "streams array<struct<stream:string,last_batch:bigint,after:bigint>>, timestamp timestamp, version string, "
    "compression boolean, config map<string,string>, topics array<string>"
)
TOPICS_SCHEMA = (
    "name string, partitions int, replication_factor smallint, config map<string,string>"
)
BACKUPS_SCHEMA = (
    "backup_id string, timestamp timestamp, version string, compression boolean, "
    "config map<string,string>, topics array<string>"
)
JOB_EVENTS_SCHEMA = (
    "job_id string, kind string, seq bigint, ts timestamp, phase string, "
    "source_id string, storage_id string, target_id string, backup_id string, "
    "deleted boolean, error string"
)
TASK_FACTS_SCHEMA = (
    "job_id string, topic string, partition int, worker_id int, messages bigint, "
    "bytes bigint, duration_ms bigint, operation string, status string, ts timestamp, "
    "file string, attempt bigint, error string"
)

# Fixed names of phases.
BACKUP_PHASES = ("Pending", "Running", "Completed", "Failed", "Suspended")
RESTORE_PHASES = (
    "Pending", "Validating", "Running", "Completed", "Failed", "PartiallyCompleted",
)

# Why a job is refused. Fixed texts.
NO_SOURCE_CLUSTER = "source cluster is required"
NO_TARGET_STORAGE = "target storage is required"
NO_SELECTOR = "at least one topic selector is required"
NO_WORKER = "at least one worker is required"
NO_BATCH = "batch size must be at least 1"
NO_SOURCE_STORAGE = "source storage is required"
NO_TARGET_CLUSTER = "target cluster is required"
NO_BACKUP = "either backup ID or timestamp is required"
ALREADY_RUNNING = "job is already running"
NOT_RUNNING = "job is not running"

# JSON form of one message inside a segment object. Fixed field names.
MESSAGE_JSON_SCHEMA = T.StructType(
    [
        T.StructField("Offset", T.LongType()),
        T.StructField("Partition", T.IntegerType()),
        T.StructField("Key", T.BinaryType()),
        T.StructField("Value", T.BinaryType()),
        T.StructField("Timestamp", T.TimestampType()),
        T.StructField(
            "Headers",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("Key", T.StringType()),
                        T.StructField("Value", T.BinaryType()),
                    ]
                )
            ),
        ),
    ]
)
