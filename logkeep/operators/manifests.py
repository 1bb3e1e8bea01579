"""Segment, topic and backup manifests, checksums and storage checks."""

from pyspark.sql import functions as F

from logkeep.functions.messages import message_size, row_hash
from logkeep.functions.paths import storage_key

GROUP = ["backup_id", "topic", "partition", "segment"]
PAGE_SEGMENTS = 1000


def segment_manifest(rows, prefix="", compressed=True):
    """One row per segment: real first and last offset, count, bytes, key.

    ``rows`` may carry a stored ``size_bytes``; keys and values are then not read.
    """
    size = F.col("size_bytes") if "size_bytes" in rows.columns else message_size()
    return (
        rows.groupBy(*GROUP)
        .agg(
            F.min("offset").alias("start_offset"),
            F.max("offset").alias("end_offset"),
            F.count(F.lit(1)).alias("message_count"),
            F.sum(size).alias("size_bytes"),
        )
        .withColumn(
            "storage_key",
            storage_key(
                F.col("backup_id"), F.col("topic"), F.col("partition"), F.col("segment"),
                prefix, compressed,
            ),
        )
    )


def segment_checksums(rows, value=None):
    """Order-free checksum and count per segment.

    ``value`` is a 64-bit hash per row; by default the stored or usual one.
    """
    if value is None:
        value = F.col("row_hash") if "row_hash" in rows.columns else row_hash()
    return rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.hex(F.bit_xor(value)).alias("checksum"),
    )


def full_manifest(rows, prefix="", compressed=True):
    """Manifest and checksum in one aggregation over stored sizes and hashes."""
    return (
        rows.groupBy(*GROUP)
        .agg(
            F.min("offset").alias("start_offset"),
            F.max("offset").alias("end_offset"),
            F.count(F.lit(1)).alias("message_count"),
            F.sum("size_bytes").alias("size_bytes"),
            F.hex(F.bit_xor("row_hash")).alias("checksum"),
            F.min("timestamp").alias("first_time"),
            F.max("timestamp").alias("last_time"),
        )
        .withColumn(
            "storage_key",
            storage_key(
                F.col("backup_id"), F.col("topic"), F.col("partition"), F.col("segment"),
                prefix, compressed,
            ),
        )
    )


def topic_manifest(segments):
    """Totals per topic."""
    return (
        segments.groupBy("backup_id", "topic", "partition")
        .agg(
            F.count(F.lit(1)).alias("segments"),
            F.sum("message_count").alias("messages"),
            F.sum("size_bytes").alias("bytes"),
        )
        .groupBy("backup_id", "topic")
        .agg(
            F.count(F.lit(1)).cast("int").alias("partitions"),
            F.sum("segments").alias("segments"),
            F.sum("messages").alias("messages"),
            F.sum("bytes").alias("bytes"),
        )
    )


def nested_manifest(segments, page_segments=PAGE_SEGMENTS):
    """Nested segment lists in pages of bounded length.

    A backup can hold more segments than fit one row, so the list of a
    topic-partition is cut into pages of consecutive segment numbers.
    """
    page = F.expr(f"segment div {int(page_segments)}").cast("bigint")
    entry = F.struct(
        F.col("segment").alias("segment_number"),
        "start_offset",
        "end_offset",
        "message_count",
        "size_bytes",
        "storage_key",
    )
    return (
        segments.groupBy("backup_id", "topic", "partition", page.alias("page"))
        .agg(F.sort_array(F.collect_list(entry)).alias("segments"))
    )


def segments_of(segments, topic, partition):
    """Segments of one topic-partition."""
    return segments.where((F.col("topic") == topic) & (F.col("partition") == partition))


def manifest_against_objects(segments, objects):
    """Segments without object, objects without segment, and wrong sizes."""
    left = segments.select("storage_key", F.col("size_bytes").alias("manifest_bytes"))
    right = objects.select("storage_key", F.col("size_bytes").alias("object_bytes"))
    finding = (
        F.when(F.col("object_bytes").isNull(), "missing")
        .when(F.col("manifest_bytes").isNull(), "orphan")
        .when(F.col("object_bytes") != F.col("manifest_bytes"), "size_mismatch")
    )
    return (
        left.join(right, "storage_key", "full_outer")
        .withColumn("finding", finding)
        .where(F.col("finding").isNotNull())
    )
