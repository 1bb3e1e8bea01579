"""Choosing, renaming, ordering and de-duplicating rows of a restore."""

import functools
import math
import operator

from pyspark.sql import Window
from pyspark.sql import functions as F

from logkeep.functions.messages import fingerprint
from logkeep.operators.joins import join_small
from logkeep.session import stored
from logkeep.operators.ordering import (
    BUCKET_ROWS,
    bucket_of,
    last_marker,
    number_rows,
    number_within,
)


def _literal_map(pairs):
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def partition_predicate(partition_filter, topic="topic", partition="partition"):
    """No filter or an unlisted topic keeps all; a listed topic its ids only."""
    if not partition_filter:
        return F.lit(True)
    name, number = F.col(topic), F.col(partition)
    listed = [
        (name == t) & number.isin(*ids) for t, ids in partition_filter.items() if ids
    ]
    unlisted = ~name.isin(*partition_filter)
    return functools.reduce(operator.or_, listed, unlisted)


def filter_partitions(rows, partition_filter):
    return rows.where(partition_predicate(partition_filter))


def rename_topics(rows, mapping):
    """``target_topic``: the mapped name, or the topic's own."""
    name = F.col("topic")
    target = F.coalesce(_literal_map(mapping)[name], name) if mapping else name
    return rows.withColumn("target_topic", target)


def up_to(rows, moment):
    """Point-in-time cut on the message timestamp."""
    return rows.where(F.col("timestamp") <= F.lit(moment))


REPLAY_ORDER = ["target_topic", "partition", "topic", "segment", "offset"]


def in_replay_order(rows):
    """Rows of each task in replay order; nothing is shuffled.

    The archive keeps ranges of a partition together, so a task holds whole runs.
    """
    return rows.sortWithinPartitions(*REPLAY_ORDER)


def in_total_order(rows):
    """Tasks that follow each other in replay order; a hot partition spans several.

    Costs a second scan, which finds the ranges, and a shuffle.
    """
    return rows.repartitionByRange(*REPLAY_ORDER).sortWithinPartitions(*REPLAY_ORDER)


def with_replay_position(rows, width=BUCKET_ROWS):
    """0-based replay position inside each target partition."""
    placed = rows.withColumn("_range", bucket_of("offset", width))
    return number_within(
        placed,
        ["target_topic", "partition"],
        ["topic", "offset"],
        "position",
        buckets=["topic", "_range"],
    ).drop("_range")


def restore_chunks(topics, workers):
    """Contiguous chunks of ``ceil(n / workers)`` topics in name order."""
    names = topics.select("topic")
    size = max(1, math.ceil(names.count() / workers))
    ranked = number_rows(names, [], ["topic"], "_rank")
    return ranked.select(
        "topic", F.expr(f"_rank div {size}").cast("int").alias("worker_id")
    )


def topics_to_create(source_topics, existing, mapping):
    """Target topics that do not exist yet, one row each.

    Several sources on one target give the larger partition count and a flag.
    """
    wanted = (
        rename_topics(source_topics, mapping)
        .groupBy("target_topic")
        .agg(
            F.max("partitions").alias("partitions"),
            F.max("replication_factor").alias("replication_factor"),
            F.max_by("config", F.struct("partitions", "topic")).alias("config"),
            (F.count(F.lit(1)) > 1).alias("collision"),
        )
    )
    have = existing.select(F.col("topic").alias("target_topic"))
    return wanted.join(have, "target_topic", "left_anti")


def skip_existing(rows, target, width=BUCKET_ROWS):
    """Archived rows that the target does not hold yet, as multisets.

    Of equal messages, as many as the target already holds are left out, lowest
    offsets first. Only fingerprints and places are shuffled to find them, and only those of
    messages the target holds; a group of copies is ranked bucket by bucket, so one
    much-copied message is spread out. The rows themselves meet the places to skip in an
    anti-join, which is a broadcast where these are measured to be few.
    """
    keys = ["target_topic", "partition", "_print"]
    place = ["target_topic", "topic", "partition", "offset"]
    held = (
        target.withColumn("_print", fingerprint())
        .groupBy(F.col("topic").alias("target_topic"), "partition", "_print")
        .agg(F.count(F.lit(1)).alias("_held"))
    )
    tagged = (
        rows.select(*place, fingerprint().alias("_print"), bucket_of("offset", width).alias("_range"))
        .join(held.select(*keys), keys, "left_semi")
    )
    group = [*keys, "topic", "_range"]
    before = (
        Window.partitionBy(*keys)
        .orderBy("topic", "_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per (content, bucket): how many copies are still to be skipped here.
    left = (
        tagged.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(held, keys)
        .select(*group, (F.col("_held") - F.col("_before")).alias("_skip"))
    )
    ranked = tagged.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*group).orderBy("offset"))
    )
    skipped = stored(ranked.join(left, group).where(F.col("_rank") <= F.col("_skip")).select(*place),
                     "skipped")
    return join_small(rows, skipped, place, spread="offset", how="left_anti").select(*rows.columns)


def missing_backups(requests, backups):
    """Restore requests that name a backup which does not exist.

    Each named id is looked up once, however many requests name it.
    """
    named = requests.where(F.col("backup_id").isNotNull())
    unknown = named.select("backup_id").distinct().join(
        backups.select("backup_id"), "backup_id", "left_anti"
    )
    return join_small(named, unknown, ["backup_id"], spread="request_id")


def _period(column, width):
    return bucket_of(F.unix_seconds(column), width)


def backup_as_of(requests, backups, keys=("storage_id",), width=86_400 * 7, **more):
    """Newest backup at or before each request's time, per storage.

    Requests hold ``request_id``, ``ts`` and the keys. Requests without a fitting
    backup keep a null id.
    """
    newest = (
        backups.groupBy(*keys, F.col("timestamp").alias("ts"))
        .agg(F.max("backup_id").alias("backup_id"))
        .withColumn("backup_ts", F.col("ts"))
    )
    return last_marker(
        requests, newest, list(keys), "ts", ["backup_id", "backup_ts"], _period, width,
        spread="request_id", **more,
    )


def latest_backup(backups, moment=None, keys=()):
    """Newest backup, at or before ``moment`` if given."""
    if moment is not None:
        backups = backups.where(F.col("timestamp") <= F.lit(moment))
    return backups.groupBy(*keys).agg(
        F.max(F.struct("timestamp", "backup_id")).alias("_newest")
    ).select(*keys, "_newest.backup_id", "_newest.timestamp")
