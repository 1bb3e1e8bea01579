"""Topic discovery, watermarks, selection and worker assignment."""

from pyspark.sql import functions as F

from logkeep.functions.hashing import seeded_bucket
from logkeep.functions.patterns import matches_any
from logkeep.operators import selectors as long_lists
from logkeep.operators.joins import join_small, local_if_small


def watermarks(log):
    """Low and next offset and row count per topic-partition."""
    return log.groupBy("topic", "partition").agg(
        F.min("offset").alias("low"),
        (F.max("offset") + 1).alias("high"),
        F.count(F.lit(1)).alias("messages"),
    )


def discover(log):
    """Topics that have at least one partition, with their partition count."""
    return (
        log.groupBy("topic", "partition")
        .agg(F.lit(1).alias("_seen"))
        .groupBy("topic")
        .agg(F.count(F.lit(1)).cast("int").alias("partitions"))
    )


def describe(log, topics):
    """Discovered topics with replication, config and partition ids."""
    seen = (
        log.groupBy("topic", "partition")
        .agg(F.lit(1).alias("_seen"))
        .groupBy("topic")
        .agg(
            F.count(F.lit(1)).cast("int").alias("partitions"),
            F.sort_array(F.collect_list("partition")).alias("partition_ids"),
        )
    )
    facts = topics.select(F.col("name").alias("topic"), "replication_factor", "config")
    return seen.join(facts, "topic", "left")


def select_for_backup(df, selectors):
    """A backup without selectors selects nothing."""
    if len(selectors) > long_lists.MANY:
        return long_lists.select(df, selectors)
    return df.where(matches_any(F.col("topic"), selectors, when_empty=False))


def select_for_restore(df, selectors):
    """A restore without selectors takes everything."""
    if len(selectors) > long_lists.MANY:
        return long_lists.select(df, selectors)
    return df.where(matches_any(F.col("topic"), selectors, when_empty=True))


def selector_coverage(topics, selectors):
    """One row per selector with the number of topics it matches.

    Each selector is one conditional count in a single pass, so topics and
    selectors are never paired up. Long lists go through keys instead.
    """
    if len(selectors) > long_lists.MANY:
        return long_lists.coverage(topics, selectors)
    counts = topics.agg(
        *[
            F.count_if(s.matches(F.col("topic"))).alias(f"n{i}")
            for i, s in enumerate(selectors)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(s.type).alias("type"),
                F.lit(s.pattern).alias("pattern"),
                F.col(f"n{i}").alias("topics_matched"),
            )
            for i, s in enumerate(selectors)
        ]
    )
    return counts.select(F.inline(rows))


def assign_workers(topics, workers, seed):
    """Worker of each topic by seeded hash."""
    return topics.withColumn("worker_id", seeded_bucket(F.col("topic"), seed, workers))


def topics_by_worker(topics, workers, seed):
    """Topic count and name range of each worker that has any.

    The names themselves are the rows of ``assign_workers``.
    """
    return (
        assign_workers(topics.select("topic"), workers, seed)
        .groupBy("worker_id")
        .agg(
            F.count(F.lit(1)).alias("topics"),
            F.min("topic").alias("first_topic"),
            F.max("topic").alias("last_topic"),
        )
    )


def rows_of_worker(log, worker, workers, seed):
    """Rows of the topics that belong to one worker.

    The few names are hashed once and by themselves; a filter on the hash of the
    log's own column would be evaluated for every row.
    """
    names = log.select("topic").distinct()
    names = local_if_small(names) or names
    mine = assign_workers(names, workers, seed).where(F.col("worker_id") == worker)
    return join_small(log, mine, ["topic"], spread="offset")
