"""Cutting topic-partitions into numbered segments."""

from pyspark.sql import functions as F

from logkeep.operators import flush
from logkeep.operators.joins import join_small
from logkeep.operators.ordering import BUCKET_ROWS, number_within, previous_within

KEYS = ["topic", "partition"]


def by_count(log, batch_size, width=BUCKET_ROWS):
    """Every ``batch_size`` messages in offset order, numbered from 0."""
    numbered = number_within(log, KEYS, ["offset"], "_row", width)
    return numbered.withColumn(
        "segment", F.expr(f"_row div {int(batch_size)}").cast("bigint")
    ).drop("_row")


def by_offset(log, batch_size, lows=None):
    """``(offset - low) div N``: no shuffle of the rows.

    ``lows`` gives the first offset per topic-partition; it is taken from the log
    when left out.
    """
    if lows is None:
        lows = log.groupBy(*KEYS).agg(F.min("offset").alias("low"))
    joined = join_small(log, lows.select(*KEYS, "low"), KEYS, spread="offset")
    return joined.withColumn(
        "segment", F.expr(f"(offset - low) div {int(batch_size)}").cast("bigint")
    ).drop("low")


def by_absolute_offset(log, batch_size):
    """``offset div N``: a pure function of the row, so replays agree."""
    return log.withColumn("segment", F.expr(f"offset div {int(batch_size)}").cast("bigint"))


def by_size_or_interval(log, batch_size, interval_seconds, slice_rows=None, width=BUCKET_ROWS):
    """Closed at ``batch_size`` messages or after ``interval_seconds``."""
    starts = flush.segment_starts(
        log, batch_size, int(interval_seconds * 1_000_000), slice_rows, width
    )
    return flush.assign(log, starts, width)


def offset_gaps(log, width=BUCKET_ROWS):
    """Ranges of offsets missing inside a topic-partition."""
    narrow = log.select(*KEYS, "offset")
    return (
        previous_within(narrow, KEYS, "offset", ["offset"], width=width)
        .where(F.col("offset") > F.col("prev_offset") + 1)
        .select(
            *KEYS,
            (F.col("prev_offset") + 1).alias("gap_start"),
            (F.col("offset") - 1).alias("gap_end"),
            (F.col("offset") - F.col("prev_offset") - 1).alias("missing"),
        )
    )
