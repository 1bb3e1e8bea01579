"""Segments by count or by size and interval, across micro-batches.

Where a segment of a stream ends depends on the batches before. What they leave behind is one
small row for each topic-partition (``STATE_SCHEMA``); no message is held. Each batch reads the
state that the batch before it wrote and writes its own, whole, so a batch that is replayed
cuts the same segments again. Inside a batch the slices of a hot partition are walked in
parallel, as in a bounded log.

Messages of a partition must come in the order of their offsets, as a broker gives them.
Those at or below the last offset seen are repeats: they go into the segment that already
covers their offset.
"""

from pyspark.sql import functions as F

from logkeep.operators import flush
from logkeep.operators.ordering import BUCKET_ROWS, bucket_of, last_marker, number_within
from logkeep.session import stored
from logkeep.sinks import commits
from logkeep.sinks.archive import checked_id
from logkeep.sources.archive import read_below, read_pieces

KEYS = ["topic", "partition"]
STATE_SCHEMA = ("topic string, partition int, segment bigint, open bigint, flushed_us bigint, "
                "last_offset bigint")


def state_path(root, backup_id):
    return f"{root}/catalog/state/backup_id={checked_id(backup_id)}"


def _batches(spark, folder):
    return sorted(int(n.split("=")[1]) for n, _ in commits.children(spark, folder) if n.startswith("batch="))


def state_before(spark, root, backup_id, stream, batch):
    """State that a batch starts from: its stream's last one, else where other streams ended."""
    home = state_path(root, backup_id)
    own = [b for b in _batches(spark, f"{home}/stream={stream}") if b < batch]
    if own:
        return read_below(spark, STATE_SCHEMA, f"{home}/stream={stream}/batch={own[-1]}")
    return latest_state(spark, root, backup_id, without=stream)


def latest_state(spark, root, backup_id, without=None):
    """State after the last batches of all streams: the furthest one of each partition. None at first."""
    home = state_path(root, backup_id)
    ends = []
    for name, _ in commits.children(spark, home):
        batches = _batches(spark, f"{home}/{name}")
        if batches and name != f"stream={without}":
            ends.append(f"{home}/{name}/batch={batches[-1]}")
    if not ends:
        return None
    rows = spark.read.schema(STATE_SCHEMA).parquet(*ends)
    furthest = F.max(F.struct("last_offset", "segment", "open", "flushed_us")).alias("_s")
    return rows.groupBy(*KEYS).agg(furthest).select(*KEYS, "_s.segment", "_s.open", "_s.flushed_us", "_s.last_offset")


def write_state(state, root, backup_id, stream, batch):
    path = f"{state_path(root, backup_id)}/stream={checked_id(stream)}/batch={int(batch)}"
    state.coalesce(1).write.mode("overwrite").parquet(path)
    spark = state.sparkSession
    # a replay asks for the batch before at most
    for old in _batches(spark, path.rsplit("/", 1)[0]):
        if old < int(batch) - 1:
            commits.delete(spark, f"{path.rsplit('/', 1)[0]}/batch={old}")


def cut(rows, job, state=None, width=BUCKET_ROWS):
    """``rows`` of one micro-batch with their segment, and the state after it.

    Rows and state are read more than once; pass stored ones.
    """
    fresh, repeats = rows, None
    if state is not None:
        joined = rows.join(F.broadcast(state.select(*KEYS, "last_offset")), KEYS, "left")  # one row a partition
        seen = F.coalesce(F.col("offset") <= F.col("last_offset"), F.lit(False))
        fresh, repeats = (joined.where(side).drop("last_offset") for side in (~seen, seen))
    by = _by_count if job.segmentation == "count" else _by_interval
    found, after = by(fresh, job, state, width)
    if state is not None:
        if not repeats.isEmpty():
            found = found.unionByName(_placed(repeats, job, width).select(*found.columns))
        after = after.unionByName(state.join(after.select(*KEYS), KEYS, "left_anti"))
    return found, after


def _by_count(fresh, job, state, width):
    size, zero = F.lit(int(job.batch_size)), F.lit(0).cast("bigint")
    numbered = number_within(fresh, KEYS, ["offset"], "_row", width)
    counted = fresh.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.max("offset").alias("last_offset"))
    base = [zero.alias("_segment"), zero.alias("_open")]
    if state is not None:
        was = F.broadcast(state.select(*KEYS, F.col("segment").alias("_s"), F.col("open").alias("_o")))
        base = [F.coalesce("_s", zero).alias("_segment"), F.coalesce("_o", zero).alias("_open")]
        numbered, counted = (side.join(was, KEYS, "left") for side in (numbered, counted))
    number = (F.col("_segment") + F.call_function("div", F.col("_open") + F.col("_row"), size)).cast("bigint")
    found = numbered.select("*", *base).withColumn("segment", number).select(*fresh.columns, "segment")
    total = F.col("_open") + F.col("_n")
    after = counted.select("*", *base).select(
        *KEYS, (F.col("_segment") + F.call_function("div", total, size)).cast("bigint").alias("segment"),
        (total % size).cast("bigint").alias("open"), zero.alias("flushed_us"), "last_offset")
    return found, after


def _by_interval(fresh, job, state, width):
    starts, after = flush.walk(fresh, job.batch_size, int(job.interval_seconds * 1_000_000), state, width=width)
    if state is not None:
        # the open segment goes on with the first message of the batch
        going_on = fresh.groupBy(*KEYS).agg(F.min("offset").alias("offset")).join(
            state.where("open > 0").select(*KEYS, "segment"), KEYS).select(*KEYS, "segment", "offset")
        starts = starts.unionByName(going_on)
    return flush.assign(fresh, starts, width).select(*fresh.columns, "segment"), after


def _placed(repeats, job, width):
    """Repeated rows in the segments whose offsets cover them."""
    spark = repeats.sparkSession
    starts = read_pieces(spark, job.root, job.backup_id).groupBy(*KEYS, "segment").agg(
        F.min("start_offset").alias("offset"))
    starts = starts.groupBy(*KEYS, "offset").agg(F.max("segment").alias("segment"))
    placed = last_marker(repeats, stored(starts), KEYS, "offset", ["segment"], bucket_of, width)
    return placed.withColumn("segment", F.coalesce("segment", F.lit(0).cast("bigint")))
