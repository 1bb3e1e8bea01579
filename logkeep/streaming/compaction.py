"""Compaction of what streams wrote: many small batch files into few files in offset order.

Every micro-batch leaves a file for each topic-partition that it holds, so a long stream is read
through as many files as it had batches. A compaction writes the rows of those batches again, in
files of about a given size, each an offset range of one topic-partition, and leaves copies out
(those of older compacted rows stay until both are written again; reads drop them meanwhile).
It is committed like any run, as the next snapshot record: the same segments, other folders.
Readers see either all of it or nothing.

Compacted rows are taken up again only by at least as many bytes of newer ones, so each message
is written again a logarithmic number of times, however often compactions run. Streams may go on
meanwhile: batches behind the last snapshot are left alone. If a run commits during a compaction,
the compaction is refused, changes nothing, and may be started again.
"""

import datetime as dt

from pyspark.sql import functions as F

from logkeep.operators.joins import join_small
from logkeep.operators.ordering import bucket_of, total_before
from logkeep.schemas import ARCHIVE_SCHEMA
from logkeep.session import sized_shuffles, stored
from logkeep.sinks import archive as sink
from logkeep.sources.archive import COMPACTED, holds_rows, once, overlaps, read_pieces, rows_of_streams

PLACE = ["topic", "partition", "segment"]
#: Bytes of messages that a file aims at.
FILE_BYTES = 256 << 20


def compact(spark, root, backup_id, file_bytes=FILE_BYTES):
    """Rewrite the small batches of a streamed backup; gives file and message counts, or None.

    None where there is no snapshot or no streamed batch that was not compacted before.
    """
    base, record = sink.base_of(spark, root, backup_id)
    if record is None or record["layout"] != "archive":
        return None
    streams = [s for s in record["streams"] if s["last_batch"] is not None and holds_rows(s)]
    pieces = sink.up_to_batches(read_pieces(spark, root, backup_id), streams)
    taken = chosen(streams, pieces)
    if not taken:
        return None
    started, name = dt.datetime.now(dt.timezone.utc), f"{COMPACTED}{sink.new_snapshot()}"
    pieces = stored(sink.up_to_batches(pieces, taken), "pieces")
    rows = rows_of_streams(spark, root, backup_id, taken)
    twice = overlaps(pieces)
    copied = bool(twice.take(1))
    if copied:
        rows = once(rows, twice)
    with sized_shuffles(rows):
        _write(binned(rows, pieces, file_bytes), root, backup_id, name)
    files = stored(sink.file_totals(sink.read_batch(spark, root, backup_id, name, 0)), "files")
    _check(pieces, files, twice if copied else None)
    sink.write_pieces(files, root, backup_id, name, 0, started)
    names = {s["stream"] for s in taken}
    kept = [s for s in record["streams"] if s["stream"] not in names]
    ended = [{**s, "after": s["last_batch"]} for s in taken if not s["stream"].startswith(COMPACTED)]
    entry = {k: record[k] for k in ("timestamp", "version", "compression", "config", "topics")}
    sink.commit(spark, root, backup_id, base, record["snapshot"], entry, record["layout"], record["prefix"],
                [*kept, *ended, {"stream": name, "last_batch": 0, "after": None}], only=names)
    counts = [t.agg(F.count_distinct("file"), F.sum("message_count")).first() for t in (pieces, files)]
    return {"files_before": counts[0][0], "files_after": counts[1][0],
            "messages_before": counts[0][1], "messages_after": counts[1][1]}


def chosen(streams, pieces):
    """Streams to write again: all plain ones, and older compacted ones no larger than what joins them.

    Streams are few (one for each checkpoint or compaction); their sizes are one row each.
    """
    sizes = {r["stream"]: r["size"] for r in pieces.groupBy("stream").agg(
        F.sum("size_bytes").alias("size")).collect()}
    plain = [s for s in streams if not s["stream"].startswith(COMPACTED)]
    taken, total = list(plain), sum(sizes.get(s["stream"], 0) for s in plain)
    older = (s for s in streams if s["stream"].startswith(COMPACTED))
    for s in sorted(older, key=lambda s: sizes.get(s["stream"], 0)) if plain else ():
        if sizes.get(s["stream"], 0) > total:
            break
        taken.append(s)
        total += sizes.get(s["stream"], 0)
    return taken


def binned(rows, pieces, file_bytes=FILE_BYTES):
    """``rows`` with ``_bin`` and ``_part``: neighbouring segments up to a size, large ones in parts."""
    own = pieces.groupBy(*PLACE).agg(
        F.sum("size_bytes").alias("_size"), F.min("start_offset").alias("_low"), F.max("end_offset").alias("_high"))
    placed = total_before(own, PLACE[:2], "segment", "_size", "_total")
    # offsets of a part of a segment that is larger than a file
    width = F.ceil((F.col("_high") - F.col("_low") + 1) * F.lit(int(file_bytes)) / F.greatest("_size", F.lit(1))).cast("bigint")
    bins = placed.select(
        *PLACE, bucket_of("_total", file_bytes).cast("bigint").alias("_bin"),
        F.when(F.col("_size") > file_bytes, width).alias("_width"))
    found = join_small(rows, bins, PLACE, spread="offset")
    part = F.coalesce(F.call_function("div", F.col("offset"), F.col("_width")), F.lit(0).cast("bigint"))
    return found.withColumn("_part", part).drop("_width")


def _write(rows, root, backup_id, name):
    columns = [c for c in ARCHIVE_SCHEMA.fieldNames() if c not in sink.FOLDERS]
    near = ["topic", "partition", "_bin", "_part"]
    (
        rows.repartition(*near).sortWithinPartitions(*near, "offset").select(*columns)
        .write.mode("overwrite").partitionBy("topic", "partition").option("compression", "zstd")
        .parquet(sink.batch_folder(root, backup_id, name, 0))
    )


def _check(pieces, files, twice):
    """Segments must be as they were: counts and checksums where no copy was dropped, else bounds."""
    def added(table, side):
        return table.groupBy(*PLACE).agg(
            F.min("start_offset").alias(f"{side}_low"), F.max("end_offset").alias(f"{side}_high"),
            F.sum("message_count").alias(f"{side}_count"), F.bit_xor("checksum").alias(f"{side}_sum"),
            F.sum("offsets").alias(f"{side}_offsets"))

    both = added(pieces, "was").join(added(files, "now"), PLACE, "full")
    as_before = F.col("was_low").eqNullSafe(F.col("now_low")) & F.col("was_high").eqNullSafe(F.col("now_high"))
    exact = (F.col("was_count") == F.col("now_count")) & F.col("was_sum").eqNullSafe(F.col("now_sum"))
    if twice is not None:
        both = both.join(twice.withColumn("_twice", F.lit(True)), PLACE, "left")
        exact = F.when(F.col("_twice"), F.col("now_count") == F.col("now_offsets")).otherwise(exact)
    changed = both.where(~F.coalesce(as_before & exact, F.lit(False)))
    if not changed.isEmpty():
        raise RuntimeError("compacted segments differ from what the stream recorded")
