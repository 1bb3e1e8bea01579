"""Segments closed by size or by elapsed time.

A segment closes at ``size`` messages, or with the first message whose time is at
least ``wait`` after the last message of the segment before (the first segment
counts from the partition's first message). Where a segment ends depends on all
segments before it, yet a segment that starts at a known row ends at a known row.
So each slice of a partition is reduced, in parallel, to a map from "rows already
open at my border" to "rows open at my end, and segments closed"; the maps of a
partition are chained over one small row per slice; then each slice emits its own
segment starts. No task holds more than a slice and ``size`` rows before it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logkeep.operators.ordering import BUCKET_ROWS, bucket_of, last_marker, number_within
from logkeep.session import stored

SLICE_ROWS = 1 << 18
KEYS = ["topic", "partition"]


#: Stands for the time of a message that must not close a segment; marks the end of a chain.
_NEVER, _END = -(1 << 62), -2


def segment_starts(log, size, wait_us, slice_rows=None, width=BUCKET_ROWS):
    """(topic, partition, segment, offset) of each segment's first message."""
    return walk(log, size, wait_us, None, slice_rows, width)[0]


def walk(log, size, wait_us, state=None, slice_rows=None, width=BUCKET_ROWS):
    """Segment starts in ``log`` after ``state``, and the state after it.

    A state has, for each topic-partition, the number of the ``segment`` that is open or comes
    next, the messages it has so far (``open``), the time of the last message before it
    (``flushed_us``) and the ``last_offset``. Of earlier messages nothing else is needed: those
    open stand in the first slice as places that never close a segment.
    """
    slice_rows = max(slice_rows or SLICE_ROWS, 2 * size)
    narrow = log.select(*KEYS, "offset", F.unix_micros("timestamp").alias("at"))
    numbered = stored(number_within(narrow, KEYS, ["offset"], "row", width))

    row, home = F.col("row"), bucket_of("row", slice_rows)
    tail = (row % slice_rows) >= slice_rows - size
    sliced = numbered.withColumn(
        "slice", F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    group = [*KEYS, "slice"]

    def reduce_slice(table):
        return _reduce_slice(table, size, wait_us, slice_rows)

    def emit_starts(table, entry):
        return _emit_starts(table, entry, size, wait_us, slice_rows)

    if state is not None:
        state = state.join(numbered.select(*KEYS).distinct(), KEYS, "left_semi")
        sliced = sliced.unionByName(_open_places(state))
    maps = sliced.groupBy(*group).applyInArrow(
        reduce_slice,
        "topic string, partition int, slice bigint, open array<bigint>, "
        "left array<bigint>, slope array<bigint>, closed array<bigint>",
    )
    if state is not None:
        maps = maps.unionByName(state.select(
            *KEYS, F.lit(-1).cast("bigint").alias("slice"), *[
                F.array(F.col(c) if c else F.lit(0).cast("bigint")).alias(name)
                for name, c in (("open", None), ("left", "open"), ("slope", None), ("closed", "segment"))]))
    entries = stored(
        maps.repartition(*KEYS)
        .sortWithinPartitions(*group)
        .mapInArrow(
            _chain, "topic string, partition int, slice bigint, open bigint, segment bigint"
        )
    )
    starts = (
        sliced.groupBy(*group)
        .cogroup(entries.groupBy(*group))
        .applyInArrow(
            emit_starts, "topic string, partition int, segment bigint, offset bigint"
        )
    )
    return starts, _state_after(numbered, entries, state)


def _open_places(state):
    """Rows before the first one: the last message of the segment before, and the open ones."""
    place = F.explode(F.sequence(-F.col("open") - 1, F.lit(-1).cast("bigint")))
    first = F.col("row") == -F.col("open") - 1
    return state.withColumn("row", place).select(
        *KEYS, F.col("row").alias("offset"),
        F.when(first, F.col("flushed_us")).otherwise(F.lit(_NEVER)).alias("at"), "row",
        F.lit(0).cast("bigint").alias("slice"))


def _state_after(numbered, entries, state):
    """State at the end of the chain; the last flush is the message before the open ones."""
    ends = entries.where(F.col("slice") == _END).select(*KEYS, "segment", "open")
    seen = numbered.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_n"), F.max("offset").alias("last_offset"), F.min_by("at", "row").alias("_first"))
    ends = ends.join(seen, KEYS).withColumn("row", F.col("_n") - F.col("open") - 1)
    ends = ends.join(numbered.select(*KEYS, "row", "at"), [*KEYS, "row"], "left")
    before = F.col("_first")
    if state is not None:
        ends = ends.join(state.select(*KEYS, "flushed_us"), KEYS, "left")
        before = F.coalesce("flushed_us", "_first")
    return ends.select(*KEYS, "segment", "open", F.coalesce("at", before).alias("flushed_us"), "last_offset")


def _slice_arrays(table, slice_rows):
    """Sorted times and offsets, the slice, and how many rows precede it."""
    order = np.argsort(table["row"].to_numpy(), kind="stable")
    rows = table["row"].to_numpy()[order]
    at = table["at"].to_numpy()[order]
    offsets = table["offset"].to_numpy()[order]
    slice_id = table["slice"][0].as_py()
    before = int(np.searchsorted(rows, slice_id * slice_rows))
    return at, offsets, slice_id, before


def _first_reaching(at, start, target):
    """First index >= start with at[index] >= target, for each pair; len(at) if none."""
    n = len(at)
    peak = np.maximum.accumulate(at)
    found = np.searchsorted(peak, target, side="left")
    # Where an earlier, later-stamped message hides the answer, search by doubling.
    hidden = np.flatnonzero((start > 0) & (target <= peak[np.maximum(start - 1, 0)]))
    if len(hidden):
        levels = [at]
        while 1 << len(levels) <= n:
            half, last = 1 << (len(levels) - 1), levels[-1]
            wider = last.copy()
            wider[: n - half] = np.maximum(last[: n - half], last[half:])
            levels.append(wider)
        place, goal = start[hidden].copy(), target[hidden]
        for k in range(len(levels) - 1, -1, -1):
            inside = place < n
            skip = inside & (levels[k][np.minimum(place, n - 1)] < goal)
            place[skip] += 1 << k
        found[hidden] = np.minimum(place, n)
    return found


def _next_starts(at, size, wait_us):
    """For a segment starting at i: start of the next one, or i if it stays open."""
    n = len(at)
    start = np.arange(n)
    last_flush = np.concatenate((at[:1], at[:-1]))
    by_time = _first_reaching(at, start, last_flush + wait_us)
    closing = np.minimum(by_time, start + size - 1)
    return np.where(closing < n, closing + 1, start)


def _reduce_slice(table, size, wait_us, slice_rows):
    at, _, slice_id, before = _slice_arrays(table, slice_rows)
    n = len(at)
    out = {"topic": [], "partition": [], "slice": [], "open": [], "left": [],
           "slope": [], "closed": []}
    if before < n:
        jump = np.append(_next_starts(at, size, wait_us), n)
        follow, closed = jump, (jump != np.arange(n + 1)).astype(np.int64)
        while True:
            further = follow[follow]
            if np.array_equal(further, follow):
                break
            closed = closed + closed[follow]
            follow = further
        open_rows = np.arange(min(size - 1, max(before - 1, 0)) + 1)
        starts = before - open_rows
        # A start whose segment closed before the border is never asked for.
        asked = (open_rows == 0) | (jump[starts] > before) | (jump[starts] == starts)
        open_rows, starts = open_rows[asked], starts[asked]
        runs = _encode(open_rows, n - follow[starts], closed[starts])
        out["topic"].append(table["topic"][0].as_py())
        out["partition"].append(table["partition"][0].as_py())
        out["slice"].append(slice_id)
        for name, values in zip(("open", "left", "slope", "closed"), runs):
            out[name].append(values.tolist())
    return pa.table(out, schema=_MAP_TYPE)


_LONGS = pa.list_(pa.int64())
_MAP_TYPE = pa.schema(
    [("topic", pa.string()), ("partition", pa.int32()), ("slice", pa.int64()),
     ("open", _LONGS), ("left", _LONGS), ("slope", _LONGS), ("closed", _LONGS)]
)


def _encode(x, left, closed):
    """Runs on which ``left`` grows by a fixed step and ``closed`` is constant."""
    step = np.diff(left)
    bent = np.ones(len(x), dtype=bool)
    if len(x) > 1:
        bent[1:] = (np.diff(x) != 1) | (np.diff(closed) != 0) | ((step != 0) & (step != 1))
        bent[2:] |= (step[1:] != step[:-1]) & ~bent[1:-1]
    heads = np.flatnonzero(bent)
    slope = np.zeros(len(heads), dtype=np.int64)
    if len(x) > 1:
        inner = heads[heads < len(x) - 1]
        follows = ~bent[inner + 1]
        slope[: len(inner)][follows] = step[inner[follows]]
    return x[heads], left[heads], slope, closed[heads]


_ENTRY_TYPE = pa.schema(
    [("topic", pa.string()), ("partition", pa.int32()), ("slice", pa.int64()),
     ("open", pa.int64()), ("segment", pa.int64())]
)


def _chain(batches):
    """Carry (open rows, segments closed) from slice to slice of a partition, and to its end."""
    current, open_rows, segment = None, 0, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["topic"], row["partition"]) != current:
                if current is not None:
                    out.append((*current, _END, open_rows, segment))
                current, open_rows, segment = (row["topic"], row["partition"]), 0, 0
            out.append((*current, row["slice"], open_rows, segment))
            run = int(np.searchsorted(row["open"], open_rows, side="right")) - 1
            shift = open_rows - row["open"][run]
            open_rows = row["left"][run] + row["slope"][run] * shift
            segment += row["closed"][run]
        yield _entries(out)
    if current is not None:
        yield _entries([(*current, _END, open_rows, segment)])


def _entries(rows):
    columns = list(zip(*rows)) or [[]] * len(_ENTRY_TYPE)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, _ENTRY_TYPE)], schema=_ENTRY_TYPE)


def _emit_starts(table, entry, size, wait_us, slice_rows):
    segments, offsets_out = [], []
    if entry.num_rows and table.num_rows:
        at, offsets, _, before = _slice_arrays(table, slice_rows)
        jump = _next_starts(at, size, wait_us).tolist()
        n, place = len(at), before
        open_rows, segment = entry["open"][0].as_py(), entry["segment"][0].as_py()
        if open_rows:
            place = jump[before - open_rows]
            if place == before - open_rows:
                place = n
            segment += 1
        while place < n:
            segments.append(segment)
            offsets_out.append(int(offsets[place]))
            if jump[place] == place:
                break
            place, segment = jump[place], segment + 1
    count = len(segments)
    topic = table["topic"][0].as_py() if count else None
    partition = table["partition"][0].as_py() if count else None
    return pa.table(
        {"topic": [topic] * count, "partition": [partition] * count,
         "segment": segments, "offset": offsets_out},
        schema=pa.schema(
            [("topic", pa.string()), ("partition", pa.int32()),
             ("segment", pa.int64()), ("offset", pa.int64())]
        ),
    )


def assign(log, starts, width=BUCKET_ROWS):
    """Attach the segment of the newest start at or before each offset.

    The starts, one small row per segment, are computed once and kept.
    """
    return last_marker(log, stored(starts), KEYS, "offset", ["segment"], bucket_of, width)
