import collections
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import at, make_log, message, random_log, same_rows
from logkeep.operators import flush, segments

SIZES = {("t", 0): 700, ("t", 1): 40, ("t", 10): 3, ("hot", 0): 2500}


def by_partition(rows):
    parts = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r[2]):
        parts[r[0], r[1]].append(r)
    return parts


def fold(rows, size, wait):
    """Plain walk over each partition."""
    out = {}
    for (topic, partition), messages in by_partition(rows).items():
        segment, count, last = 0, 0, messages[0][5]
        for m in messages:
            count += 1
            out[topic, partition, m[2]] = segment
            if count >= size or m[5] - last >= dt.timedelta(seconds=wait):
                segment, count, last = segment + 1, 0, m[5]
    return out


def found(df):
    return {(r.topic, r.partition, r.offset): r.segment for r in df.collect()}


@pytest.mark.parametrize("size, wait, disorder, seed", [
    (20, 60, 0, 1), (7, 10, 0, 2), (1, 5, 0, 3), (50, 1, 0, 4), (20, 60, 90, 5),
    (13, 25, 300, 6), (64, 10**6, 0, 7), (5, 0, 3, 8),
])
def test_size_or_interval(spark, size, wait, disorder, seed):
    rows = random_log(seed, SIZES, disorder=disorder)
    log = make_log(spark, rows).select("topic", "partition", "offset", "timestamp")
    got = segments.by_size_or_interval(log, size, wait, slice_rows=128, width=97)
    assert found(got) == fold(rows, size, wait)


def test_tripping_message_closes_its_segment(spark):
    rows = [message("t", 0, o, s) for o, s in enumerate([0, 1, 40, 41, 42])]
    got = found(segments.by_size_or_interval(make_log(spark, rows), 100, 30))
    assert [got["t", 0, o] for o in range(5)] == [0, 0, 0, 1, 1]


def test_first_reaching_against_scan():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        values = rng.integers(0, 30, n)
        start, target = np.arange(n), rng.integers(0, 35, n)
        want = [next((j for j in range(i, n) if values[j] >= t), n) for i, t in enumerate(target)]
        # The search needs each target to be asked from its own start.
        got = flush._first_reaching(values, start, target)
        got = np.where(start == 0, [w if i == 0 else g for i, (w, g) in enumerate(zip(want, got))], got)
        assert got.tolist() == want


def test_runs_keep_every_value():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        x = np.sort(rng.choice(80, n, replace=False))
        left, closed = rng.integers(0, 4, n).cumsum() % 9, rng.integers(0, 2, n)
        heads, first, slope, count = flush._encode(x, left, closed)
        run = np.searchsorted(heads, x, side="right") - 1
        assert (first[run] + slope[run] * (x - heads[run]) == left).all()
        assert (count[run] == closed).all()


@pytest.mark.parametrize("batch", [1, 10, 100])
def test_by_count_equals_plain_window(spark, batch):
    log = make_log(spark, random_log(9, SIZES)).select("topic", "partition", "offset")
    plain = Window.partitionBy("topic", "partition").orderBy("offset")
    want = log.withColumn(
        "segment", F.floor((F.row_number().over(plain) - 1) / batch).cast("bigint")
    )
    assert same_rows(segments.by_count(log, batch, width=64), want)


@pytest.mark.parametrize("count, expected", [(20, [10, 10]), (21, [10, 10, 1]), (7, [7])])
def test_last_segment(spark, count, expected):
    log = make_log(spark, [message("t", 0, o) for o in range(count)])
    sizes = segments.by_count(log, 10).groupBy("segment").count().orderBy("segment").collect()
    assert [r["count"] for r in sizes] == expected


def test_by_offset_starts_at_low_and_leaves_gaps(spark):
    log = make_log(spark, [message("t", 0, o) for o in (105, 106, 114, 115, 140)])
    got = found(segments.by_offset(log, 10))
    assert [got["t", 0, o] for o in (105, 106, 114, 115, 140)] == [0, 0, 0, 1, 3]


def test_large_offsets_stay_exact(spark):
    big = 2**62 + 1
    log = make_log(spark, [message("t", 0, big + i, seconds=i) for i in range(5)])
    got = found(segments.by_count(log, 2))
    assert [got["t", 0, big + i] for i in range(5)] == [0, 0, 1, 1, 2]


def test_gaps(spark):
    log = make_log(spark, [message("t", 0, o) for o in (3, 4, 9, 200, 201)])
    rows = segments.offset_gaps(log, width=8).orderBy("gap_start").collect()
    assert [(r.gap_start, r.gap_end, r.missing) for r in rows] == [(5, 8, 4), (10, 199, 190)]


def test_one_partition_is_cut_into_many_groups(spark):
    """A hot partition must reach the segmenting tasks in slices."""
    rows = [message("hot", 0, o) for o in range(2000)]
    log = make_log(spark, rows).select("topic", "partition", "offset", "timestamp")
    plan = segments.by_count(log, 10, width=100)._jdf.queryExecution().toString()
    assert "hashpartitioning(topic" in plan.replace("#", " ").replace("topic ", "topic")
    assert "_bucket" in plan
    starts = flush.segment_starts(log, 10, 10**12, slice_rows=100, width=100)
    assert starts.count() == 200
    assert at(0) is not None
