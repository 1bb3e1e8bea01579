"""Order-dependent operators that never put one whole key into one task.

A plain window over ``partition by key`` sends every row of a hot key to one
task. Here each key is cut into buckets along its order; rows are ranked inside
``(key, bucket)`` and a small table with one row per bucket carries the state
from bucket to bucket. The rows move once, on ``(key, bucket)``: the window and
the join with the small table use the same clustering.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from logkeep.operators.joins import join_small, local_if_small
from logkeep.session import scratch_path, sized_shuffles, spread_by_size, stored

# About 256 MB of messages of 1 KB: one sort group, and one file of the archive.
BUCKET_ROWS = 1 << 18


def bucket_of(order, width=BUCKET_ROWS):
    """Bucket number along an integer order such as an offset."""
    column = F.col(order) if isinstance(order, str) else order
    return F.call_function("div", column, F.lit(int(width)))


def _before(keys, buckets):
    return (
        Window.partitionBy(*keys)
        .orderBy(*buckets)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def number_within(df, keys, order, out, width=BUCKET_ROWS, buckets=None):
    """0-based position of each row inside its key, in the given order.

    ``order`` lists columns of which the last is an integer that is unique (or
    nearly so) inside a key. ``buckets`` may name columns, already in ``df``, that
    are coarser than the order and agree with it; by default the last order
    column is cut by ``width``.
    """
    if buckets is None:
        df = df.withColumn("_bucket", bucket_of(order[-1], width))
        buckets = [*order[:-1], "_bucket"]
    group = list(dict.fromkeys([*keys, *buckets]))
    bases = (
        df.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(_before(keys, buckets)), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group).orderBy(*order)
    df = spread_by_size(df, *group)  # the window and the join keep it
    return (
        df.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(bases, group)
        .withColumn(out, (F.col("_base") + F.col("_rank")).cast("bigint"))
        .drop("_rank", "_base", "_bucket")
    )


def total_before(df, keys, order, value, out, width=BUCKET_ROWS):
    """Sum of an integer ``value`` over the rows before each row, inside its key.

    ``order`` is an integer column, unique inside a key.
    """
    df = df.withColumn("_bucket", bucket_of(order, width))
    group = [*keys, "_bucket"]
    bases = df.groupBy(*group).agg(F.sum(value).alias("_sum")).withColumn(
        "_base", F.coalesce(F.sum("_sum").over(_before(keys, ["_bucket"])), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(value).over(_before(group, [order])), F.lit(0))
    return df.withColumn("_inside", inside).join(bases, group).withColumn(
        out, (F.col("_base") + F.col("_inside")).cast("bigint")).drop("_inside", "_base", "_bucket")


def previous_within(df, keys, order, columns, prefix="prev_", width=BUCKET_ROWS):
    """Values of the row before, inside each key, as ``prev_<column>``."""
    df = df.withColumn("_bucket", bucket_of(order, width))
    group = [*keys, "_bucket"]
    if columns == [order]:
        state = F.col(order)  # a plain number aggregates by hash, a struct by sort
    else:
        state = F.struct(F.col(order).alias("_at"), *columns)
    tails = (
        df.groupBy(*group)
        .agg(F.max(state).alias("_tail"))
        .withColumn(
            "_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket"))
        )
        .select(*group, "_carry")
    )
    inside = Window.partitionBy(*group).orderBy(order)
    joined = df.withColumn("_prev", F.lag(state).over(inside)).join(
        tails, group
    )
    before = F.coalesce("_prev", "_carry")
    return joined.select(
        *[c for c in df.columns if c != "_bucket"],
        *[(before if columns == [order] else before[c]).alias(prefix + c) for c in columns],
    )


def last_marker(df, markers, keys, order, columns, buckets_of, width, spread=None,
                group_rows=BUCKET_ROWS):
    """As-of join: newest marker at or before each row, inside its key.

    ``markers`` holds ``keys``, ``order`` and ``columns``, and is unique on
    ``(keys, order)``. Rows and markers meet per (key, bucket); the last marker of
    earlier buckets is carried in through one small row per bucket.

    Where many rows can share one place in the order, name a column to ``spread``
    them by: buckets of more than ``group_rows`` rows are counted first and cut
    into pieces, and only their markers are copied to each piece.
    """
    value = F.struct(F.col(order).alias("_at"), *columns)
    rows = df.withColumn("_bucket", buckets_of(F.col(order), width))
    marks = markers.select(*keys, order, value.alias("_mark")).withColumn(
        "_bucket", buckets_of(F.col(order), width)
    )
    tails = marks.groupBy(*keys, "_bucket").agg(F.max("_mark").alias("_tail"))
    needed = rows.select(*keys, "_bucket").distinct()
    carries = (
        tails.unionByName(needed, allowMissingColumns=True)
        .groupBy(*keys, "_bucket")
        .agg(F.max("_tail").alias("_tail"))
        .withColumn("_mark", F.max("_tail").over(_before(keys, ["_bucket"])))
        .where(F.col("_mark").isNotNull())
        .select(*keys, "_bucket", "_mark", F.lit(None).cast(df.schema[order].dataType).alias(order))
    )
    marks = marks.unionByName(carries)
    if spread is None:
        rows, marks = rows.withColumn("_salt", F.lit(0)), marks.withColumn("_salt", F.lit(0))
    else:
        rows, marks = _cut_large_buckets(rows, marks, [*keys, "_bucket"], spread, group_rows)
    both = rows.withColumn("_is_row", F.lit(True)).unionByName(
        marks.withColumn("_is_row", F.lit(False)), allowMissingColumns=True
    )
    so_far = (
        Window.partitionBy(*keys, "_bucket", "_salt")
        .orderBy(F.col(order).asc_nulls_first(), "_is_row")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("_mark", F.last("_mark", ignorenulls=True).over(so_far))
        .where("_is_row")
        .select(*df.columns, *[F.col("_mark")[c].alias(c) for c in columns])
    )


def _cut_large_buckets(rows, marks, group, spread, group_rows):
    pieces = F.ceil(F.col("_n") / F.lit(group_rows)).cast("int").alias("_pieces")
    large = (
        rows.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > group_rows)
        .select(*group, pieces)
    )
    large = local_if_small(large) or stored(large)
    count = F.coalesce("_pieces", F.lit(1))
    rows = join_small(rows, large, group, spread, how="left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), count).cast("int")
    )
    marks = marks.join(large, group, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), count - 1))
    )
    return rows.drop("_pieces"), marks.drop("_pieces")


def number_rows(df, keys, order, out, path=None):
    """Gap-free numbers per key for rows that have no offset yet.

    The rows are range-partitioned once on (keys, order) and written, so that a
    hot key spans many slices of even size. A position inside its slice plus the
    slice's base, taken from a small table, is the number: no window over rows.
    ``order`` must be unique inside a key. What follows from other columns is better added
    afterwards: all columns of ``df`` are shuffled and written.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "numbered")
    with sized_shuffles(df) as partitions:
        (
            df.repartitionByRange(partitions, *keys, *order)
            .sortWithinPartitions(*keys, *order)
            .withColumn("_position", F.monotonically_increasing_id())
            .write.option("compression", "zstd").parquet(path)
        )
    placed = spark.read.parquet(path).withColumn("_slice", F.shiftright("_position", 33))
    group = [*keys, "_slice"]
    bases = (
        placed.groupBy(*group)
        .agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(_before(keys, ["_slice"])), F.lit(0)))
        .drop("_n")
    )
    return (
        join_small(placed, bases, group, spread="_position")
        .withColumn(out, F.col("_position") - F.col("_first") + F.col("_base"))
        .drop("_position", "_slice", "_first", "_base")
    )
