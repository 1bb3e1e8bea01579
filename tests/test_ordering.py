from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import same_rows
from logkeep.operators import joins
from logkeep.operators.ordering import (
    bucket_of,
    last_marker,
    number_rows,
    number_within,
    previous_within,
)
from logkeep.session import sized_shuffles


def skewed(spark):
    """One key holds most rows, and one moment a third of them."""
    return spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id") % 997).alias("t"),
        (F.col("id") % 5).cast("string").alias("v"),
    )


def test_number_rows(spark):
    df = skewed(spark)
    plain = Window.partitionBy("k").orderBy("t", "seq")
    want = df.withColumn("n", (F.row_number().over(plain) - 1).cast("bigint"))
    assert same_rows(number_rows(df, ["k"], ["t", "seq"], "n").select(*want.columns), want)


def test_number_rows_without_key(spark):
    got = number_rows(skewed(spark), [], ["seq"], "n")
    assert got.where("n <> seq").isEmpty()


def test_number_within(spark):
    df = skewed(spark)
    plain = Window.partitionBy("k").orderBy("seq")
    want = df.withColumn("n", (F.row_number().over(plain) - 1).cast("bigint"))
    assert same_rows(number_within(df, ["k"], ["seq"], "n", width=50).select(*want.columns), want)


def test_previous_within(spark):
    df = skewed(spark)
    want = df.withColumn("prev_v", F.lag("v").over(Window.partitionBy("k").orderBy("seq")))
    got = previous_within(df, ["k"], "seq", ["v"], width=40)
    assert same_rows(got.select(*want.columns), want)


def test_last_marker_with_hot_moment(spark):
    df = skewed(spark)
    marks = spark.createDataFrame(
        [("hot", 100, "a"), ("hot", 500, "b"), ("hot", 505, "c"), ("k1", 7, "d")],
        "k string, t bigint, m string",
    )
    pairs = df.join(marks.withColumnRenamed("t", "mt"), "k", "left").withColumn(
        "fits", F.when(F.col("mt") <= F.col("t"), F.struct("mt", "m"))
    )
    want = pairs.groupBy("k", "seq", "t", "v").agg(F.max("fits").alias("x")).select(
        "k", "seq", "t", "v", F.col("x.m").alias("m")
    )
    for group_rows in (10**6, 50):
        got = last_marker(df, marks, ["k"], "t", ["m"], bucket_of, 64, spread="seq",
                          group_rows=group_rows)
        assert same_rows(got.select(*want.columns), want)


def test_join_small_beyond_its_bound(spark):
    big = skewed(spark)
    small = big.select("k").distinct().withColumn("w", F.length("k"))
    want = big.join(small, "k")
    assert joins.local_if_small(small, max_rows=2) is None
    for bound in (2, 100):
        got = joins.join_small(big, small, ["k"], spread="seq", max_rows=bound)
        assert same_rows(got.select(*want.columns), want)
    kept = small.where("k = 'hot'")
    left = joins.join_small(big, kept, ["k"], spread="seq", how="left", max_rows=0)
    assert left.count() == big.count() and left.where("w is null").count() > 0


def test_shuffles_grow_with_their_input(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with sized_shuffles(df, target_bytes=1 << 40) as partitions:
        assert partitions == int(before)  # never lowered
    with sized_shuffles(df, target_bytes=1000) as partitions:
        assert partitions > 50 and spark.conf.get("spark.sql.shuffle.partitions") == str(partitions)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_no_unchecked_broadcast_of_the_salted_side(spark):
    big = skewed(spark)
    small = big.select("k").distinct()
    plan = joins.join_small(big, small, ["k"], spread="seq", max_rows=2)
    assert "ResolvedHint" not in plan._jdf.queryExecution().analyzed().toString()


def test_sorts_of_large_tables_fit_their_tasks(spark):
    """800 MB of files are several GB as rows: some 40 tasks, whatever the session has."""
    df = spark.range(100_000_000)
    with sized_shuffles(df) as partitions:
        assert partitions >= 40
    rows = df.select((F.col("id") % 3).alias("k"), F.col("id").alias("offset"))
    plan = number_within(rows, ["k"], ["offset"], "n")._jdf.queryExecution().executedPlan().toString()
    assert f"{partitions}), REPARTITION_BY_NUM" in plan
