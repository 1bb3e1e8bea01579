"""Session defaults and the shared scratch folder."""

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus=8, app="logkeep", memory="16g"):
    """Session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark):
    """Folder every executor sees, as named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; a temporary folder of one
    machine would be lost with that machine on a cluster.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None:
        named = os.environ.get("LOGKEEP_LOCAL_DIR") if _is_local(context) else None
    if named is None:
        if not _is_local(context):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="run-")
        os.environ["LOGKEEP_LOCAL_DIR"] = named
    return named.rstrip("/")


def scratch_path(spark, name):
    """A new, never used path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def input_bytes(df):
    """Bytes of the files below ``df``; None if a source has no known size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= 1 << 60 for s in sizes) else sum(sizes)


#: Bytes of files for one shuffle partition. Packed files grow some 20 times as rows of a sort, so
#: this is about 300 MB there: what a task of a small executor sorts without spilling.
TARGET_BYTES = 16 << 20


def sized_partitions(df, target_bytes=TARGET_BYTES):
    """Partitions for a shuffle of all rows of ``df``: the session's setting, or more by size.

    A source of unknown size keeps the session's setting: land it first if it is large.
    """
    setting = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(setting, -(-(input_bytes(df) or 0) // target_bytes))


def spread_by_size(df, *columns):
    """``df`` by the hash of columns, in pieces that adaptive execution does not merge, if it is large.

    Adaptive execution merges down to as many pieces as there are cores, however large they are.
    A small ``df`` is given back as it is.
    """
    needed = -(-(input_bytes(df) or 0) // TARGET_BYTES)
    if needed <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(sized_partitions(df), *columns)


@contextlib.contextmanager
def sized_shuffles(df, target_bytes=TARGET_BYTES):
    """Shuffles of all rows of ``df`` have enough partitions inside; gives their number.

    The size is that of the files, which are compressed, hence the small target. The session's
    setting is never lowered, and put back afterwards, so what is planned inside must also run
    inside.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    wanted = sized_partitions(df, target_bytes)
    conf.set("spark.sql.shuffle.partitions", str(wanted))
    try:
        yield wanted
    finally:
        conf.set("spark.sql.shuffle.partitions", before)


def stored(df, name="stored"):
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    The table survives lost executors, and its size is known to later joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df, column, pieces, name="stored"):
    """As ``stored``, bucketed by a column: groups and joins on it shuffle none of these rows."""
    spark, table = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    (df.write.format("parquet").bucketBy(pieces, column)
     .option("path", scratch_path(spark, name)).saveAsTable(table))
    found = spark.table(table)
    found.schema  # resolved: only the files are needed from here on
    spark.sql(f"DROP TABLE {table}")
    return found


@contextlib.contextmanager
def landed(df):
    """A copy of ``df`` in the shared folder, deleted at the end."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "landed")
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _is_local(context):
    return context.master.startswith("local")
