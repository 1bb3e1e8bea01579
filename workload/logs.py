"""Topic logs and catalogs derived from the given tables.

A log is numbered once per session and kept in the shared folder, like a topic
that already has its offsets. Every part grows with its table.
"""

from pyspark.sql import functions as F

from logkeep.operators.ordering import number_rows
from logkeep.schemas import LOG_COLUMNS
from logkeep.session import scratch_path

_BUILT = {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column):
    return F.encode(column.cast("string"), "UTF-8")


def _no_headers():
    return F.array().cast("array<struct<key:string,value:binary>>")


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # Tombstones, empty values and headers, so that each kind passes every query.
    value = (
        F.when(F.col("event_id") % 50 == 0, F.lit(None).cast("binary"))
        .when(F.col("event_id") % 50 == 1, F.lit(b""))
        .otherwise(_text(F.col("props")))
    )
    header = F.array(
        F.struct(F.lit("type").alias("key"), _text(F.col("event_type")).alias("value"))
    )
    rows = e.select(
        F.concat(F.lit("events."), "event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "event_id", "event_type", "user_id", "props", "value",
    )
    return rows, ["timestamp", "event_id"], {
        "amount": F.col("value"),
        "key": _text(F.col("user_id")),
        "value": value,
        "headers": F.when(F.col("event_id") % 2 == 0, header).otherwise(_no_headers()),
    }


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.concat(F.lit("orders."), F.lower("o_orderstatus")).alias("topic"),
        (F.col("o_custkey") % 8).cast("int").alias("partition"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        "o_orderkey", "o_orderpriority",
    )
    return rows, ["timestamp", "o_orderkey"], {
        "key": _text(F.col("o_orderkey")),
        "value": _text(F.col("o_orderpriority")),
        "headers": _no_headers(),
    }


def _lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.concat(F.lit("lineitem."), F.lower("l_returnflag")).alias("topic"),
        (F.col("l_orderkey") % 12).cast("int").alias("partition"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    return rows, ["timestamp", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], {
        "key": _text(F.col("l_orderkey")),
        "value": _text(F.col("l_partkey")),
        "headers": _no_headers(),
    }


#: Each gives rows with all that orders them, their order, and what is made of them once they are
#: numbered: keys, values and headers are not shuffled.
_SOURCES = {"events": _events, "orders": _orders, "lineitem": _lineitem}


def log_path(spark, sf_dir, name):
    """Path of a derived log, built on first use in this session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        rows, order, message = _SOURCES[name](spark, sf_dir)
        path = scratch_path(spark, f"log-{name}")
        numbered = number_rows(rows, ["topic", "partition"], order, "offset")
        extra = [c for c in ("amount",) if c in message]
        numbered.withColumns(message).select(*LOG_COLUMNS, *extra).write.parquet(path)
        _BUILT[key] = path
    return _BUILT[key]


def log(spark, sf_dir, name):
    return spark.read.parquet(log_path(spark, sf_dir, name)).select(*LOG_COLUMNS)


def gapped(spark, sf_dir):
    """The events log as compaction leaves it: small amounts dropped afterwards."""
    rows = spark.read.parquet(log_path(spark, sf_dir, "events"))
    return rows.where(F.col("amount") >= 5).select(*LOG_COLUMNS)


def all_logs(spark, sf_dir):
    parts = [log(spark, sf_dir, name) for name in _SOURCES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def customer_topics(spark, sf_dir):
    """One topic per customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("cust."), F.col("c_custkey").cast("string")).alias("topic"),
        (F.col("c_nationkey") + 1).cast("int").alias("partitions"),
        (F.col("c_custkey") % 3 + 1).cast("smallint").alias("replication_factor"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("config"),
    )


def backups(spark, sf_dir):
    """A backup catalog entry per order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("bk-"), F.col("o_orderkey").cast("string")).alias("backup_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("store-"), (F.col("o_custkey") % 3).cast("string")).alias("storage_id"),
        F.array(
            F.concat(F.lit("orders."), F.lower("o_orderstatus")),
            F.concat(F.lit("priority."), F.substring("o_orderpriority", 1, 1)),
        ).alias("topics"),
    )


def job_events(spark, sf_dir):
    """A status event per order; a customer is a job."""
    o = table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    phase = (
        F.when(digit == "1", "Running")
        .when(digit == "2", "Completed")
        .when(digit == "3", "Failed")
        .when(digit == "4", "Suspended")
        .otherwise("Pending")
    )

    def numbered(prefix, column):
        return F.concat(F.lit(prefix), column.cast("string"))

    cust = F.col("o_custkey")
    return o.select(
        numbered("job-", cust).alias("job_id"),
        F.when(cust % 2 == 0, "backup").otherwise("restore").alias("kind"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        phase.alias("phase"),
        numbered("cluster-", cust % 7).alias("source_id"),
        numbered("store-", cust % 3).alias("storage_id"),
        numbered("cluster-", (cust + 1) % 7).alias("target_id"),
        numbered("bk-", F.col("o_orderkey")).alias("backup_id"),
        (F.col("o_totalprice") < 50000).alias("deleted"),
        F.when(digit == "3", F.lit("write failed")).alias("error"),
    )


def task_facts(spark, sf_dir):
    """A finished task per line item; a supplier is a job."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("job-"), F.col("l_suppkey").cast("string")).alias("job_id"),
        F.concat(F.lit("lineitem."), F.lower("l_returnflag")).alias("topic"),
        (F.col("l_orderkey") % 12).cast("int").alias("partition"),
        (F.col("l_partkey") % 5).cast("int").alias("worker_id"),
        F.col("l_quantity").cast("bigint").alias("messages"),
        (F.col("l_partkey") * 10).alias("bytes"),
        F.round(F.col("l_discount") * 100000).cast("bigint").alias("duration_ms"),
        F.when(F.col("l_linestatus") == "O", "put").otherwise("get").alias("operation"),
        F.when(F.col("l_tax") > 0.075, "failed").otherwise("ok").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
