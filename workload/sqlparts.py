"""DuckDB common table expressions for the derived logs and catalogs."""

EVENTS = """events_log AS (
  SELECT 'events.' || event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition",
         row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS "offset",
         CAST(user_id AS VARCHAR) AS "key",
         CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN '' ELSE props END AS "value",
         ts AS "timestamp",
         CASE WHEN event_id % 2 = 0 THEN 'type=' || event_type ELSE '' END AS headers,
         "value" AS amount
  FROM events)"""

GAPPED = EVENTS + """, gapped_log AS (SELECT * FROM events_log WHERE amount >= 5)"""

ORDERS = """orders_log AS (
  SELECT 'orders.' || lower(o_orderstatus) AS topic, CAST(o_custkey % 8 AS INTEGER) AS "partition",
         row_number() OVER (PARTITION BY o_orderstatus, o_custkey % 8 ORDER BY o_orderdate, o_orderkey) - 1 AS "offset",
         CAST(o_orderkey AS VARCHAR) AS "key", o_orderpriority AS "value", o_orderdate AS "timestamp",
         '' AS headers
  FROM orders)"""

LINEITEM = """lineitem_log AS (
  SELECT 'lineitem.' || lower(l_returnflag) AS topic, CAST(l_orderkey % 12 AS INTEGER) AS "partition",
         row_number() OVER (PARTITION BY l_returnflag, l_orderkey % 12
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS "offset",
         CAST(l_orderkey AS VARCHAR) AS "key", CAST(l_partkey AS VARCHAR) AS "value",
         l_shipdate AS "timestamp", '' AS headers
  FROM lineitem)"""

ALL = f"""{EVENTS}, {ORDERS}, {LINEITEM}, all_logs AS (
  SELECT topic, "partition", "offset", "key", "value", "timestamp", headers FROM events_log
  UNION ALL SELECT topic, "partition", "offset", "key", "value", "timestamp", headers FROM orders_log
  UNION ALL SELECT topic, "partition", "offset", "key", "value", "timestamp", headers FROM lineitem_log)"""

CUSTOMER_TOPICS = """customer_topics AS (
  SELECT 'cust.' || c_custkey AS topic, CAST(c_nationkey + 1 AS INTEGER) AS partitions,
         CAST(c_custkey % 3 + 1 AS SMALLINT) AS replication_factor, c_mktsegment AS config
  FROM customer)"""

BACKUPS = """backups AS (
  SELECT 'bk-' || o_orderkey AS backup_id, o_orderdate AS "timestamp",
         'store-' || (o_custkey % 3) AS storage_id,
         'orders.' || lower(o_orderstatus) AS topic_a,
         'priority.' || substr(o_orderpriority, 1, 1) AS topic_b
  FROM orders)"""

JOB_EVENTS = """job_events AS (
  SELECT 'job-' || o_custkey AS job_id,
         CASE WHEN o_custkey % 2 = 0 THEN 'backup' ELSE 'restore' END AS kind,
         o_orderkey AS seq, o_orderdate AS ts,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Running' WHEN '2' THEN 'Completed'
           WHEN '3' THEN 'Failed' WHEN '4' THEN 'Suspended' ELSE 'Pending' END AS phase,
         'cluster-' || (o_custkey % 7) AS source_id, 'store-' || (o_custkey % 3) AS storage_id,
         'cluster-' || ((o_custkey + 1) % 7) AS target_id, 'bk-' || o_orderkey AS backup_id,
         o_totalprice < 50000 AS deleted,
         CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'write failed' END AS error
  FROM orders)"""

LATEST = JOB_EVENTS + """, latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn,
           min(ts) OVER (PARTITION BY job_id) AS created_at FROM job_events) WHERE rn = 1)"""

TASK_FACTS = """task_facts AS (
  SELECT 'job-' || l_suppkey AS job_id, 'lineitem.' || lower(l_returnflag) AS topic,
         CAST(l_orderkey % 12 AS INTEGER) AS "partition", CAST(l_partkey % 5 AS INTEGER) AS worker_id,
         CAST(trunc(l_quantity) AS BIGINT) AS messages, l_partkey * 10 AS bytes,
         CAST(round(l_discount * 100000) AS BIGINT) AS duration_ms,
         CASE WHEN l_linestatus = 'O' THEN 'put' ELSE 'get' END AS operation,
         CASE WHEN l_tax > 0.075 THEN 'failed' ELSE 'ok' END AS status, l_shipdate AS ts
  FROM lineitem)"""


def key_sql(backup_id, segment, prefix=""):
    """Storage key of a compressed segment object."""
    return (
        f"'{prefix}backups/' || {backup_id} || '/topics/' || topic || '/partition-' || "
        f"\"partition\" || '/segment-' || printf('%06d', {segment}) || '.json.gz'"
    )


def size_sql():
    """Bytes of key, value and headers ('type=<x>' stands for one header)."""
    return (
        "CAST(strlen(\"key\") + coalesce(strlen(\"value\"), 0) + "
        "CASE WHEN headers = '' THEN 0 ELSE strlen(headers) - 1 END AS BIGINT)"
    )


def count_segment_sql(batch):
    return (
        "CAST((row_number() OVER (PARTITION BY topic, \"partition\" ORDER BY \"offset\") - 1)"
        f" // {batch} AS BIGINT)"
    )


def manifest_sql(log, batch, backup_id, prefix=""):
    """Segment manifest of a log cut by count, as a CTE named ``manifest``."""
    return f"""segmented AS (SELECT *, {count_segment_sql(batch)} AS segment FROM {log}),
manifest AS (
  SELECT '{backup_id}' AS backup_id, topic, "partition", segment,
         min("offset") AS start_offset, max("offset") AS end_offset,
         count(*) AS message_count, CAST(sum({size_sql()}) AS BIGINT) AS size_bytes,
         {key_sql(f"'{backup_id}'", "segment", prefix)} AS storage_key
  FROM segmented GROUP BY topic, "partition", segment)"""
