"""Queries on restores, catalogs, job status and streams."""

import datetime as dt

from pyspark.sql import functions as F

from logkeep.functions.messages import measured, message_json
from logkeep.functions.patterns import TopicSelector
from logkeep.operators import catalog, replay, segments, status
from logkeep.operators.ordering import number_rows
from logkeep.plans import restore
from logkeep.plans.backup import run_backup
from logkeep.plans.jobs import BackupJob, RestoreJob
from logkeep.session import scratch_path
from logkeep.sinks import catalog as job_log
from logkeep.sinks.catalog import read_events
from logkeep.sinks.segmentfiles import write_objects
from logkeep.sources import segmentfiles
from logkeep.sources.archive import read_archive, read_backups, read_segments
from logkeep.sources.filelog import read_log, stream_log
from logkeep.streaming.backup import run_scheduled
from logkeep.streaming.totals import latest_totals, start_totals
from workload import logs
from workload import sqlparts as sql
from workload.registry import query
from workload.segmenting import PLACE, PLACE_SQL, ROWS_SQL, archived, as_text

NTZ = "timestamp_ntz"


def plain(name):
    return F.col(name).cast(NTZ).alias(name)


@query("partition_filter", f"""WITH {sql.LINEITEM}
SELECT {PLACE_SQL} FROM lineitem_log
WHERE topic NOT IN ('lineitem.a', 'lineitem.n') OR (topic = 'lineitem.a' AND "partition" IN (0, 1, 2))""")
def partition_filter(spark, sf_dir):
    wanted = {"lineitem.a": [0, 1, 2], "lineitem.n": []}
    return replay.filter_partitions(logs.log(spark, sf_dir, "lineitem"), wanted).select(*PLACE)


@query("topic_rename", f"""WITH {sql.EVENTS}
SELECT {PLACE_SQL}, CASE topic WHEN 'events.click' THEN 'events.click-restored' WHEN 'events.view' THEN 'events.merged'
  WHEN 'events.signup' THEN 'events.merged' ELSE topic END AS target_topic FROM events_log""")
def topic_rename(spark, sf_dir):
    mapping = {"events.click": "events.click-restored", "events.view": "events.merged",
               "events.signup": "events.merged"}
    rows = replay.rename_topics(logs.log(spark, sf_dir, "events"), mapping)
    return rows.select(*PLACE, "target_topic")


@query("point_in_time", f"""WITH {sql.EVENTS}
SELECT {PLACE_SQL}, "timestamp" FROM events_log WHERE "timestamp" <= TIMESTAMP '2024-01-15 12:00:00'""")
def point_in_time(spark, sf_dir):
    moment = dt.datetime(2024, 1, 15, 12, tzinfo=dt.timezone.utc)
    rows = replay.up_to(logs.log(spark, sf_dir, "events"), moment)
    return rows.select(*PLACE, plain("timestamp"))


@query("restore_chunks", f"""WITH {sql.CUSTOMER_TOPICS}
SELECT topic, CAST((row_number() OVER (ORDER BY topic) - 1) // CAST(ceil(count(*) OVER () / 7) AS BIGINT) AS INTEGER) AS worker_id
FROM customer_topics""")
def restore_chunks(spark, sf_dir):
    return replay.restore_chunks(logs.customer_topics(spark, sf_dir), 7)


@query("replay_order", f"""WITH {sql.ORDERS},
renamed AS (SELECT *, CASE WHEN topic IN ('orders.f', 'orders.o') THEN 'orders.all' ELSE topic END AS target_topic FROM orders_log)
SELECT target_topic, {PLACE_SQL},
  CAST(row_number() OVER (PARTITION BY target_topic, "partition" ORDER BY topic, "offset") - 1 AS BIGINT) AS "position"
FROM renamed""")
def replay_order(spark, sf_dir):
    mapping = {"orders.f": "orders.all", "orders.o": "orders.all"}
    rows = replay.rename_topics(logs.log(spark, sf_dir, "orders"), mapping)
    placed = replay.with_replay_position(rows.select("target_topic", *PLACE), width=256)
    return placed.select("target_topic", *PLACE, "position")


@query("topics_to_create", f"""WITH {sql.CUSTOMER_TOPICS},
wanted AS (SELECT CASE WHEN topic IN ('cust.1', 'cust.2', 'cust.3') THEN 'cust.merged' ELSE topic END AS target_topic, * FROM customer_topics),
merged AS (SELECT target_topic, max(partitions) AS partitions, max(replication_factor) AS replication_factor,
  arg_max(config, (partitions, topic)) AS config, count(*) > 1 AS collision FROM wanted GROUP BY target_topic)
SELECT * FROM merged WHERE target_topic NOT IN (SELECT 'cust.' || o_custkey FROM orders WHERE o_totalprice > 400000)""")
def topics_to_create(spark, sf_dir):
    mapping = {f"cust.{i}": "cust.merged" for i in (1, 2, 3)}
    existing = logs.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(
        F.concat(F.lit("cust."), F.col("o_custkey").cast("string")).alias("topic")
    )
    found = replay.topics_to_create(logs.customer_topics(spark, sf_dir), existing, mapping)
    return found.withColumn("config", F.col("config")["segment"])


@query("skip_existing", """WITH archive AS (
  SELECT CAST(user_id % 4 AS INTEGER) AS "partition", row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS "offset",
         CASE WHEN "value" < 30 THEN NULL WHEN "value" < 40 THEN '' ELSE CAST(user_id % 10 AS VARCHAR) END AS "key",
         event_type AS "value", date_trunc('day', ts) AS day, "value" AS amount FROM events),
held AS (SELECT "partition", "key", "value", day, count(*) AS n FROM archive WHERE amount >= 25 AND amount < 60 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "partition", "key", "value", day ORDER BY "offset") AS rn FROM archive)
SELECT r."partition", r."offset", r."key", r."value" FROM ranked r LEFT JOIN held h
  ON r."partition" = h."partition" AND r."key" IS NOT DISTINCT FROM h."key" AND r."value" = h."value" AND r.day = h.day
WHERE r.rn > coalesce(h.n, 0)""")
def skip_existing(spark, sf_dir):
    rows = spark.read.parquet(copies_log(spark, sf_dir))
    held = rows.where("amount >= 25 AND amount < 60").withColumn("topic", F.lit("copies.new"))
    archive = rows.withColumn("target_topic", F.lit("copies.new"))
    left = replay.skip_existing(archive, held, width=256)
    return left.select(
        "partition", "offset", F.decode("key", "UTF-8").alias("key"),
        F.decode("value", "UTF-8").alias("value"),
    )


def copies_log(spark, sf_dir):
    """The events as a log in which many messages are equal."""
    e = logs.table(spark, sf_dir, "events")
    key = (
        F.when(F.col("value") < 30, F.lit(None).cast("string"))
        .when(F.col("value") < 40, F.lit(""))
        .otherwise((F.col("user_id") % 10).cast("string"))
    )
    rows = e.select(
        F.lit("copies").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.encode(key, "UTF-8").alias("key"),
        F.encode("event_type", "UTF-8").alias("value"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("timestamp"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"),
        "ts", "event_id", F.col("value").alias("amount"),
    )
    path = scratch_path(spark, "copies")
    number_rows(rows, ["topic", "partition"], ["ts", "event_id"], "offset").write.parquet(path)
    return path


@query("backup_as_of", f"""WITH {sql.BACKUPS},
requests AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id,
  'store-' || (l_suppkey % 3) AS storage_id, l_shipdate AS ts FROM lineitem),
newest AS (SELECT storage_id, "timestamp", max(backup_id) AS backup_id FROM backups GROUP BY storage_id, "timestamp")
SELECT r.request_id, r.storage_id, r.ts, n.backup_id, n."timestamp" AS backup_ts
FROM requests r ASOF LEFT JOIN newest n ON r.storage_id = n.storage_id AND r.ts >= n."timestamp" """)
def backup_as_of(spark, sf_dir):
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    requests = logs.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *[F.col(p).cast("string") for p in parts]).alias("request_id"),
        F.concat(F.lit("store-"), (F.col("l_suppkey") % 3).cast("string")).alias("storage_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
    found = replay.backup_as_of(requests, logs.backups(spark, sf_dir))
    return found.select("request_id", "storage_id", plain("ts"), "backup_id", plain("backup_ts"))


@query("latest_backup", f"""WITH {sql.BACKUPS}, b AS (SELECT * FROM backups WHERE "timestamp" <= TIMESTAMP '1999-06-30')
SELECT storage_id, backup_id, "timestamp" FROM (
  SELECT *, row_number() OVER (PARTITION BY storage_id ORDER BY "timestamp" DESC, backup_id DESC) AS rn FROM b) WHERE rn = 1""")
def latest_backup(spark, sf_dir):
    moment = dt.datetime(1999, 6, 30, tzinfo=dt.timezone.utc)
    found = replay.latest_backup(logs.backups(spark, sf_dir), moment, ["storage_id"])
    return found.select("storage_id", "backup_id", plain("timestamp"))


def restored(spark, source, **more):
    """Restores a backup into files and reads them like a topic log."""
    job = RestoreJob(restore_id="restore", root=source.root, **more)
    path = scratch_path(spark, "restored")
    restore.restore_to_files(restore.restored_rows(spark, job), path)
    return as_text(read_log(spark, path))


@query("restore_full", f"WITH {sql.EVENTS} SELECT {ROWS_SQL} FROM events_log")
def restore_full(spark, sf_dir):
    source = archived(spark, sf_dir, "events", 100)
    return restored(spark, source, backup_id=source.backup_id, workers=5)


@query("restore_selective", f"""WITH {sql.EVENTS} SELECT {ROWS_SQL} FROM events_log
WHERE topic IN ('events.purchase', 'events.signup') AND "timestamp" <= TIMESTAMP '2024-01-20'""")
def restore_selective(spark, sf_dir):
    source = archived(spark, sf_dir, "events", 100)
    chosen = (TopicSelector("glob", "events.purchase"), TopicSelector("glob", "events.signup"))
    # The catalog time is later than the rows, so the backup is named as well.
    moment = dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc)
    return restored(spark, source, backup_id=source.backup_id, backup_timestamp=moment,
                    selectors=chosen)


@query("restore_renamed", f"""WITH {sql.ORDERS}
SELECT topic || '-restored' AS topic, "partition", "offset", "key", "value", "timestamp", headers
FROM orders_log WHERE topic IN ('orders.f', 'orders.o')""")
def restore_renamed(spark, sf_dir):
    source = archived(spark, sf_dir, "orders", 500, segmentation="offset")
    chosen = (TopicSelector("glob", "orders.[fo]"),)
    mapping = {"orders.f": "orders.f-restored", "orders.o": "orders.o-restored"}
    return restored(spark, source, backup_id=source.backup_id, selectors=chosen, mapping=mapping)


@query("restore_partitions", f"""WITH {sql.LINEITEM} SELECT {ROWS_SQL} FROM lineitem_log
WHERE topic = 'lineitem.n' OR (topic = 'lineitem.a' AND "partition" IN (0, 1)) OR (topic = 'lineitem.r' AND "partition" = 1)""")
def restore_partitions(spark, sf_dir):
    source = archived(spark, sf_dir, "lineitem", 1000)
    wanted = {"lineitem.a": [0, 1], "lineitem.r": [1]}
    return restored(spark, source, backup_id=source.backup_id, partition_filter=wanted)


@query("restore_job", f"""WITH {sql.ORDERS}, kept AS (SELECT 'orders.back' AS topic, "partition" FROM orders_log WHERE topic <> 'orders.p')
SELECT 'restore-1' AS job_id, topic, count(DISTINCT "partition") AS partitions_total, count(DISTINCT "partition") AS partitions_completed,
  count(*) AS messages, 'completed' AS status, 'Completed' AS phase FROM kept GROUP BY topic""")
def restore_job(spark, sf_dir):
    source = archived(spark, sf_dir, "orders", 500)
    job = RestoreJob(
        restore_id="restore-1", root=source.root, backup_id=source.backup_id,
        selectors=(TopicSelector("regex", "[.][fo]$"),),
        mapping={"orders.f": "orders.back", "orders.o": "orders.back"},
    )
    progress = restore.run_restore(spark, job, scratch_path(spark, "restored"))
    states = catalog.latest_state(read_events(spark, source.root))
    return progress.join(states.select("job_id", "phase"), "job_id")


REQUESTS_SQL = """requests AS (SELECT 'rq-' || o_custkey || '-' || o_orderkey AS request_id,
  CASE WHEN o_totalprice < 20000 THEN NULL ELSE 'bk-' || (o_orderkey + CASE WHEN o_totalprice > 450000 THEN 1000000000 ELSE 0 END) END AS backup_id
  FROM orders)"""


def requests(spark, sf_dir):
    """A restore request per order; costly orders name a backup that never was."""
    o = logs.table(spark, sf_dir, "orders")
    far = F.when(F.col("o_totalprice") > 450000, 1_000_000_000).otherwise(0)
    return o.select(
        F.concat_ws("-", F.lit("rq"), F.col("o_custkey").cast("string"),
                    F.col("o_orderkey").cast("string")).alias("request_id"),
        F.when(
            F.col("o_totalprice") >= 20000,
            F.concat(F.lit("bk-"), (F.col("o_orderkey") + far).cast("string")),
        ).alias("backup_id"),
    )


@query("missing_backup", f"""WITH {sql.BACKUPS}, {REQUESTS_SQL}
SELECT request_id, backup_id FROM requests r WHERE backup_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM backups b WHERE b.backup_id = r.backup_id)""")
def missing_backup(spark, sf_dir):
    found = replay.missing_backups(requests(spark, sf_dir), logs.backups(spark, sf_dir))
    return found.select("request_id", "backup_id")


@query("restore_validation", f"""WITH {sql.BACKUPS}, {REQUESTS_SQL}, {sql.CUSTOMER_TOPICS}
SELECT request_id AS subject, 'backup not found' AS problem FROM requests r WHERE backup_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM backups b WHERE b.backup_id = r.backup_id)
UNION ALL SELECT 'glob:payments.*', 'selector matches no topic' WHERE NOT EXISTS (SELECT 1 FROM customer_topics WHERE topic GLOB 'payments.*')
UNION ALL SELECT 'exact:cust.none', 'selector matches no topic' WHERE NOT EXISTS (SELECT 1 FROM customer_topics WHERE topic = 'cust.none')
UNION ALL SELECT 'glob:cust.*', 'selector matches no topic' WHERE NOT EXISTS (SELECT 1 FROM customer_topics WHERE topic GLOB 'cust.*')""")
def restore_validation(spark, sf_dir):
    chosen = [TopicSelector("glob", "payments.*"), TopicSelector("exact", "cust.none"),
              TopicSelector("glob", "cust.*")]
    return restore.validate(
        requests(spark, sf_dir), logs.backups(spark, sf_dir),
        logs.customer_topics(spark, sf_dir), chosen,
    )


@query("catalog_filter", f"""WITH {sql.BACKUPS}
SELECT backup_id, "timestamp", storage_id FROM backups
WHERE "timestamp" BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'
AND (topic_a IN ('orders.p', 'priority.2') OR topic_b IN ('orders.p', 'priority.2'))""")
def catalog_filter(spark, sf_dir):
    found = catalog.filter_backups(
        logs.backups(spark, sf_dir),
        dt.datetime(1996, 1, 1, tzinfo=dt.timezone.utc),
        dt.datetime(1998, 12, 31, tzinfo=dt.timezone.utc),
        ["orders.p", "priority.2"],
    )
    return found.select("backup_id", plain("timestamp"), "storage_id")


@query("catalog_page", f"""WITH {sql.BACKUPS}
SELECT backup_id, "timestamp", storage_id FROM backups ORDER BY "timestamp" DESC, backup_id LIMIT 25 OFFSET 50""")
def catalog_page(spark, sf_dir):
    found = catalog.page(logs.backups(spark, sf_dir), limit=25, offset=50)
    return found.select("backup_id", plain("timestamp"), "storage_id")


def states(spark, sf_dir):
    return catalog.latest_state(logs.job_events(spark, sf_dir))


@query("list_backups", f"""WITH {sql.LATEST}
SELECT job_id, phase, source_id, storage_id, created_at FROM latest
WHERE NOT deleted AND kind = 'backup' AND phase = 'Completed' AND storage_id = 'store-1' AND created_at >= TIMESTAMP '1995-02-01'""")
def list_backups(spark, sf_dir):
    found = catalog.list_jobs(
        states(spark, sf_dir), "backup", phase="Completed", storage_id="store-1",
        created_from=dt.datetime(1995, 2, 1, tzinfo=dt.timezone.utc),
    )
    return found.select("job_id", "phase", "source_id", "storage_id", plain("created_at"))


@query("list_restores", f"""WITH {sql.LATEST}
SELECT job_id, phase, backup_id, target_id, created_at FROM latest
WHERE NOT deleted AND kind = 'restore' AND target_id = 'cluster-3' AND created_at <= TIMESTAMP '1997-12-31'""")
def list_restores(spark, sf_dir):
    found = catalog.list_jobs(
        states(spark, sf_dir), "restore", target_id="cluster-3",
        created_to=dt.datetime(1997, 12, 31, tzinfo=dt.timezone.utc),
    )
    return found.select("job_id", "phase", "backup_id", "target_id", plain("created_at"))


@query("latest_state", f"""WITH {sql.LATEST}
SELECT job_id, kind, seq, ts, phase, backup_id, error FROM latest WHERE NOT deleted""")
def latest_state(spark, sf_dir):
    found = catalog.latest_state(logs.job_events(spark, sf_dir))
    return found.select("job_id", "kind", "seq", plain("ts"), "phase", "backup_id", "error")


@query("job_state", f"""WITH {sql.LATEST}
SELECT job_id, kind, seq, phase FROM latest WHERE job_id = (SELECT max(job_id) FROM latest WHERE NOT deleted)""")
def job_state(spark, sf_dir):
    events = logs.job_events(spark, sf_dir)
    last = catalog.latest_state(events).agg(F.max("job_id")).first()[0]
    return catalog.state_of(events, last).select("job_id", "kind", "seq", "phase")


@query("deleted_jobs", f"""WITH {sql.LATEST} SELECT job_id, seq, phase FROM latest WHERE deleted""")
def deleted_jobs(spark, sf_dir):
    return catalog.deleted_jobs(logs.job_events(spark, sf_dir)).select("job_id", "seq", "phase")


@query("job_checks", """WITH jobs AS (
  SELECT 'b' || o_orderkey AS job_id, CASE WHEN o_totalprice < 50000 THEN NULL ELSE 'c' END AS source_id,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 's' END AS storage_id, o_custkey % 3 AS selectors, o_custkey % 4 AS workers,
    o_orderkey % 5 AS batch_size FROM orders),
restores AS (
  SELECT 'r' || o_orderkey AS job_id, CASE WHEN o_totalprice < 50000 THEN NULL ELSE 's' END AS storage_id,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 't' END AS target_id,
    CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'bk' END AS backup_id,
    CASE WHEN o_custkey % 2 = 0 THEN o_orderdate END AS backup_timestamp, o_custkey % 4 AS workers FROM orders)
SELECT job_id, concat_ws('; ', CASE WHEN source_id IS NULL THEN 'source cluster is required' END,
  CASE WHEN storage_id IS NULL THEN 'target storage is required' END,
  CASE WHEN selectors < 1 THEN 'at least one topic selector is required' END,
  CASE WHEN workers < 1 THEN 'at least one worker is required' END,
  CASE WHEN batch_size < 1 THEN 'batch size must be at least 1' END) AS errors FROM jobs
UNION ALL
SELECT job_id, concat_ws('; ', CASE WHEN storage_id IS NULL THEN 'source storage is required' END,
  CASE WHEN target_id IS NULL THEN 'target cluster is required' END,
  CASE WHEN backup_id = '' AND backup_timestamp IS NULL THEN 'either backup ID or timestamp is required' END,
  CASE WHEN workers < 1 THEN 'at least one worker is required' END) AS errors FROM restores""")
def job_checks(spark, sf_dir):
    o = logs.table(spark, sf_dir, "orders")
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    rich, partial = F.col("o_totalprice") >= 50000, F.col("o_orderstatus") == "P"
    backup_jobs = o.select(
        F.concat(F.lit("b"), order.cast("string")).alias("job_id"),
        F.when(rich, "c").alias("source_id"), F.when(~partial, "s").alias("storage_id"),
        (cust % 3).alias("selectors"), (cust % 4).alias("workers"),
        (order % 5).alias("batch_size"),
    )
    restore_jobs = o.select(
        F.concat(F.lit("r"), order.cast("string")).alias("job_id"),
        F.when(rich, "s").alias("storage_id"), F.when(~partial, "t").alias("target_id"),
        F.when(cust % 3 == 0, "").otherwise("bk").alias("backup_id"),
        F.when(cust % 2 == 0, F.col("o_orderdate")).alias("backup_timestamp"),
        (cust % 4).alias("workers"),
    )
    checked = catalog.check_backup_jobs(backup_jobs).select("job_id", "errors").unionByName(
        catalog.check_restore_jobs(restore_jobs).select("job_id", "errors")
    )
    return checked.withColumn("errors", F.array_join("errors", "; "))


@query("phase_transitions", f"""WITH {sql.JOB_EVENTS}, stepped AS (
  SELECT job_id, seq, phase, lag(phase) OVER (PARTITION BY job_id ORDER BY seq) AS prev_phase FROM job_events)
SELECT job_id, seq, phase, prev_phase, CASE WHEN phase = 'Running' THEN 'already running' ELSE 'not running' END AS problem
FROM stepped WHERE (phase = 'Running' AND prev_phase = 'Running') OR (phase = 'Suspended' AND prev_phase IS DISTINCT FROM 'Running')""")
def phase_transitions(spark, sf_dir):
    found = catalog.illegal_transitions(logs.job_events(spark, sf_dir), width=1000)
    return found.select("job_id", "seq", "phase", "prev_phase", "problem")


@query("backup_totals", f"""WITH {sql.LINEITEM}, segmented AS (SELECT *, {sql.count_segment_sql(100)} AS segment FROM lineitem_log),
manifest AS (SELECT 'bk-' || "partition" AS backup_id, topic, segment, count(*) AS n, sum({sql.size_sql()}) AS b, max("timestamp") AS t,
  max("offset") % 7 <> 3 AS done
  FROM segmented GROUP BY topic, "partition", segment),
per_topic AS (SELECT backup_id, topic, bool_and(done) AS whole, sum(CASE WHEN done THEN n ELSE 0 END) AS n,
  sum(CASE WHEN done THEN b ELSE 0 END) AS b, max(CASE WHEN done THEN t END) AS t FROM manifest GROUP BY backup_id, topic)
SELECT backup_id, count(*) AS topics_discovered, CAST(count_if(whole) AS BIGINT) AS topics_backed_up,
  CAST(sum(n) AS BIGINT) AS messages, CAST(sum(b) AS BIGINT) AS bytes, max(t) AS last_backup_time FROM per_topic GROUP BY backup_id""")
def backup_totals(spark, sf_dir):
    rows = segments.by_count(measured(logs.log(spark, sf_dir, "lineitem"), "timestamp"), 100)
    manifest = (
        rows.groupBy(F.concat(F.lit("bk-"), F.col("partition").cast("string")).alias("backup_id"),
                     "topic", "segment")
        .agg(F.count(F.lit(1)).alias("message_count"), F.sum("size_bytes").alias("size_bytes"),
             F.max("timestamp").alias("written_at"), (F.max("offset") % 7 != 3).alias("done"))
    )
    totals = status.backup_totals(manifest, "written_at")
    return totals.withColumn("last_backup_time", F.col("last_backup_time").cast(NTZ))


@query("worker_totals", f"""WITH {sql.TASK_FACTS}
SELECT job_id, worker_id, count(DISTINCT topic) AS topics, CAST(sum(messages) AS BIGINT) AS messages,
  CAST(sum(bytes) AS BIGINT) AS bytes, max(ts) AS last_heartbeat FROM task_facts GROUP BY job_id, worker_id""")
def worker_totals(spark, sf_dir):
    found = status.worker_totals(logs.task_facts(spark, sf_dir))
    return found.withColumn("last_heartbeat", F.col("last_heartbeat").cast(NTZ))


@query("restore_totals", f"""WITH {sql.TASK_FACTS}
SELECT job_id, count(DISTINCT CASE WHEN status = 'ok' THEN topic END) AS topics_restored,
  CAST(coalesce(sum(CASE WHEN status = 'ok' THEN messages END), 0) AS BIGINT) AS messages,
  CAST(coalesce(sum(CASE WHEN status = 'ok' THEN bytes END), 0) AS BIGINT) AS bytes FROM task_facts GROUP BY job_id""")
def restore_totals(spark, sf_dir):
    return status.restore_totals(logs.task_facts(spark, sf_dir))


PLANNED_SQL = """planned AS (SELECT DISTINCT job_id, topic, "partition" FROM task_facts
  UNION SELECT DISTINCT job_id, topic, CAST(12 AS INTEGER) FROM task_facts WHERE operation = 'put')"""


def planned(facts):
    """Every partition with facts, and one without for topics that take writes."""
    seen = facts.select("job_id", "topic", "partition").distinct()
    extra = facts.where("operation = 'put'").select(
        "job_id", "topic", F.lit(12).cast("int").alias("partition")
    ).distinct()
    return seen.unionByName(extra)


@query("topic_progress", f"""WITH {sql.TASK_FACTS}, {PLANNED_SQL},
done AS (SELECT job_id, topic, "partition", bool_and(status = 'ok') AS done,
  sum(CASE WHEN status = 'ok' THEN messages ELSE 0 END) AS m FROM task_facts GROUP BY job_id, topic, "partition"),
totals AS (SELECT job_id, topic, count(*) AS partitions_total, CAST(count_if(coalesce(done, false)) AS BIGINT) AS partitions_completed,
  CAST(coalesce(sum(m), 0) AS BIGINT) AS messages FROM planned LEFT JOIN done USING (job_id, topic, "partition") GROUP BY job_id, topic)
SELECT *, CASE WHEN partitions_total = partitions_completed THEN 'completed' ELSE 'pending' END AS status FROM totals""")
def topic_progress(spark, sf_dir):
    facts = logs.task_facts(spark, sf_dir)
    return status.topic_progress(planned(facts), facts)


@query("error_list", f"""WITH {sql.TASK_FACTS}
SELECT job_id, 'Worker ' || worker_id || ' - ' || topic || '-partition-' || "partition" || ': ' || operation || ' failed after ' || messages || ' messages' AS message
FROM task_facts WHERE status = 'failed'""")
def error_list(spark, sf_dir):
    failures = logs.task_facts(spark, sf_dir).where("status = 'failed'").withColumn(
        "error",
        F.concat(F.col("operation"), F.lit(" failed after "), F.col("messages").cast("string"),
                 F.lit(" messages")),
    )
    return status.error_rows(failures).select("job_id", "message")


@query("job_phase", f"""WITH {sql.TASK_FACTS},
counts AS (SELECT job_id, worker_id, topic, CAST(count(*) + CASE WHEN max(bytes) > 19000 THEN 1 ELSE 0 END AS BIGINT) AS planned,
  CAST(count_if(status = 'ok') AS BIGINT) AS done, CAST(count_if(status = 'failed') AS BIGINT) AS failed FROM task_facts GROUP BY job_id, worker_id, topic)
SELECT *, CASE WHEN done + failed = 0 THEN 'Pending' WHEN done + failed < planned THEN 'Running' WHEN failed = 0 THEN 'Completed'
  WHEN done > 0 THEN 'PartiallyCompleted' ELSE 'Failed' END AS phase FROM counts""")
def job_phase(spark, sf_dir):
    late = F.when(F.max("bytes") > 19000, 1).otherwise(0)
    counts = logs.task_facts(spark, sf_dir).groupBy("job_id", "worker_id", "topic").agg(
        (F.count(F.lit(1)) + late).alias("planned"),
        F.count_if(F.col("status") == "ok").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return status.job_phase(counts)


@query("message_counters", f"""WITH {sql.TASK_FACTS}
SELECT job_id, topic, worker_id, count(*) AS tasks, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes
FROM task_facts GROUP BY job_id, topic, worker_id""")
def message_counters(spark, sf_dir):
    return status.message_counters(logs.task_facts(spark, sf_dir))


@query("duration_histogram", f"""WITH {sql.TASK_FACTS},
bounds AS (SELECT CAST(b AS VARCHAR) AS le, b FROM (SELECT unnest({list(status.DURATION_BOUNDS_MS)}) AS b) UNION ALL SELECT '+Inf', 9000000000000),
totals AS (SELECT job_id, operation, count(*) AS total_count, CAST(sum(duration_ms) AS BIGINT) AS total_sum FROM task_facts GROUP BY job_id, operation)
SELECT f.job_id, f.operation, any_value(total_count) AS total_count, any_value(total_sum) AS total_sum, le,
  CAST(count_if(duration_ms <= b) AS BIGINT) AS bucket_count
FROM task_facts f CROSS JOIN bounds JOIN totals t ON f.job_id = t.job_id AND f.operation = t.operation GROUP BY f.job_id, f.operation, le""")
def duration_histogram(spark, sf_dir):
    facts = logs.task_facts(spark, sf_dir)
    return status.histogram(facts, "duration_ms", status.DURATION_BOUNDS_MS, ["job_id", "operation"])


@query("storage_op_counts", f"""WITH {sql.TASK_FACTS}
SELECT operation, status, count(*) AS operations FROM task_facts GROUP BY operation, status""")
def storage_op_counts(spark, sf_dir):
    return status.storage_operations(logs.task_facts(spark, sf_dir))


@query("job_report", f"""WITH {sql.LATEST}, {sql.TASK_FACTS},
totals AS (SELECT job_id, count(DISTINCT topic) AS topics, CAST(sum(messages) AS BIGINT) AS messages FROM task_facts GROUP BY job_id)
SELECT l.job_id, kind, phase, created_at, ts AS updated_at, coalesce(topics, 0) AS topics, coalesce(messages, 0) AS messages,
  CAST(epoch(ts) - epoch(created_at) AS BIGINT) AS age_seconds
FROM latest l LEFT JOIN totals t ON l.job_id = t.job_id WHERE NOT deleted""")
def job_report(spark, sf_dir):
    facts = logs.task_facts(spark, sf_dir)
    totals = facts.groupBy("job_id", "topic").agg(F.sum("messages").alias("_m")).groupBy(
        "job_id"
    ).agg(F.count(F.lit(1)).alias("topics"), F.sum("_m").alias("messages"))
    found = status.job_report(states(spark, sf_dir), totals)
    return found.withColumn("created_at", F.col("created_at").cast(NTZ)).withColumn(
        "updated_at", F.col("updated_at").cast(NTZ)
    )


def stream_job(spark, name):
    return BackupJob(
        backup_id="continuous", root=scratch_path(spark, name), batch_size=100, segmentation="offset",
        selectors=(TopicSelector("glob", "*"),),
    )


def run_stream(spark, job, source, checkpoint, files=None):
    run_scheduled(stream_log(spark, source, files), job, checkpoint, timestamp="2024-02-01 00:00:00")


STREAM_SQL = f"""WITH {{log}}
SELECT {ROWS_SQL}, CAST("offset" // 100 AS BIGINT) AS segment FROM {{name}}"""


@query("stream_backup", STREAM_SQL.format(log=sql.EVENTS, name="events_log"))
def stream_backup(spark, sf_dir):
    job = stream_job(spark, "stream")
    run_stream(spark, job, logs.log_path(spark, sf_dir, "events"),
               scratch_path(spark, "checkpoint"), files=1)
    return as_text(read_archive(spark, job.root), "segment")


@query("stream_incremental", STREAM_SQL.format(log=sql.ORDERS, name="orders_log"))
def stream_incremental(spark, sf_dir):
    """Two scheduled runs on one checkpoint; the second takes only new rows."""
    job, source = stream_job(spark, "incremental"), scratch_path(spark, "growing")
    checkpoint = scratch_path(spark, "checkpoint")
    whole = logs.log(spark, sf_dir, "orders")
    early = F.col("timestamp") < F.lit("1998-01-01").cast("timestamp")
    for part in (whole.where(early), whole.where(~early)):
        part.write.mode("append").parquet(source)
        run_stream(spark, job, source, checkpoint)
    return as_text(read_archive(spark, job.root), "segment")


@query("stream_dedup", STREAM_SQL.format(log=sql.EVENTS, name="events_log"))
def stream_dedup(spark, sf_dir):
    """A log delivered twice is archived twice and read once."""
    job, source = stream_job(spark, "twice"), scratch_path(spark, "repeated")
    checkpoint = scratch_path(spark, "checkpoint")
    for _ in range(2):
        logs.log(spark, sf_dir, "events").write.mode("append").parquet(source)
        run_stream(spark, job, source, checkpoint)
    return as_text(read_archive(spark, job.root, job.backup_id, deduplicate=True), "segment")


@query("stream_manifest", f"""WITH {sql.EVENTS}
SELECT topic, "partition", CAST("offset" // 100 AS BIGINT) AS segment, min("offset") AS start_offset, max("offset") AS end_offset,
  count(*) AS message_count, CAST(sum({sql.size_sql()}) AS BIGINT) AS size_bytes
FROM events_log GROUP BY topic, "partition", "offset" // 100""")
def stream_manifest(spark, sf_dir):
    """One segment may be filled by several micro-batches; the manifest has one row."""
    job = stream_job(spark, "stream-manifest")
    run_stream(spark, job, logs.log_path(spark, sf_dir, "events"),
               scratch_path(spark, "checkpoint"), files=1)
    return read_segments(spark, job.root).select(
        "topic", "partition", "segment", "start_offset", "end_offset", "message_count",
        "size_bytes",
    )


@query("stream_totals", f"""WITH {sql.LINEITEM}
SELECT topic, count(*) AS messages, CAST(sum({sql.size_sql()}) AS BIGINT) AS bytes, max("timestamp") AS last_message
FROM lineitem_log GROUP BY topic""")
def stream_totals(spark, sf_dir):
    out = scratch_path(spark, "totals")
    source = stream_log(spark, logs.log_path(spark, sf_dir, "lineitem"), 2)
    start_totals(source, out, scratch_path(spark, "checkpoint")).awaitTermination()
    found = latest_totals(spark, out)
    return found.withColumn("last_message", F.col("last_message").cast(NTZ))




@query("stream_restore", f"WITH {sql.ORDERS} SELECT {ROWS_SQL} FROM orders_log")
def stream_restore(spark, sf_dir):
    """Two scheduled runs, then a restore of what they wrote."""
    job, source = stream_job(spark, "streamed"), scratch_path(spark, "growing")
    checkpoint = scratch_path(spark, "checkpoint")
    whole = logs.log(spark, sf_dir, "orders")
    early = F.col("timestamp") < F.lit("1997-01-01").cast("timestamp")
    for part in (whole.where(early), whole.where(~early)):
        part.write.mode("append").parquet(source)
        run_stream(spark, job, source, checkpoint)
    return restored(spark, job, backup_id=job.backup_id)


@query("stream_new_checkpoint", f"WITH {sql.EVENTS} SELECT {ROWS_SQL} FROM events_log")
def stream_new_checkpoint(spark, sf_dir):
    """The checkpoint is lost and the source holds its newer half only: nothing is lost or doubled."""
    job = stream_job(spark, "renewed")
    whole = logs.log(spark, sf_dir, "events")
    late = F.col("offset") >= 200
    for rows, name in ((whole.where("offset < 300"), "old"), (whole.where(late), "new")):
        source = scratch_path(spark, f"source-{name}")
        rows.write.parquet(source)
        run_stream(spark, job, source, scratch_path(spark, f"checkpoint-{name}"))
    return restored(spark, job, backup_id=job.backup_id)


@query("restore_keep_existing", f"""WITH {sql.ORDERS}
SELECT {ROWS_SQL} FROM orders_log UNION ALL
SELECT 'other' AS topic, "partition", "offset", "key", "value", "timestamp", headers FROM orders_log WHERE topic = 'orders.o'""")
def restore_keep_existing(spark, sf_dir):
    """The target holds a part of the backup and another topic; both stay as they are."""
    source = archived(spark, sf_dir, "orders", 500)
    whole, path = logs.log(spark, sf_dir, "orders"), scratch_path(spark, "target")
    whole.where("offset % 3 = 1").write.parquet(f"{path}/held")
    whole.where("topic = 'orders.o'").withColumn("topic", F.lit("other")).write.parquet(f"{path}/other")
    job = RestoreJob("keep", source.root, source.backup_id)
    restore.run_restore(spark, job, path)
    return as_text(read_log(spark, path))


@query("restore_from_objects", f"""WITH {sql.ORDERS} SELECT {ROWS_SQL} FROM orders_log
WHERE topic = 'orders.f' OR (topic = 'orders.o' AND "partition" IN (1, 2))""")
def restore_from_objects(spark, sf_dir):
    source = archived(spark, sf_dir, "orders", 500, layout="objects")
    return restored(spark, source, backup_id=source.backup_id, layout="objects",
                    selectors=(TopicSelector("regex", "[.][fo]$"),), partition_filter={"orders.o": [1, 2]})


DAMAGE = """CASE WHEN "offset" % 400 = 7 THEN 'value' WHEN "offset" % 400 = 107 THEN 'time'
  WHEN "offset" % 400 = 207 THEN 'place' WHEN "offset" % 400 = 307 THEN 'cut' END"""


@query("quarantine_partial", f"""WITH {sql.ORDERS},
segmented AS (SELECT *, {sql.count_segment_sql(100)} AS segment, {DAMAGE} AS damage FROM orders_log)
SELECT topic, "partition", segment, count(damage) = 0 AS readable, CASE WHEN count(damage) = 0 THEN count(*) ELSE 0 END AS messages
FROM segmented GROUP BY topic, "partition", segment""")
def quarantine_partial(spark, sf_dir):
    """One damaged value, time or offset, or a cut message, condemns its whole object."""
    rows = segments.by_count(logs.log(spark, sf_dir, "orders"), 100)
    place, json = F.col("offset") % 400, message_json()
    damaged = (
        F.when(place == 7, F.regexp_replace(json, '"Value":"[^"]*"', '"Value":[1]'))
        .when(place == 107, F.regexp_replace(json, '"Timestamp":"[^"]*"', '"Timestamp":"soon"'))
        .when(place == 207, F.regexp_replace(json, '"Offset":[0-9]*,', ""))
        .when(place == 307, F.substring(json, 1, 20))
        .otherwise(json)
    )
    root = scratch_path(spark, "damaged")
    write_objects(rows, root, "nightly", json=damaged).count()
    scanned = segmentfiles.scan(spark, f"{root}/backups")
    group = ["topic", "partition", "segment"]
    good = segmentfiles.messages(scanned).groupBy(*group).agg(F.count(F.lit(1)).alias("messages"))
    bad = segmentfiles.quarantine(scanned).select(*group, F.lit(0).cast("bigint").alias("messages"))
    return good.withColumn("readable", F.lit(True)).unionByName(bad.withColumn("readable", F.lit(False)))


@query("progress_point_in_time", f"""WITH {sql.ORDERS}, cut AS (
  SELECT topic, "partition", CASE WHEN "partition" <> 1 THEN sum(CASE WHEN "timestamp" <= TIMESTAMP '1997-06-30' THEN 1 ELSE 0 END) ELSE 0 END AS n
  FROM orders_log GROUP BY topic, "partition")
SELECT topic, count(*) AS partitions_total, count_if("partition" <> 1) AS partitions_completed, CAST(sum(n) AS BIGINT) AS messages FROM cut GROUP BY topic""")
def progress_point_in_time(spark, sf_dir):
    """A restore up to a time, from which one partition was withheld."""
    source = archived(spark, sf_dir, "orders", 500)
    moment = dt.datetime(1997, 6, 30, tzinfo=dt.timezone.utc)
    job, path = RestoreJob("r", source.root, source.backup_id, backup_timestamp=moment), scratch_path(spark, "out")
    rows = restore.restored_rows(spark, job)
    restore.restore_to_files(rows.where("partition <> 1"), path, restore_id="r")
    found = restore.progress(spark, job, source.backup_id, rows, path)
    return found.select("topic", "partitions_total", "partitions_completed", "messages")


@query("restore_verified", f"""WITH {sql.LINEITEM}, segmented AS (SELECT *, {sql.count_segment_sql(1000)} AS segment FROM lineitem_log)
SELECT topic, "partition", segment, count(*) AS messages, CAST(0 AS BIGINT) AS damaged FROM segmented GROUP BY topic, "partition", segment""")
def restore_verified(spark, sf_dir):
    """Every stored row hash is the hash of the row's fields."""
    source = archived(spark, sf_dir, "lineitem", 1000)
    return restore.verify_archive(spark, source.root, source.backup_id)


def catalog_of_backups(spark, sf_dir):
    """One archive with a backup of each order status, a month apart."""
    root, log = scratch_path(spark, "catalog"), logs.log(spark, sf_dir, "orders")
    for month, status_name in enumerate(("f", "o", "p"), 1):
        job = BackupJob(f"orders-{status_name}", root, (TopicSelector("exact", f"orders.{status_name}"),),
                        batch_size=1000, segmentation="offset")
        run_backup(log, job, timestamp=f"2024-0{month}-01 00:00:00")
    return root


@query("catalog_real", f"""WITH {sql.ORDERS}
SELECT DISTINCT 'orders-' || substr(topic, 8) AS backup_id, topic AS topics FROM orders_log WHERE topic IN ('orders.o', 'orders.p')""")
def catalog_real(spark, sf_dir):
    """Backups of the stored catalog, by topic and time."""
    root = catalog_of_backups(spark, sf_dir)
    since = dt.datetime(2024, 1, 15, tzinfo=dt.timezone.utc)
    found = catalog.filter_backups(read_backups(spark, root), since, None, ["orders.f", "orders.o", "orders.p"])
    return catalog.page(found, 10).select("backup_id", F.array_join("topics", ",").alias("topics"))


@query("restore_deleted", f"""WITH {sql.ORDERS}
SELECT 'orders-p' AS asked, 'refused' AS answer, CAST(0 AS BIGINT) AS messages UNION ALL
SELECT 'newest', 'orders-o', count(*) FROM orders_log WHERE topic = 'orders.o'""")
def restore_deleted(spark, sf_dir):
    """A deleted backup is neither restored by name nor chosen as the newest."""
    root = catalog_of_backups(spark, sf_dir)
    job_log.delete(spark, root, "orders-p")
    named = restore.chosen_backup(spark, RestoreJob("r", root, "orders-p"))
    moment = dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc)
    newest = RestoreJob("r", root, backup_timestamp=moment)
    rows = restore.restored_rows(spark, newest).agg(F.count(F.lit(1)).alias("messages")).select(
        F.lit("newest").alias("asked"), F.lit(restore.chosen_backup(spark, newest)).alias("answer"), "messages")
    refused = spark.range(1).select(
        F.lit("orders-p").alias("asked"), F.lit("restored" if named else "refused").alias("answer"),
        F.lit(0).cast("long").alias("messages"))
    return rows.unionByName(refused)
