"""Queries on segments, manifests, keys and segment objects."""

from pyspark.sql import functions as F

from logkeep.functions.messages import measured, message_json
from logkeep.functions.paths import parse_key, storage_key
from logkeep.functions.patterns import TopicSelector
from logkeep.operators import manifests, segments, topics
from logkeep.plans.backup import run_backup
from logkeep.plans.jobs import BackupJob
from logkeep.session import scratch_path
from logkeep.sinks.segmentfiles import topic_metadata_objects, write_objects, write_texts
from logkeep.sources import segmentfiles
from logkeep.sources.archive import read_archive, read_segments, read_topics
from logkeep.sources.storage import list_segments
from workload import logs
from workload import sqlparts as sql
from workload.registry import query

PLACE = ["topic", "partition", "offset"]
PLACE_SQL = 'topic, "partition", "offset"'
MANIFEST = ["backup_id", "topic", "partition", "segment", "start_offset", "end_offset",
            "message_count", "size_bytes", "storage_key"]
MANIFEST_SQL = 'backup_id, topic, "partition", segment, start_offset, end_offset, message_count, size_bytes, storage_key'

ROWS = ["topic", "partition", "offset", "key", "value", "timestamp", "headers"]
ROWS_SQL = 'topic, "partition", "offset", "key", "value", "timestamp", headers'


def as_text(rows, *more):
    """Log rows with texts for bytes and headers, and plain timestamps."""
    headers = F.array_join(
        F.transform(
            "headers", lambda h: F.concat_ws("=", h["key"], F.decode(h["value"], "UTF-8"))
        ),
        ",",
    )
    return rows.select(
        "topic", "partition", "offset",
        F.decode("key", "UTF-8").alias("key"),
        F.decode("value", "UTF-8").alias("value"),
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        headers.alias("headers"),
        *more,
    )


def cut(log, batch, backup_id):
    """Sizes and places of a log, cut by count; all a manifest needs."""
    return segments.by_count(measured(log), batch).withColumn("backup_id", F.lit(backup_id))


@query("segment_by_count", f"""WITH {sql.EVENTS}
SELECT {PLACE_SQL}, {sql.count_segment_sql(100)} AS segment FROM events_log""")
def segment_by_count(spark, sf_dir):
    return segments.by_count(logs.log(spark, sf_dir, "events").select(*PLACE), 100)


@query("segment_by_count_gapped", f"""WITH {sql.GAPPED}
SELECT {PLACE_SQL}, {sql.count_segment_sql(100)} AS segment FROM gapped_log""")
def segment_by_count_gapped(spark, sf_dir):
    return segments.by_count(logs.gapped(spark, sf_dir).select(*PLACE), 100)


@query("segment_by_count_twolevel", f"""WITH {sql.LINEITEM}
SELECT {PLACE_SQL}, {sql.count_segment_sql(1000)} AS segment FROM lineitem_log""")
def segment_by_count_twolevel(spark, sf_dir):
    return segments.by_count(logs.log(spark, sf_dir, "lineitem").select(*PLACE), 1000, width=256)


@query("segment_by_offset", f"""WITH {sql.EVENTS}
SELECT {PLACE_SQL}, CAST(("offset" - min("offset") OVER (PARTITION BY topic, "partition")) // 100 AS BIGINT) AS segment
FROM events_log""")
def segment_by_offset(spark, sf_dir):
    return segments.by_offset(logs.log(spark, sf_dir, "events").select(*PLACE), 100)


@query("segment_by_offset_gapped", f"""WITH {sql.GAPPED}
SELECT {PLACE_SQL}, CAST(("offset" - min("offset") OVER (PARTITION BY topic, "partition")) // 100 AS BIGINT) AS segment
FROM gapped_log""")
def segment_by_offset_gapped(spark, sf_dir):
    return segments.by_offset(logs.gapped(spark, sf_dir).select(*PLACE), 100)


WALK_SQL = f"""WITH RECURSIVE {sql.EVENTS},
numbered AS (SELECT {PLACE_SQL}, "timestamp" AS ts,
  row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS rn FROM events_log),
walk AS (
  SELECT topic, "partition", "offset", rn, ts, 0::BIGINT AS segment, 1 AS n, ts AS flushed, false AS closed
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT s.topic, s."partition", s."offset", s.rn, s.ts, s.segment, s.n, s.flushed,
         s.n >= 20 OR s.ts - s.flushed >= INTERVAL 1 DAY AS closed
  FROM (SELECT r.topic, r."partition", r."offset", r.rn, r.ts,
               w.segment + CASE WHEN w.closed THEN 1 ELSE 0 END AS segment,
               CASE WHEN w.closed THEN 1 ELSE w.n + 1 END AS n,
               CASE WHEN w.closed THEN w.ts ELSE w.flushed END AS flushed
        FROM walk w JOIN numbered r ON r.topic = w.topic AND r."partition" = w."partition" AND r.rn = w.rn + 1) s)"""


@query("segment_by_size_or_interval", f"{WALK_SQL} SELECT {PLACE_SQL}, segment FROM walk")
def segment_by_size_or_interval(spark, sf_dir):
    rows = logs.log(spark, sf_dir, "events").select(*PLACE, "timestamp")
    return segments.by_size_or_interval(rows, 20, 86_400).select(*PLACE, "segment")


@query("segment_manifest", f"""WITH {sql.EVENTS}, {sql.manifest_sql("events_log", 100, "nightly")}
SELECT {MANIFEST_SQL} FROM manifest""")
def segment_manifest(spark, sf_dir):
    rows = topics.select_for_backup(
        logs.log(spark, sf_dir, "events"), [TopicSelector("glob", "events.*")]
    )
    return manifests.segment_manifest(cut(rows, 100, "nightly")).select(*MANIFEST)


@query("segment_manifest_gapped", f"""WITH {sql.GAPPED}, {sql.manifest_sql("gapped_log", 100, "nightly")}
SELECT {MANIFEST_SQL} FROM manifest""")
def segment_manifest_gapped(spark, sf_dir):
    rows = cut(logs.gapped(spark, sf_dir), 100, "nightly")
    return manifests.segment_manifest(rows).select(*MANIFEST)


@query("backup_manifest", f"""WITH {sql.LINEITEM}, {sql.manifest_sql("lineitem_log", 50, "weekly")}
SELECT backup_id, topic, "partition", CAST(segment // 10 AS BIGINT) AS page, count(*) AS page_segments,
  string_agg(segment || ':' || start_offset || '-' || end_offset || ':' || message_count || ':' || size_bytes, ',' ORDER BY segment) AS segments
FROM manifest GROUP BY backup_id, topic, "partition", segment // 10""")
def backup_manifest(spark, sf_dir):
    rows = cut(logs.log(spark, sf_dir, "lineitem"), 50, "weekly")
    nested = manifests.nested_manifest(manifests.segment_manifest(rows), page_segments=10)
    text = F.array_join(
        F.transform(
            "segments",
            lambda s: F.concat(
                s["segment_number"].cast("string"), F.lit(":"),
                s["start_offset"].cast("string"), F.lit("-"), s["end_offset"].cast("string"),
                F.lit(":"), s["message_count"].cast("string"), F.lit(":"),
                s["size_bytes"].cast("string"),
            ),
        ),
        ",",
    )
    return nested.select(
        "backup_id", "topic", "partition", "page",
        F.size("segments").cast("bigint").alias("page_segments"), text.alias("segments"),
    )


@query("topic_manifest", f"""WITH {sql.ORDERS}, {sql.manifest_sql("orders_log", 100, "weekly")}
SELECT backup_id, topic, CAST(count(DISTINCT "partition") AS INTEGER) AS partitions, count(*) AS segments,
  CAST(sum(message_count) AS BIGINT) AS messages, CAST(sum(size_bytes) AS BIGINT) AS bytes
FROM manifest GROUP BY backup_id, topic""")
def topic_manifest(spark, sf_dir):
    rows = cut(logs.log(spark, sf_dir, "orders"), 100, "weekly")
    return manifests.topic_manifest(manifests.segment_manifest(rows))


@query("segment_lookup", f"""WITH {sql.ORDERS}, {sql.manifest_sql("orders_log", 100, "weekly")}
SELECT {MANIFEST_SQL} FROM manifest WHERE topic = 'orders.f' AND "partition" = 1""")
def segment_lookup(spark, sf_dir):
    rows = cut(logs.log(spark, sf_dir, "orders"), 100, "weekly")
    found = manifests.segments_of(manifests.segment_manifest(rows), "orders.f", 1)
    return found.orderBy("segment").select(*MANIFEST)


@query("offset_gaps", f"""WITH {sql.GAPPED}
SELECT topic, "partition", previous + 1 AS gap_start, "offset" - 1 AS gap_end, "offset" - previous - 1 AS missing
FROM (SELECT {PLACE_SQL}, lag("offset") OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS previous FROM gapped_log)
WHERE "offset" > previous + 1""")
def offset_gaps(spark, sf_dir):
    return segments.offset_gaps(logs.gapped(spark, sf_dir), width=128)


@query("storage_keys", f"""WITH {sql.LINEITEM}, {sql.manifest_sql("lineitem_log", 200, "weekly", "prod/")}
SELECT topic, "partition", segment, storage_key FROM manifest""")
def storage_keys(spark, sf_dir):
    rows = cut(logs.log(spark, sf_dir, "lineitem"), 200, "weekly")
    found = manifests.segment_manifest(rows, prefix="prod/")
    return found.select("topic", "partition", "segment", "storage_key")


@query("parse_storage_keys", f"""WITH {sql.LINEITEM}, {sql.manifest_sql("lineitem_log", 200, "weekly", "s3a://bucket/prod/")},
keys AS (SELECT storage_key AS path FROM manifest UNION ALL SELECT url FROM pages)
SELECT path, CASE WHEN m THEN regexp_extract(path, p, 1) END AS backup_id,
  CASE WHEN m THEN regexp_extract(path, p, 2) END AS topic,
  CASE WHEN m THEN TRY_CAST(regexp_extract(path, p, 3) AS INTEGER) END AS "partition",
  CASE WHEN m THEN TRY_CAST(regexp_extract(path, p, 4) AS BIGINT) END AS segment
FROM (SELECT path, p, regexp_matches(path, p) AS m FROM keys,
  (SELECT '(?:^|/)backups/([^/]+)/topics/([^/]+)/partition-([0-9]+)/segment-([0-9]+)[.]json([.]gz)?$' AS p))""")
def parse_storage_keys(spark, sf_dir):
    rows = cut(logs.log(spark, sf_dir, "lineitem"), 200, "weekly")
    keys = manifests.segment_manifest(rows).select(
        F.concat(F.lit("s3a://bucket/prod/"), "storage_key").alias("path")
    )
    other = logs.table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    parsed = keys.unionByName(other).withColumn("_key", parse_key(F.col("path")))
    return parsed.select(
        "path", "_key.backup_id", "_key.topic", "_key.partition", "_key.segment"
    )


def archived(spark, sf_dir, name, batch, **more):
    """A fresh archive of one derived log."""
    root = scratch_path(spark, f"archive-{name}")
    job = BackupJob(
        backup_id=f"{name}-backup", root=root, selectors=(TopicSelector("glob", f"{name}.*"),),
        batch_size=batch, **more,
    )
    facts = logs.log(spark, sf_dir, name).select(F.col("topic").alias("name")).distinct().select(
        "name",
        F.lit(3).cast("smallint").alias("replication_factor"),
        F.create_map(F.lit("retention"), F.lit("week")).alias("config"),
    )
    run_backup(logs.log(spark, sf_dir, name), job, topic_facts=facts,
               timestamp="2024-02-01 00:00:00")
    return job


@query("archive_roundtrip", f"""WITH {sql.EVENTS}
SELECT {ROWS_SQL}, {sql.count_segment_sql(100)} AS segment FROM events_log""")
def archive_roundtrip(spark, sf_dir):
    job = archived(spark, sf_dir, "events", 100)
    return as_text(read_archive(spark, job.root), "segment")


@query("archive_manifest", f"""WITH {sql.ORDERS}, {sql.manifest_sql("orders_log", 100, "orders-backup")}
SELECT {MANIFEST_SQL} FROM manifest""")
def archive_manifest(spark, sf_dir):
    job = archived(spark, sf_dir, "orders", 100)
    return read_segments(spark, job.root).select(*MANIFEST)


@query("archive_by_interval", f"""{WALK_SQL}
SELECT topic, "partition", segment, min("offset") AS start_offset, max("offset") AS end_offset, count(*) AS message_count
FROM walk GROUP BY topic, "partition", segment""")
def archive_by_interval(spark, sf_dir):
    job = archived(spark, sf_dir, "events", 20, segmentation="interval", interval_seconds=86_400)
    return read_segments(spark, job.root).select(
        "topic", "partition", "segment", "start_offset", "end_offset", "message_count")


@query("topic_metadata", f"""WITH {sql.ORDERS}
SELECT topic AS name, CAST(count(DISTINCT "partition") AS INTEGER) AS partitions, CAST(3 AS SMALLINT) AS replication_factor,
  'retention=week' AS config, 'backups/orders-backup/metadata/topics/' || topic || '.json' AS storage_key
FROM orders_log GROUP BY topic""")
def topic_metadata(spark, sf_dir):
    job = archived(spark, sf_dir, "orders", 500, segmentation="offset")
    objects = topic_metadata_objects(read_topics(spark, job.root), job.backup_id)
    written = scratch_path(spark, "written")
    write_texts(objects, job.root).write.parquet(written)
    read = (
        spark.read.schema(
            "Name string, Partitions int, ReplicationFactor smallint, Config map<string,string>"
        )
        .option("recursiveFileLookup", "true")
        .json(f"{job.root}/backups/{job.backup_id}/metadata/topics")
    )
    return read.select(
        F.col("Name").alias("name"), F.col("Partitions").alias("partitions"),
        F.col("ReplicationFactor").alias("replication_factor"),
        F.concat(F.lit("retention="), F.col("Config")["retention"]).alias("config"),
        F.regexp_extract("_metadata.file_path", "(backups/.*)$", 1).alias("storage_key"),
    )


def objects_of(spark, rows, backup_id, **more):
    """Writes segment objects; gives the root and the written manifest."""
    root = scratch_path(spark, f"objects-{backup_id}")
    manifest = f"{root}/manifest"
    write_objects(rows, root, backup_id, **more).write.parquet(manifest)
    return root, spark.read.parquet(manifest)


@query("interop_roundtrip", f"""WITH {sql.EVENTS}
SELECT {ROWS_SQL}, {sql.count_segment_sql(200)} AS segment FROM events_log""")
def interop_roundtrip(spark, sf_dir):
    rows = segments.by_count(logs.log(spark, sf_dir, "events"), 200)
    root, _ = objects_of(spark, rows, "nightly")
    found = segmentfiles.messages(segmentfiles.scan(spark, f"{root}/backups"))
    return as_text(found, "segment")


@query("object_listing", f"""WITH {sql.ORDERS}, {sql.manifest_sql("orders_log", 300, "nightly")}
SELECT backup_id, topic, "partition", segment, storage_key, message_count, true AS size_agrees FROM manifest""")
def object_listing(spark, sf_dir):
    rows = segments.by_count(logs.log(spark, sf_dir, "orders"), 300)
    root, manifest = objects_of(spark, rows, "nightly")
    listed = list_segments(spark, root).select("storage_key", F.col("size_bytes").alias("listed"))
    return manifest.join(listed, "storage_key").select(
        "backup_id", "topic", "partition", "segment", "storage_key", "message_count",
        (F.col("listed") == F.col("size_bytes")).alias("size_agrees"),
    )


@query("segment_quarantine", f"""WITH {sql.ORDERS},
segmented AS (SELECT *, {sql.count_segment_sql(100)} AS segment FROM orders_log)
SELECT topic, "partition", segment, max(CASE WHEN "value" = '1-URGENT' THEN 1 ELSE 0 END) = 0 AS readable,
  CASE WHEN max(CASE WHEN "value" = '1-URGENT' AND "offset" % 100 = 7 THEN 1 ELSE 0 END) = 1 THEN 0 ELSE count(*) END AS messages
FROM segmented GROUP BY topic, "partition", segment""".replace(
    "max(CASE WHEN \"value\" = '1-URGENT' THEN 1 ELSE 0 END) = 0",
    "max(CASE WHEN \"value\" = '1-URGENT' AND \"offset\" % 100 = 7 THEN 1 ELSE 0 END) = 0",
))
def segment_quarantine(spark, sf_dir):
    rows = segments.by_count(logs.log(spark, sf_dir, "orders"), 100)
    broken = (F.decode("value", "UTF-8") == "1-URGENT") & (F.col("offset") % 100 == 7)
    json = F.when(broken, F.lit('{"Offset": ')).otherwise(message_json())
    root, _ = objects_of(spark, rows, "nightly", json=json)
    scanned = segmentfiles.scan(spark, f"{root}/backups")
    group = ["topic", "partition", "segment"]
    good = segmentfiles.messages(scanned).groupBy(*group).agg(
        F.count(F.lit(1)).alias("messages")
    ).withColumn("readable", F.lit(True))
    bad = segmentfiles.quarantine(scanned).select(
        *group, F.lit(False).alias("readable"), F.lit(0).cast("bigint").alias("messages")
    )
    return good.unionByName(bad)


@query("manifest_vs_objects", f"""WITH {sql.GAPPED}, {sql.manifest_sql("events_log", 100, "nightly")},
kept AS (SELECT *, CAST("offset" // 100 AS BIGINT) AS segment FROM gapped_log WHERE topic <> 'events.error'),
objects AS (
  SELECT {sql.key_sql("'nightly'", "segment")} AS storage_key, CAST(sum({sql.size_sql()}) AS BIGINT) AS size_bytes
  FROM kept GROUP BY topic, "partition", segment
  UNION ALL SELECT url, length(url) FROM pages)
SELECT storage_key, m.size_bytes AS manifest_bytes, o.size_bytes AS object_bytes,
  CASE WHEN o.size_bytes IS NULL THEN 'missing' WHEN m.size_bytes IS NULL THEN 'orphan' ELSE 'size_mismatch' END AS finding
FROM manifest m FULL JOIN objects o USING (storage_key)
WHERE o.size_bytes IS DISTINCT FROM m.size_bytes""")
def manifest_vs_objects(spark, sf_dir):
    whole = cut(logs.log(spark, sf_dir, "events"), 100, "nightly")
    kept = logs.gapped(spark, sf_dir).where(F.col("topic") != "events.error")
    objects = manifests.segment_manifest(
        segments.by_absolute_offset(measured(kept), 100).withColumn("backup_id", F.lit("nightly"))
    ).select("storage_key", "size_bytes")
    strangers = logs.table(spark, sf_dir, "pages").select(
        F.col("url").alias("storage_key"), F.length("url").cast("bigint").alias("size_bytes")
    )
    return manifests.manifest_against_objects(
        manifests.segment_manifest(whole), objects.unionByName(strangers)
    )


CHECK_TEXT = "topic || '|' || \"partition\" || '|' || \"offset\" || '|' || \"key\" || '|' || coalesce(\"value\", '-')"


@query("segment_checksum", f"""WITH {sql.EVENTS}, segmented AS (SELECT *, {sql.count_segment_sql(100)} AS segment FROM events_log)
SELECT 'nightly' AS backup_id, topic, "partition", segment, count(*) AS message_count,
  hex(bit_xor(('0x' || substr(md5({CHECK_TEXT}), 1, 15))::BIGINT)) AS checksum
FROM segmented GROUP BY topic, "partition", segment""")
def segment_checksum(spark, sf_dir):
    log = logs.log(spark, sf_dir, "events")
    text = F.concat_ws(
        "|", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"),
        F.decode("key", "UTF-8"), F.coalesce(F.decode("value", "UTF-8"), F.lit("-")),
    )
    value = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    rows = segments.by_count(log.select(*PLACE, value.alias("check")), 100)
    return manifests.segment_checksums(
        rows.withColumn("backup_id", F.lit("nightly")), F.col("check")
    )


@query("storage_key_uncompressed", f"""WITH {sql.ORDERS}
SELECT topic, "partition", "offset", 'prod/backups/b1/topics/' || topic || '/partition-' || "partition" || '/segment-' || printf('%06d', "offset" // 10) || '.json' AS storage_key FROM orders_log""")
def storage_key_uncompressed(spark, sf_dir):
    rows = segments.by_absolute_offset(logs.log(spark, sf_dir, "orders"), 10)
    key = storage_key(F.lit("b1"), F.col("topic"), F.col("partition"), F.col("segment"),
                      "prod", compressed=False)
    return rows.select(*PLACE, key.alias("storage_key"))
