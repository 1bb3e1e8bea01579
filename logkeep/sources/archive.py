"""Reading the Parquet archive and its manifests."""

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logkeep.operators.joins import join_small
from logkeep.schemas import (
    ARCHIVE_SCHEMA, BACKUPS_SCHEMA, PIECES_SCHEMA, SEGMENTS_SCHEMA, SNAPSHOTS_SCHEMA, TOPICS_SCHEMA)
from logkeep.sinks import commits


#: First letters of the names of streams that compactions write.
COMPACTED = "compact-"


def data_path(root):
    return f"{root}/data"


def backup_path(root, backup_id):
    return f"{data_path(root)}/backup_id={backup_id}"


def snapshots_path(root):
    return f"{root}/catalog/snapshots"


def snapshot_of(spark, root, backup_id):
    """Newest snapshot record of a backup as a dict, None if it has none; one small file."""
    return commits.newest(spark, f"{snapshots_path(root)}/backup_id={backup_id}")[1]


def of_streams(rows, streams):
    """Without batches that a snapshot's streams do not hold: later ones, and compacted ones."""
    for s in streams:
        if s["last_batch"] is not None:
            rows = rows.where(~((F.col("stream") == s["stream"]) & (F.col("batch") > s["last_batch"])))
        if s.get("after") is not None:
            rows = rows.where(~((F.col("stream") == s["stream"]) & (F.col("batch") <= s["after"])))
    return rows


def holds_rows(stream):
    """Whether a stream of a snapshot record still has batches of its own."""
    after = stream.get("after")
    return after is None or stream["last_batch"] > after


def read_snapshots(spark, root):
    """Newest snapshot record of each backup."""
    records = read_below(spark, SNAPSHOTS_SCHEMA, snapshots_path(root), "json")
    kept = [f.name for f in records.schema if f.name not in ("backup_id", "number")]
    newest = F.max_by(F.struct(*kept), "number").alias("_s")
    return records.groupBy("backup_id").agg(newest).select("backup_id", "_s.*")


def read_below(spark, schema, path, form="parquet", **options):
    """Rows below ``path``; none if it is missing."""
    try:
        return spark.read.schema(schema).options(**options).format(form).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_archive(spark, root, backup_id=None, deduplicate=False):
    """Archived rows; stream, batch, topic and partition are folders and prune.

    Rows are those that the newest snapshot names: its streams, each up to the batch it had
    then. A backup that never had a snapshot gives all its rows. With a ``backup_id`` only that
    backup's folders are listed. ``deduplicate`` drops copies that a stream left when it read a
    range again (one backup only). Only segments whose pieces overlap are looked at, and of
    these offsets alone decide; without overlap nothing is shuffled.
    """
    if backup_id is None:
        if deduplicate:
            raise ValueError("name the backup whose copies are to be dropped")
        return _all_current(spark, root)
    record = snapshot_of(spark, root, backup_id)
    if record is None:
        home = backup_path(root, backup_id)
        rows = spark.read.schema(ARCHIVE_SCHEMA).option("basePath", data_path(root)).parquet(home)
    else:
        rows = rows_of_streams(spark, root, backup_id, record["streams"])
    streamed = record is None or any(s["last_batch"] is not None for s in record["streams"])
    if not deduplicate or not streamed:
        return rows
    twice = overlaps(read_pieces(spark, root, backup_id))
    if not twice.take(1):
        return rows
    return once(rows, twice)


def rows_of_streams(spark, root, backup_id, streams):
    """Rows of the batches of a backup that a list of streams names."""
    folders = [f"{backup_path(root, backup_id)}/stream={s['stream']}" for s in streams if holds_rows(s)]
    if not folders:
        return spark.createDataFrame([], ARCHIVE_SCHEMA)
    rows = spark.read.schema(ARCHIVE_SCHEMA).option("basePath", data_path(root)).parquet(*folders)
    return of_streams(rows, streams)


def _all_current(spark, root):
    rows = spark.read.schema(ARCHIVE_SCHEMA).option("basePath", data_path(root)).parquet(data_path(root))
    known = read_snapshots(spark, root)
    if known.isEmpty():
        return rows
    named = known.select("backup_id", F.explode_outer("streams").alias("_s")).select(
        "backup_id", F.col("_s.stream").alias("_stream"), F.col("_s.last_batch").alias("_last"),
        F.coalesce("_s.after", F.lit(-1)).alias("_after"))
    # one small row for each stream of a backup
    found = rows.join(named, (rows["backup_id"] == named["backup_id"]), "left").where(
        named["backup_id"].isNull() | (
            (F.col("stream") == F.col("_stream")) & (F.col("batch") > F.col("_after"))
            & (F.col("_last").isNull() | (F.col("batch") <= F.col("_last")))))
    return found.select(*[rows[c] for c in rows.columns])


def once(rows, twice):
    place = ["topic", "partition", "segment"]
    tagged = join_small(rows, twice.withColumn("_twice", F.lit(True)), place, "offset", how="left")
    alone, copied = tagged.where("_twice is null"), tagged.where("_twice")
    first = copied.groupBy(*place, "offset").agg(F.min(F.struct("stream", "batch")).alias("_first"))
    kept = copied.join(first.select(*place, "offset", "_first.*"), [*place, "offset", "stream", "batch"])
    # a range may even be in one batch twice: such copies are equal
    kept = kept.select(*alone.columns).dropDuplicates([*place, "offset"])
    return alone.unionByName(kept).drop("_twice")


def read_pieces(spark, root, backup_id):
    """What each micro-batch added to each segment; empty for backups that were not streamed.

    Batches that were compacted have their pieces in the stream that replaced them; pieces of a
    compaction that no snapshot names do not count.
    """
    path = f"{root}/catalog/pieces"
    pieces = read_below(spark, PIECES_SCHEMA, f"{path}/backup_id={backup_id}", basePath=path)
    streams = (snapshot_of(spark, root, backup_id) or {"streams": []})["streams"]
    replaced = [{**s, "last_batch": None} for s in streams if s.get("after") is not None]
    named = [s["stream"] for s in streams]
    foreign = F.col("stream").startswith(COMPACTED) & ~F.col("stream").isin(named)
    return of_streams(pieces, replaced).where(~foreign)


def overlaps(pieces):
    """Segments with offsets that two pieces share, or that one piece holds twice."""
    place = ["topic", "partition", "segment"]
    earlier = Window.partitionBy(*place).orderBy("start_offset", "end_offset").rowsBetween(
        Window.unboundedPreceding, -1)
    reached = F.max("end_offset").over(earlier)
    found = pieces.withColumn("_reached", reached).where(
        (F.col("_reached") >= F.col("start_offset")) | (F.col("offsets") < F.col("message_count")))
    return found.select(*place).distinct()


def current_table(spark, root, name, schema, backup_id=None):
    """Rows of a catalog table that belong to the newest snapshots, of one backup or all.

    A backup's rows of older or unfinished snapshots are not seen.
    """
    path = f"{root}/catalog/{name}"
    columns = T.StructType.fromDDL(schema).fieldNames()
    kept = schema if "backup_id" in columns else f"backup_id string, {schema}"
    kept = f"{kept}, snapshot string"
    if backup_id is not None:
        record = snapshot_of(spark, root, backup_id)
        if record is None:
            return spark.createDataFrame([], kept).drop("snapshot")
        home = f"{path}/backup_id={backup_id}/snapshot={record['snapshot']}"
        return read_below(spark, kept, home, basePath=path).drop("snapshot")
    current = read_snapshots(spark, root).select("backup_id", "snapshot")
    return read_below(spark, kept, path).join(current, ["backup_id", "snapshot"], "left_semi").drop("snapshot")


def read_segments(spark, root, backup_id=None):
    return current_table(spark, root, "segments", SEGMENTS_SCHEMA, backup_id)


def read_topics(spark, root, backup_id=None):
    return current_table(spark, root, "topics", "backup_id string, " + TOPICS_SCHEMA, backup_id)


def read_backups(spark, root):
    """Catalog entry of each backup, as its newest snapshot has it."""
    return read_snapshots(spark, root).select(*T.StructType.fromDDL(BACKUPS_SCHEMA).fieldNames())
