"""Storage keys of segment objects and their inverse."""

from pyspark.sql import functions as F

# Fixed format of keys of segment objects.
KEY_PATTERN = (
    r"(?:^|/)backups/([^/]+)/topics/([^/]+)/partition-(\d+)/segment-(\d+)\.json(\.gz)?$"
)


def storage_key(backup_id, topic, partition, segment, prefix="", compressed=True):
    """``prefix/backups/<id>/topics/<topic>/partition-<p>/segment-<n>.json[.gz]``.

    Segment numbers are padded to six digits and never cut.
    """
    number = segment.cast("string")
    padded = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    pieces = [F.lit(prefix.strip("/"))] if prefix.strip("/") else []
    pieces += [
        F.lit("backups"),
        backup_id,
        F.lit("topics"),
        topic,
        F.concat(F.lit("partition-"), partition.cast("string")),
        F.concat(F.lit("segment-"), padded, F.lit(".json.gz" if compressed else ".json")),
    ]
    return F.concat_ws("/", *pieces)


def topic_metadata_key(backup_id, topic, prefix=""):
    pieces = [F.lit(prefix.strip("/"))] if prefix.strip("/") else []
    return F.concat_ws(
        "/",
        *pieces,
        F.lit("backups"),
        backup_id,
        F.lit("metadata/topics"),
        F.concat(topic, F.lit(".json")),
    )


def parse_key(path):
    """Exact parts of a key or path as a struct; null if it is no segment."""

    def part(i):
        return F.regexp_extract(path, KEY_PATTERN, i)

    return F.when(
        path.rlike(KEY_PATTERN),
        F.struct(
            part(1).alias("backup_id"),
            part(2).alias("topic"),
            part(3).try_cast("int").alias("partition"),
            part(4).try_cast("bigint").alias("segment"),
            (part(5) == ".gz").alias("compressed"),
        ),
    )
