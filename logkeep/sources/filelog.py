"""Topic logs kept in files with the columns of the Kafka source."""

from logkeep.schemas import LOG_COLUMNS, LOG_SCHEMA


def read_log(spark, path):
    """Bounded scan of all files at or below ``path``."""
    rows = spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true")
    return rows.parquet(path).select(*LOG_COLUMNS)


def stream_log(spark, path, max_files_per_trigger=None):
    """Continuous scan; new files are new messages."""
    reader = spark.readStream.schema(LOG_SCHEMA).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).select(*LOG_COLUMNS)


def between_offsets(log, low=None, high=None):
    """Rows of ``[low, high)``; the bounds reach the Parquet scan."""
    if low is not None:
        log = log.where(log["offset"] >= low)
    if high is not None:
        log = log.where(log["offset"] < high)
    return log
