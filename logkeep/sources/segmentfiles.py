"""Segment objects holding one JSON array of messages each.

Objects that a manifest names are read by key: the keys are dealt to tasks, which open them
there, so nothing is listed and the driver holds no file. An object is read in pieces, whatever
its size. Objects that no manifest names yet are found by listing a folder (``scan``).
"""

import codecs
import datetime as dt
import gzip
import hashlib
import io
import json
import time
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logkeep.functions.paths import parse_key
from logkeep.operators.joins import join_small
from logkeep.schemas import MESSAGE_JSON_SCHEMA
from logkeep.session import stored
from logkeep.sinks.segmentfiles import address_of, attempt_id, filesystem_of

SCANNED = (
    "path string, backup_id string, topic string, partition int, segment bigint, compressed boolean, "
    "broken boolean, offset bigint, key binary, value binary, timestamp timestamp, "
    "headers array<struct<key:string,value:binary>>"
)


def _objects(spark, paths, mode):
    """Messages as Spark's reader gives them, with path; which damaged ones depends on ``mode``."""
    rows = (
        spark.read.schema(MESSAGE_JSON_SCHEMA)
        .option("multiLine", "true")
        .option("mode", mode)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "segment-*.json*")
        .json(paths)
    )
    return rows.withColumn("path", F.col("_metadata.file_path")).where(parse_key(F.col("path")).isNotNull())


def scan(spark, paths):
    """Messages of all good objects below ``paths``, and one marked row for each broken object.

    One damaged message condemns its whole object. ``paths`` may be one root or topic folders;
    reading only the wanted topic folders keeps the listing small. No folders give no rows.

    A reader that keeps the text of broken records opens an object anew for each message in it.
    So damaged objects are dropped whole, and found as those that are not empty and yet give no
    message; these, and those with a message without offset, are looked for at once.
    """
    if not paths:
        return spark.createDataFrame([], SCANNED)
    whole = _objects(spark, paths, "DROPMALFORMED")
    # The reader checks only the fields a query needs. This needs all of them and is never true.
    all_read = F.size(F.array(*[F.col(f.name).isNull() for f in MESSAGE_JSON_SCHEMA.fields])) < 0
    whole = whole.withColumn("unplaced", F.col("Offset").isNull() | all_read)
    read = whole.groupBy("path").agg(F.max("unplaced").alias("unplaced"))
    seen = _objects(spark, paths, "PERMISSIVE").select("path", F.isnull("Offset").alias("_")).groupBy("path").agg(
        F.max("_").alias("_"))
    found = stored(seen.join(read, "path", "left").where("unplaced is null or unplaced").select("path", "unplaced"),
                   "broken-objects")
    good = join_small(whole, found.where("unplaced").select("path"), ["path"], spread="Offset", how="left_anti").where(
        ~F.col("unplaced"))
    headers = F.col("Headers").cast("array<struct<key:string,value:binary>>")
    rows = good.select(
        "path", F.lit(False).alias("broken"), F.col("Offset").alias("offset"), F.col("Key").alias("key"),
        F.col("Value").alias("value"), F.col("Timestamp").alias("timestamp"), headers.alias("headers"))
    marked = rows.unionByName(found.select("path", F.lit(True).alias("broken")), allowMissingColumns=True)
    return marked.withColumn("_key", parse_key(F.col("path"))).select(
        "path", "_key.*", "broken", "offset", "key", "value", "timestamp", "headers")


def messages(scanned):
    """Rows of good objects."""
    return scanned.where("NOT broken").drop("broken", "path", "compressed")


def quarantine(scanned):
    """Objects that could not be read, one row each."""
    return scanned.where("broken").select(
        "path", "backup_id", "topic", "partition", "segment",
        F.lit("unreadable segment").alias("error"),
    )


def topic_folders(root, backup_id, topics):
    return [f"{root}/backups/{backup_id}/topics/{t}" for t in topics]


#: Compressed bytes for one task, characters of JSON decoded at once, and objects kept open in memory.
TASK_BYTES, PIECE, HELD_BYTES = 4 << 20, 1 << 20, 8 << 20
#: Messages, and characters of their JSON, of one batch that a task gives back.
BATCH_ROWS, BATCH_CHARS = 4096, 8 << 20

_OPENED = pa.schema([
    ("storage_key", pa.string()), ("backup_id", pa.string()), ("topic", pa.string()),
    ("partition", pa.int32()), ("segment", pa.int64()), ("json", pa.string()), ("error", pa.string()),
    ("messages", pa.int64()), ("bytes", pa.int64()), ("duration_ms", pa.int64()),
    ("attempt", pa.int64()), ("finished_at", pa.timestamp("us", tz="UTC"))])
_OPENED_DDL = (
    "storage_key string, backup_id string, topic string, partition int, segment bigint, json string, "
    "error string, messages bigint, bytes bigint, duration_ms bigint, attempt bigint, finished_at timestamp")


def open_named(manifest, root, storage=None):
    """Stored rows of the objects that ``manifest`` names: their messages, and one row each.

    An object's own row has its facts and no ``json``; if it could not be read it has an
    ``error`` and the object no messages. An object with a checksum must have it; one without,
    written by another tool, must be a JSON array of objects. Every object is checked before its
    first message is given.
    """
    address, options = address_of(root), storage.arrow_options() if storage else {}
    keys = manifest.select(
        "storage_key", "backup_id", "topic", "partition", "segment", "size_bytes", "checksum", "message_count")
    size = keys.agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(1, min(size["n"], -(-(size["bytes"] or 0) // TASK_BYTES)))

    def read(batches):
        filesystem, base = filesystem_of(address, options)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _messages_of(filesystem, base, row)

    opened = keys.repartition(tasks, "storage_key").mapInArrow(read, _OPENED_DDL)
    # Types are checked as the reader of whole files does, without a second copy of its rules.
    kind = T.StructType([*MESSAGE_JSON_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json("json", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    facts = [c for c in _OPENED.names if c != "json"]
    is_message = F.col("json").isNotNull()
    return stored(opened.withColumn("_m", parsed).select(
        *facts, is_message.alias("is_message"),
        (is_message & (F.col("_m._broken").isNotNull() | F.col("_m.Offset").isNull())).alias("broken"),
        F.col("_m.Offset").alias("offset"), F.col("_m.Key").alias("key"), F.col("_m.Value").alias("value"),
        F.col("_m.Timestamp").alias("timestamp"),
        F.col("_m.Headers").cast("array<struct<key:string,value:binary>>").alias("headers")), "objects")


def named_messages(opened):
    """Messages of good objects; one damaged message condemns its whole object."""
    rows = opened.where("is_message")
    bad = opened.where("broken").select("storage_key").distinct()
    if not bad.isEmpty():
        rows = join_small(rows, bad, ["storage_key"], spread="offset", how="left_anti")
    return rows.select("backup_id", "topic", "partition", "segment", "offset", "key", "value", "timestamp", "headers")


def named_facts(opened):
    """Facts of each object: messages, bytes, time, and what is wrong with it."""
    bad = opened.where("broken").select("storage_key").distinct().withColumn("_damaged", F.lit("damaged message"))
    return opened.where("NOT is_message").join(bad, "storage_key", "left").withColumn(
        "error", F.coalesce("error", "_damaged")).drop("_damaged", "is_message", "broken")


def named_quarantine(opened):
    """Objects that could not be read, one row each."""
    return named_facts(opened).where(F.col("error").isNotNull()).select(
        F.col("storage_key").alias("path"), "backup_id", "topic", "partition", "segment",
        F.lit("unreadable segment").alias("error"))


class _Broken(Exception):
    """What makes an object unreadable."""


def json_objects(source, compressed, piece=PIECE):
    """JSON text of each object of the array in a byte stream, decoded piece by piece."""
    stream = gzip.GzipFile(fileobj=source) if compressed else source
    decode, scan = codecs.getincrementaldecoder("utf-8")().decode, json.JSONDecoder().raw_decode
    text, at, ended = "", 0, False

    def more(wanted):
        nonlocal text, at, ended
        data = stream.read(wanted)
        ended = not data
        text, at = text[at:] + decode(data, ended), 0

    def next_mark():
        nonlocal at
        while True:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            if at < len(text):
                return text[at]
            if ended:
                raise _Broken("the array is cut")
            more(piece)

    if next_mark() != "[":
        raise _Broken("no array")
    at += 1
    if next_mark() == "]":
        at += 1
    else:
        while True:
            if next_mark() != "{":
                raise _Broken("an element is no object")
            wanted = piece
            while True:
                try:
                    _, end = scan(text, at)
                    break
                except json.JSONDecodeError as error:
                    if ended:
                        raise _Broken(str(error)) from None
                    more(wanted)
                    wanted *= 2
            yield text[at:end]
            at = end
            mark = next_mark()
            at += 1
            if mark == "]":
                break
            if mark != ",":
                raise _Broken("no comma between elements")
    while not ended:
        if text[at:].strip(" \t\r\n"):
            raise _Broken("text after the array")
        text, at = "", 0
        more(piece)
    if text[at:].strip(" \t\r\n"):
        raise _Broken("text after the array")


def _check(source, row, compressed):
    """Raise unless the object is what the manifest says, or at least whole; gives its size."""
    size, digest = 0, hashlib.sha256()
    if row["checksum"] is None:
        for _ in json_objects(source, compressed):
            pass
        return row["size_bytes"]
    while data := source.read(PIECE):
        digest.update(data)
        size += len(data)
    if digest.hexdigest() != row["checksum"]:
        raise _Broken("checksum differs")
    return size


def _messages_of(filesystem, base, row):
    started, path = time.monotonic(), f"{base}/{row['storage_key']}"
    compressed, error, size, count = path.endswith(".gz"), None, 0, 0
    try:
        if row["size_bytes"] <= HELD_BYTES:
            with filesystem.open_input_stream(path, compression=None) as source:
                data = source.read()
            openers = [lambda: io.BytesIO(data)] * 2
        else:
            openers = [lambda: filesystem.open_input_stream(path, compression=None)] * 2
        with openers[0]() as source:
            size = _check(source, row, compressed)
        texts, chars = [], 0
        with openers[1]() as source:
            for text in json_objects(source, compressed):
                texts.append(text)
                chars += len(text)
                if len(texts) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    count += len(texts)
                    yield _opened(row, texts)
                    texts, chars = [], 0
        if texts:
            count += len(texts)
            yield _opened(row, texts)
    except FileNotFoundError:
        error = "missing object"
    except (_Broken, EOFError, UnicodeDecodeError, gzip.BadGzipFile, zlib.error) as found:
        error = str(found) or type(found).__name__
    facts = {"error": error, "messages": count, "bytes": size,
             "duration_ms": round(1000 * (time.monotonic() - started)), "attempt": attempt_id(),
             "finished_at": dt.datetime.now(dt.timezone.utc)}
    yield _opened(row, [None], facts)


def _opened(row, texts, facts=None):
    columns = {"json": texts, **{k: [v] for k, v in (facts or {}).items()}}
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(f.name, [row.get(f.name)] * n if f.name in row else [None] * n), f.type)
         for f in _OPENED], schema=_OPENED)
