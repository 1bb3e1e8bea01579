"""Expressions over one message: size, hashes and the JSON form."""

from pyspark.sql import functions as F


def message_size():
    """Payload bytes: key, value and headers.

    Without lambdas, so that the scan's stage stays in generated code.
    """
    names = F.array_join(F.col("headers")["key"], "")
    values = F.array_join(F.col("headers")["value"].cast("array<string>"), "")
    parts = [F.octet_length(x) for x in (F.col("key"), F.col("value"), names, values)]
    zero = F.lit(0)
    total = F.coalesce(parts[0], zero).cast("bigint")
    for part in parts[1:]:
        total = total + F.coalesce(part, zero)
    return total


def _framed(column):
    """``length:hex`` of a binary or string column, ``-`` for null."""
    return F.coalesce(
        F.concat(F.octet_length(column).cast("string"), F.lit(":"), F.hex(column)),
        F.lit("-"),
    )


def message_text():
    """Unambiguous text of key, value, timestamp and headers."""
    return F.concat_ws(
        "|",
        _framed(F.col("key")),
        _framed(F.col("value")),
        F.coalesce(F.unix_micros("timestamp").cast("string"), F.lit("-")),
        F.coalesce(F.to_json("headers"), F.lit("-")),
    )


def fingerprint():
    """Identity of a message content, for multiset comparison."""
    # Never null, so that no join or filter evaluates it a second time.
    return F.coalesce(F.unhex(F.sha2(message_text(), 256)), F.lit(b""))


def measured(rows, *more):
    """Place and payload size of each message.

    Taken before segmenting, so that keys and values are not shuffled for totals.
    """
    return rows.select("topic", "partition", "offset", message_size().alias("size_bytes"), *more)


def row_hash(topic="topic"):
    """64-bit hash of one archived row; xor-ed into segment checksums.

    Null keys and values are replaced by a marker, since the hash skips nulls.
    """
    return F.xxhash64(
        topic,
        "partition",
        "offset",
        F.coalesce("key", F.lit(b"\x00null")),
        F.coalesce("value", F.lit(b"\x00null")),
        F.unix_micros("timestamp"),
        F.coalesce(F.array_size("headers"), F.lit(-1)),
        "headers",
    )


def message_json():
    """JSON object of one message; null and empty bytes stay apart."""
    headers = F.col("headers").cast("array<struct<Key:string,Value:binary>>")
    return F.to_json(
        F.struct(
            F.col("offset").alias("Offset"),
            F.col("partition").alias("Partition"),
            F.col("key").alias("Key"),
            F.col("value").alias("Value"),
            F.col("timestamp").alias("Timestamp"),
            headers.alias("Headers"),
        ),
        {
            "ignoreNullFields": "false",
            "timeZone": "UTC",
            "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        },
    )
