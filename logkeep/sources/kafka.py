"""Options of Spark's Kafka connector for reading and writing topic logs.

The connector jar is supplied by the cluster (``spark-sql-kafka-0-10``).
"""

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from logkeep.functions.patterns import glob_regex, java_regex
from logkeep.schemas import LOG_COLUMNS, NO_SELECTOR


@dataclass(frozen=True)
class Cluster:
    bootstrap_servers: str
    security_protocol: str = "PLAINTEXT"
    sasl_mechanism: str | None = None
    sasl_jaas_config: str | None = None
    properties: dict = field(default_factory=dict)

    def options(self):
        found = {"kafka.bootstrap.servers": self.bootstrap_servers}
        if self.security_protocol != "PLAINTEXT":
            found["kafka.security.protocol"] = self.security_protocol
        if self.sasl_mechanism:
            found["kafka.sasl.mechanism"] = self.sasl_mechanism
        if self.sasl_jaas_config:
            found["kafka.sasl.jaas.config"] = self.sasl_jaas_config
        found.update({f"kafka.{k}": v for k, v in self.properties.items()})
        return found


def topic_options(topics=None, pattern=None, assign=None):
    """Exactly one way of naming what to read."""
    given = [x for x in (topics, pattern, assign) if x]
    if len(given) != 1:
        raise ValueError("name topics, a pattern or an assignment")
    if topics:
        return {"subscribe": ",".join(topics)}
    if pattern:
        return {"subscribePattern": pattern}
    return {"assign": json.dumps(assign)}


def selector_options(selectors):
    """Subscription of a selector list, so that brokers send chosen topics only.

    Exact names and globs without wildcard are subscribed by name; any other selector turns
    the list into one pattern over whole names.
    """
    if not selectors:
        raise ValueError(NO_SELECTOR)
    if all(s.type == "exact" or s.type == "glob" and not re.search(r"[*?\[]", s.pattern) for s in selectors):
        return topic_options(topics=[s.pattern for s in selectors])
    return topic_options(pattern="|".join(f"(?:{_whole_name(s)})" for s in selectors))


def _whole_name(selector):
    if selector.type == "exact":
        return re.sub(r"([^0-9A-Za-z_])", r"\\\1", selector.pattern)
    if selector.type == "glob":
        return glob_regex(selector.pattern)
    return f"(?s:.*)(?:{java_regex(selector.pattern)})(?s:.*)"


def offsets_json(offsets):
    """Starting or ending offsets from ``{topic: {partition: offset}}``."""
    return json.dumps({t: {str(p): o for p, o in parts.items()} for t, parts in offsets.items()})


def batch_options(cluster, topics=None, pattern=None, assign=None, starting="earliest",
                  ending="latest", min_partitions=None, max_records_per_partition=None):
    """Bounded scan: the end is the snapshot of latest offsets at the start.

    ``max_records_per_partition`` cuts one large topic-partition into many tasks.
    """
    options = {
        **cluster.options(),
        **topic_options(topics, pattern, assign),
        "startingOffsets": starting if isinstance(starting, str) else offsets_json(starting),
        "endingOffsets": ending if isinstance(ending, str) else offsets_json(ending),
        "includeHeaders": "true",
        "failOnDataLoss": "true",
    }
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    if max_records_per_partition:
        options["maxRecordsPerPartition"] = str(max_records_per_partition)
    return options


def stream_options(cluster, topics=None, pattern=None, assign=None, starting="earliest",
                   max_offsets_per_trigger=None, group_id_prefix="logkeep"):
    options = {
        **cluster.options(),
        **topic_options(topics, pattern, assign),
        "startingOffsets": starting if isinstance(starting, str) else offsets_json(starting),
        "includeHeaders": "true",
        "failOnDataLoss": "true",
        "groupIdPrefix": group_id_prefix,
    }
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_topics(spark, **kwargs):
    return to_log(spark.read.format("kafka").options(**batch_options(**kwargs)).load())


def stream_topics(spark, **kwargs):
    return to_log(spark.readStream.format("kafka").options(**stream_options(**kwargs)).load())


def to_log(rows):
    """Connector columns to the log columns; header order is kept."""
    return rows.select(*LOG_COLUMNS)


def producer_options(cluster, retries=5):
    """All replicas acknowledge, idempotent, bounded retries."""
    return {
        **cluster.options(),
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
        "kafka.retries": str(retries),
    }


def to_records(rows, provenance=True):
    """Restored rows as records for the Kafka sink.

    The sink cannot set timestamps, so the original time, partition and offset go
    into headers.
    """
    headers = F.coalesce(
        F.col("headers"), F.array().cast("array<struct<key:string,value:binary>>")
    )
    if provenance:

        def text(name, value):
            return F.struct(F.lit(name).alias("key"), F.encode(value, "UTF-8").alias("value"))

        headers = F.concat(
            headers,
            F.array(
                text("original-timestamp-micros", F.unix_micros("timestamp").cast("string")),
                text("original-partition", F.col("partition").cast("string")),
                text("original-offset", F.col("offset").cast("string")),
            ),
        )
    return rows.select(
        F.col("target_topic").alias("topic"), "partition", "key", "value", headers.alias("headers")
    )


def write_topics(rows, cluster, provenance=True):
    """Replay rows to Kafka, in offset order inside each partition.

    Order holds inside one task only, so each target partition is one task; pass
    bounded offset ranges one after another (see ``plans.restore``).
    """
    laid_out = rows.repartition("target_topic", "partition").sortWithinPartitions(
        "target_topic", "partition", "topic", "segment", "offset"
    )
    (
        to_records(laid_out, provenance)
        .write.format("kafka")
        .options(**producer_options(cluster))
        .save()
    )
