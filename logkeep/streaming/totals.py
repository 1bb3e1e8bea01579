"""Running totals of a streamed log."""

from pyspark.sql import functions as F

from logkeep.functions.messages import message_size


def start_totals(stream, path, checkpoint, interval_seconds=None):
    """Messages, bytes and last message time per topic, updated as rows arrive.

    Each micro-batch writes the totals it changed into its own folder.
    """
    totals = stream.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(message_size()).alias("bytes"),
        F.max("timestamp").alias("last_message"),
    )

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = (
        totals.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    if interval_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval_seconds} seconds").start()


def latest_totals(spark, path):
    """Newest totals of each topic."""
    rows = spark.read.parquet(path)
    newest = F.max_by(F.struct("messages", "bytes", "last_message"), "batch").alias("_t")
    return rows.groupBy("topic").agg(newest).select("topic", "_t.*")
