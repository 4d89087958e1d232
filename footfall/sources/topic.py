"""The message topic: Kafka, or Parquet files with the columns a Kafka source has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.fixed import TOPIC_PARTITIONS
from footfall.functions.schema import HEADERS, MESSAGE

# A worker of the service takes 2000 messages at a time, and there are 20 workers.
ROWS_PER_TRIGGER = 2000 * 20


def stream_kafka(spark: SparkSession, servers: str, topic: str, rows_per_trigger: int = ROWS_PER_TRIGGER) -> DataFrame:
    """The topic as a stream. Offsets live in the checkpoint of the query that reads it.

    Needs the Kafka connector on the class path.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("includeHeaders", "true")
        .option("maxOffsetsPerTrigger", rows_per_trigger)
        .load()
        .select(*MESSAGE.fieldNames())
    )


def publish_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Hand messages to the topic. Kafka places them by key, so a user's messages keep their order.

    Needs the Kafka connector on the class path.
    """
    rows = messages.select("key", "value", F.lit(topic).alias("topic"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def stream_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def as_topic(messages: DataFrame, topic: str, order: str, partitions: int = TOPIC_PARTITIONS) -> DataFrame:
    """Messages with the place a topic would give them: partition by key, order by ``order`` within a user.

    Rows are spread by ranges of (partition, key, order), so a user with most of the rows takes several tasks
    and still lies in order.
    """
    placed = messages.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    lying = ["partition", "key", order]
    return (
        placed.repartitionByRange(*lying)
        .sortWithinPartitions(*lying)
        .select(
            "key",
            "value",
            F.lit(None).cast(HEADERS).alias("headers"),
            F.lit(topic).alias("topic"),
            "partition",
            F.monotonically_increasing_id().alias("offset"),
        )
    )


def publish_files(messages: DataFrame, folder: str, topic: str, order: str) -> None:
    """Append messages to a folder that ``stream_files`` reads; no rows, no new files with rows."""
    as_topic(messages, topic, order).write.mode("append").parquet(folder)
