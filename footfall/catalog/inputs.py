"""Inputs of the registered queries, derived row by row from the given tables.

Every input uses its whole table. Faults are put in by the remainder of the row's number, so that SQL can say
which rows they hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.fixed import CHANNELS, GROUPINGS
from footfall.functions.schema import HEADERS
from footfall.operators.commands import to_events, to_rows
from footfall.operators.failures import header
from footfall.operators.messages import to_messages
from footfall.session import prepare, spread
from footfall.sources import raw_events as raw

# The fixed question of the metric queries; both ends lie inside an hour.
ASK_NAME = "purchase"
ASK_FROM = 1704090600  # 2024-01-01 06:30:00
ASK_TO = 1706465700  # 2024-01-28 18:15:00


def hits(number: int, column: str = "src") -> Column:
    return F.col(column) % number == 0


def table(spark: SparkSession, folder: str) -> DataFrame:
    return raw.read_raw(prepare(spark), folder)


def commands(spark: SparkSession, folder: str) -> DataFrame:
    return raw.as_commands(table(spark, folder))


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_commands(spark: SparkSession, folder: str) -> DataFrame:
    """The same for queries that write or read JSON for every row."""
    return raw.as_commands(spread(table(spark, folder), _tasks(spark)))


def rows_of(raw_rows: DataFrame) -> DataFrame:
    """Stored event rows; each is ingested at its own second."""
    seconds = F.timestamp_seconds("timestamp")
    return to_rows(to_events(raw.as_commands(raw_rows), seconds))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(table(spark, folder))


def spread_events(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of(spread(table(spark, folder), _tasks(spark)))


def sent_again(spark: SparkSession, folder: str) -> DataFrame:
    """All events, and every tenth once more an hour later with other metadata."""
    copies = F.when(hits(10), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = events(spark, folder).withColumn("copy", F.explode(copies))
    later = F.timestamp_seconds(F.unix_seconds("created_at") + 3600 * F.col("copy"))
    other = F.when(F.col("copy") == 1, F.lit('{"price":1}')).otherwise(F.col("metadata"))
    return twice.withColumns({"created_at": later, "metadata": other})


def faulty_commands(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """Commands with faults, many rows with several; and "now", the newest second of the table."""
    now = raw.newest_second(table(spark, folder))
    ok = spread_commands(spark, folder)
    name = (
        F.when(hits(7), F.lit(""))
        .when(hits(11), F.repeat(F.lit("n"), 101))
        .when(hits(19), F.repeat(F.lit("€"), F.lit(34)))
        .otherwise(F.col("event_name"))
    )
    user = F.when(hits(13), F.repeat(F.lit("u"), 101)).when(hits(17), F.lit("")).otherwise(F.col("user_id"))
    at = (
        F.when(hits(23), F.lit(0))
        .when(hits(29), now + 3600)
        .when(hits(31), now - 31 * 86400)
        .when(hits(37), now - 30 * 86400)
        .otherwise(F.col("timestamp"))
    )
    channel = F.when(hits(41), F.lit("tv")).when(hits(43), F.lit("")).otherwise(F.col("channel"))
    tags = (
        F.when(hits(47), F.array_repeat(F.lit("t"), 21))
        .when(hits(53), F.array_repeat(F.lit("t"), 20))
        .when(hits(59), F.array(F.lit("t"), F.repeat(F.lit("t"), 101), F.repeat(F.lit("t"), 102)))
        .otherwise(F.col("tags"))
    )
    faulty = ok.withColumns(
        {"event_name": name, "user_id": user, "timestamp": at.cast("bigint"), "channel": channel, "tags": tags}
    )
    return to_events(faulty, F.timestamp_seconds(now)), now


def bulk_bodies(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """One bulk request per row: 0 to 3 events, now and then 1000 or 1001, some bodies that cannot be read."""
    now = raw.newest_second(table(spark, folder))
    src = F.col("src")
    size = F.when(src % 997 == 1, 1001).when(src % 997 == 2, 1000).otherwise(src % 4).cast("int")

    def item(i: Column) -> Column:
        return F.struct(
            F.when((src + i) % 5 == 0, F.lit("")).otherwise(F.col("event_name")).alias("event_name"),
            F.when((src + i) % 11 == 0, F.lit("tv")).otherwise(F.col("channel")).alias("channel"),
            F.col("campaign_id"),
            F.col("user_id"),
            (F.col("timestamp") + i).alias("timestamp"),
            F.col("tags"),
        )

    places = F.filter(F.sequence(F.lit(0), size), lambda i: i < size)
    body = (
        F.when(hits(53), F.lit('{"events": [{"event_name": "x"}'))
        .when(hits(59), F.lit('{"events": [{"event_name": "x"}, 5]}'))
        .when(hits(61), F.lit("null"))
        .when(hits(67), F.lit('{"events": {"event_name": "x"}}'))
        .otherwise(F.to_json(F.struct(F.transform(places, item).alias("events"))))
    )
    return spread_commands(spark, folder).select(src.cast("string").alias("request_id"), body.alias("body")), now


def single_bodies(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """One single-event request per row, some of which cannot be read or are not valid."""
    now = raw.newest_second(table(spark, folder))
    fields = ["event_name", "channel", "campaign_id", "user_id", "timestamp", "tags"]
    odd_name = F.struct(F.col("event_name").alias("Event_Name"), *fields[1:])
    body = (
        F.when(hits(53), F.lit("{bad"))
        .when(hits(59), F.lit('{"event_name":"x","timestamp":"5"}'))
        .when(hits(61), F.lit('{"event_name":5}'))
        .when(hits(67), F.lit("null"))
        .when(hits(71), F.to_json(odd_name))
        .otherwise(F.to_json(F.struct(*fields)))
    )
    return spread_commands(spark, folder).select(F.col("src").cast("string").alias("request_id"), body.alias("body")), now


def placed(rows: DataFrame) -> DataFrame:
    """A place on the topic for each message."""
    return rows.withColumns(
        {
            "headers": F.lit(None).cast(HEADERS),
            "topic": F.lit("events"),
            "partition": (F.col("src") % 20).cast("int"),
            "offset": F.col("src"),
        }
    )


def damaged(messages: DataFrame) -> DataFrame:
    """Messages of which some cannot be read; three kinds look odd but are readable."""
    value = (
        F.when(hits(53), F.lit("{bad"))
        .when(hits(59), F.lit('{"timestamp":"5"}'))
        .when(hits(61), F.lit('{"event_name":5}'))
        .when(hits(67), F.lit('{"tags":["a",1]}'))
        .when(hits(71), F.lit('{"metadata":[1]}'))
        .when(hits(73), F.lit('{"created_at":"yesterday"}'))
        .when(hits(79), F.lit("[1]"))
        .when(hits(83), F.lit('{"timestamp":1.5}'))
        .when(hits(89), F.lit("null"))
        .when(hits(97), F.lit('{"channel":"web","more":{"a":[1]},"tags":null}'))
        .when(hits(101), F.lit('{"CHANNEL":"api","timestamp":7,"timestamp":8}'))
    )
    return messages.withColumn("value", F.coalesce(value.cast("binary"), F.col("value")))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return damaged(placed(to_messages(spread_events(spark, folder))))


def retry_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as they lie in the retry topic, with all kinds of retry counts."""
    counts = ["invalid", "", "0", "-1", "100", " 3", "4", "5"]
    given = F.element_at(F.array(*[F.lit(c) for c in counts]), F.greatest(F.col("src") % 9, F.lit(1)).cast("int"))
    rest = [
        header("error_type", "insert_failed"),
        header("error_message", "no room"),
        header("original_topic", "events"),
        header("original_offset", F.col("src")),
        header("failed_at", "2024-01-01T00:00:00Z"),
        header("last_retry_at", "2024-01-01T00:01:00Z"),
    ]
    none, some = F.array(*rest), F.array(*rest[:1], header("retry_count", given), *rest[1:])
    headers = F.when(F.col("src") % 9 == 0, none).otherwise(some).cast(HEADERS)
    return placed(to_messages(spread_events(spark, folder))).withColumn("headers", headers)


def metric_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One metrics request per customer: any event name (one of them unknown), range, channel and grouping."""
    prepare(spark)
    key = F.col("c_custkey")
    start = F.lit(1704067200) + key * 7919 % (20 * 86400)
    return spark.read.parquet(f"{folder}/customer.parquet").select(
        key.alias("request_id"),
        F.when(key % 101 == 0, F.lit(""))
        .otherwise(raw.pick(key, ["click", "error", "purchase", "signup", "view", "nothing"]))
        .alias("event_name"),
        F.when(key % 103 == 0, F.lit(0)).otherwise(start).cast("bigint").alias("from"),
        F.when(key % 107 == 0, F.lit(0)).otherwise(start + key * 104729 % (9 * 86400)).cast("bigint").alias("to"),
        F.when(key % 109 == 0, F.lit("tv")).otherwise(raw.pick(F.floor(key / 6), ["", *CHANNELS])).alias("channel"),
        F.when(key % 113 == 0, F.lit("week")).otherwise(raw.pick(F.floor(key / 24), ["", *GROUPINGS])).alias("group_by"),
    )
