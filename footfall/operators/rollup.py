"""The hourly rollup: counts and mergeable unique-user states by event name, channel and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.clock import hour_of
from footfall.functions.sketches import distinct_state, merged_state, total

KEYS = ["event_name", "channel", "hour"]

# Input partitions whose states meet in one task. One busy (name, channel, hour) has a state in every input
# partition, up to half a megabyte each; merging them in blocks first keeps any single task's share bounded.
BLOCK = 512


def input_block() -> Column:
    return (F.spark_partition_id() / BLOCK).cast("int")


def hourly_partials(events: DataFrame) -> DataFrame:
    """Partial rollup rows: every key appears once per block of input partitions.

    Rows are counted as they come, so an event that is sent again is counted again; unique users are not.
    Filter ``events`` before this call: nothing is pushed down past the block number.
    """
    narrow = events.select(
        "event_name", "channel", hour_of(F.col("ts")).alias("hour"), "user_id", input_block().alias("block")
    )
    return (
        narrow.groupBy(*KEYS, "block")
        .agg(F.count("*").alias("event_count"), distinct_state("user_id").alias("unique_users_state"))
        .select(*KEYS, "event_count", "unique_users_state", F.to_date("hour").alias("event_date"))
    )


def merge_hourly(partials: DataFrame) -> DataFrame:
    """One row per key out of any number of partial rows."""
    return (
        partials.groupBy(*KEYS)
        .agg(total("event_count").alias("event_count"), merged_state("unique_users_state").alias("unique_users_state"))
        .withColumn("event_date", F.to_date("hour"))
    )


def hourly_by_window(events: DataFrame, lateness: str = "30 days") -> DataFrame:
    """The stateful form for a stream: event-time windows that stay open for ``lateness``.

    The landing job appends partial rows instead and needs no state; use this where one running result is wanted.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour"), "event_name", "channel")
        .agg(F.count("*").alias("event_count"), distinct_state("user_id").alias("unique_users_state"))
        .select(
            "event_name",
            "channel",
            F.col("window.start").alias("hour"),
            "event_count",
            "unique_users_state",
            F.to_date("window.start").alias("event_date"),
        )
    )


def whole_hours(start: int, end: int) -> tuple[int, int]:
    """The seconds [first, after) of the hours whose start lies in [start, end].

    A plain range on the event time gives the same rows as ``hour BETWEEN start AND end`` and can be pushed
    down to a scan of events, where an expression over the hour cannot.
    """
    return -(-start // 3600) * 3600, end // 3600 * 3600 + 3600
