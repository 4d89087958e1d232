"""The hourly rollup as a running job with state: open hours are kept and brought up to date, late rows go aside.

The landing job needs no state and takes any late row; this one is for readers that want one number per hour, known to
be final at some point. It is the one job outside ``llm`` that calls Python, with Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from footfall.functions.clock import hour_of

KEYS = ["event_name", "channel", "hour", "block"]
COMBINED = "event_name string, channel string, hour bigint, user_id string, n bigint, newest timestamp"
RUNNING = "event_name string, channel string, hour bigint, block int, event_count bigint, unique_users bigint, late_user string, late bigint"
COUNTS = "event_name string, channel string, hour bigint, block int, event_count bigint, unique_users bigint, batch bigint"
LATE = "event_name string, channel string, hour bigint, user_id string, event_count bigint, batch bigint"

#: Spark drops rows behind its watermark unseen. Times are moved ahead by more than the events table's whole range, and
#: the watermark stays as far behind: it is the newest event time, and no row is ever behind it.
AHEAD_DAYS = 51100
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per hour and user of each Arrow batch, so that a busy user travels a few times per task."""
    by = ["event_name", "channel", "hour", "user_id"]
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(by).aggregate([("ts", "count"), ("ts", "max")])
        yield from sums.select([*by, "ts_count", "ts_max"]).rename_columns([*by, "n", "newest"]).to_batches()


class OpenHour(StatefulProcessor):
    """Of one (event name, channel, hour) and block of users: the count of events and the hashes of its users.

    State lives until the newest event time is ``lateness`` past the end of the hour; a timer then clears it. Rows of
    an hour past that point are given out as late, by user. A block holds its users as sorted numbers of 64 bits.
    """

    def __init__(self, lateness: int):
        self.lateness = lateness

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "events bigint, users binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closes = (key[2] + 3600 + self.lateness) * 1000
        if closes <= timerValues.getCurrentWatermarkInMs():
            for part in rows:
                by_user = part.groupby("user_id", as_index=False, dropna=False)["n"].sum()
                yield self._out(key, len(by_user), late_user=by_user["user_id"], late=by_user["n"])
            return
        events, users = self.kept.get() if self.kept.exists() else (0, b"")
        users = np.frombuffer(users, np.int64)
        for part in rows:
            events += int(part["n"].sum())
            users = np.union1d(users, part["user"].dropna().to_numpy(np.int64))
        self.kept.update((events, users.tobytes()))
        self.handle.registerTimer(closes)
        yield self._out(key, 1, event_count=events, unique_users=len(users))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass

    @staticmethod
    def _out(key, n: int, **values) -> pd.DataFrame:
        nothing = {"event_count": None, "unique_users": None, "late_user": None, "late": None}
        whole = pd.DataFrame({**dict(zip(KEYS, key)), **nothing, **values}, index=range(n))
        return whole.astype({"hour": "int64", "block": "int32", "event_count": "Int64", "unique_users": "Int64", "late": "Int64", "late_user": object})


def open_hours(events: DataFrame, lateness: int = 3600, blocks: int = 64) -> DataFrame:
    """Running counts of the hours that a micro-batch touches, and its late rows, of a stream with ``event_name, channel, user_id, ts``.

    Users fall into ``blocks`` by hash: the numbers of the blocks of an hour add up, and no task holds all users of a
    busy hour. A null user counts as an event and as no user.
    """
    hour = F.unix_seconds(hour_of(F.col("ts"))).alias("hour")
    combined = events.select("event_name", "channel", hour, "user_id", "ts").mapInArrow(_combine, COMBINED)
    hashed = F.when(F.col("user_id").isNotNull(), F.xxhash64("user_id"))
    block = F.pmod(F.coalesce(hashed, F.lit(0)), F.lit(blocks)).cast("int")
    placed = combined.withColumns({"user": hashed, "block": block, "seen": F.col("newest") + F.expr(f"INTERVAL {AHEAD_DAYS} DAYS")})
    marked = placed.withWatermark("seen", f"{AHEAD_DAYS} days")
    return marked.groupBy(*KEYS).transformWithStateInPandas(OpenHour(lateness), RUNNING, "Update", "EventTime")


def start_hours(events: DataFrame, root: str, checkpoint: str, lateness: int = 3600, blocks: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """Start the job. ``root/counts`` gets the running counts and ``root/late`` the late rows, each by micro-batch.

    A micro-batch that runs again replaces its folders. ``read_hours`` gives the counts as they stand.
    """
    spark = events.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            counts = batch.where("late IS NULL").select(*KEYS, "event_count", "unique_users")
            late = batch.where("late IS NOT NULL").select(*KEYS[:3], F.col("late_user").alias("user_id"), F.col("late").alias("event_count"))
            for rows, name in ((counts, "counts"), (late, "late")):
                rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        finally:
            batch.unpersist()

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # a query takes the settings it starts with
    try:
        writer = open_hours(events, lateness, blocks).writeStream.outputMode("update").foreachBatch(each)
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(STORE, before)


def read_hours(spark: SparkSession, root: str) -> DataFrame:
    """(event_name, channel, hour, event_count, unique_users): the last state of each block, added up."""
    rows = spark.read.schema(COUNTS).parquet(f"{root}/counts")
    newest = Window.partitionBy(*KEYS).orderBy(F.col("batch").desc())
    last = rows.withColumn("place", F.row_number().over(newest)).where("place = 1")
    sums = last.groupBy(*KEYS[:3]).agg(F.sum("event_count").alias("event_count"), F.sum("unique_users").alias("unique_users"))
    return sums.withColumn("hour", F.timestamp_seconds("hour"))


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """(event_name, channel, hour, user_id, event_count, batch) of the rows that came after their hour was closed."""
    return spark.read.schema(LATE).parquet(f"{root}/late")
