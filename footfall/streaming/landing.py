"""The landing job: topic messages into the events table, the hourly rollup and the dead-letter table."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from footfall.operators import failures
from footfall.operators.messages import decode, malformed, well_formed
from footfall.operators.rollup import hourly_partials
from footfall.sources.tables import Tables

Clock = Callable[[], datetime]
Insert = Callable[[Tables, DataFrame, str], None]


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def batch_name(stream: str, number: int) -> str:
    return f"{stream}-{number:012d}"


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gives a query when it first starts on a checkpoint, and keeps in it."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"].replace("-", "")


def insert(tables: Tables, rows: DataFrame, batch_id: str) -> None:
    """Store a batch of events and its partial rollup rows, both at once: neither write alone keeps all cores busy.

    Both have ended when this returns or fails.
    """
    with ThreadPoolExecutor(2) as pool:
        writes = [pool.submit(tables.write_events, rows, batch_id), pool.submit(tables.write_hourly, hourly_partials(rows), batch_id)]
    for write in writes:
        write.result()


# A kept table may have as many partitions as its rows need, of so many bytes as they are sent.
_HELD = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true"}


def held(messages: DataFrame) -> DataFrame:
    """The decoded messages, kept for the writes that follow: over all cores, and in more partitions the more there are.

    A partition is sent as about 8 MB; decoded and kept, the same rows take some five times that.
    """
    spark = messages.sparkSession
    before = {k: spark.conf.get(k) for k in _HELD}
    for k, v in _HELD.items():
        spark.conf.set(k, v)
    try:
        decoded = decode(messages.hint("rebalance")).persist()
        try:
            decoded.count()
        except Exception:
            decoded.unpersist()
            raise
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return decoded


def land(
    batch: DataFrame,
    number: int,
    tables: Tables,
    stream: str,
    topic: str,
    at: datetime,
    store: Insert = insert,
    again: bool = True,
) -> None:
    """One micro-batch. Malformed messages become dead letters; if the rest cannot be stored, all of it goes to retry.

    A batch that may run ``again`` first takes back what its earlier run left, in whichever table that was. If handing
    over to retry fails as well, the error ends the query and the batch runs again from the checkpoint.
    """
    batch_id = batch_name(stream, number)
    if again:
        tables.drop_batch(batch_id)
    decoded = held(batch)
    try:
        tables.write_dead_letters(failures.dead_on_arrival(malformed(decoded), topic, at), batch_id)
        try:
            store(tables, well_formed(decoded, at), batch_id)
        except Exception as reason:
            tables.drop_batch(batch_id)
            tables.write_dead_letters(failures.dead_on_arrival(malformed(decoded), topic, at), batch_id)
            good = decoded.where("problem IS NULL").drop("event", "problem")
            handed = failures.first_failure(good, topic, first_line(reason), at)
            tables.write_retry(failures.queued(handed, at), batch_id)
    finally:
        decoded.unpersist()


def first_line(reason: Exception) -> str:
    return (str(reason) or type(reason).__name__).splitlines()[0]


def start_landing(
    messages: DataFrame,
    tables: Tables,
    checkpoint: str,
    stream: str = "main",
    topic: str = "events",
    clock: Clock = utc_now,
    store: Insert = insert,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the job. ``trigger`` is passed on to Spark; the default takes what is there and stops.

    Batches are stored under the stream's name and the checkpoint's id: a query that starts on a new checkpoint adds
    to the tables, it never replaces what another one has stored.
    """
    tables.create()

    known: list[str] = []

    def each(batch: DataFrame, number: int) -> None:
        first = not known  # only the first batch after a start can have run before: an error in any other ends the query
        if first:
            known.append(f"{stream}-{checkpoint_id(batch.sparkSession, checkpoint)}")
        land(batch, number, tables, known[0], topic, clock(), store, first)

    writer = messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
