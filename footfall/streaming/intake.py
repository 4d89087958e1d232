"""The intake job: requests into the topic, with an answer for every request and a table of what was refused."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.operators.messages import to_messages
from footfall.operators.requests import bulk_events, bulk_outcome, single_events, single_outcome
from footfall.operators.validate import errors_text, invalid, valid, with_errors
from footfall.sources.request_bodies import decode_bulk, decode_single
from footfall.sources.topic import as_topic, publish_kafka
from footfall.streaming.landing import Clock, batch_name, checkpoint_id, first_line, utc_now

Publish = Callable[[DataFrame, str], None]


@dataclass(frozen=True)
class Kind:
    """How requests of one kind are read, taken apart and answered."""

    decode: Callable[..., DataFrame]
    events: Callable[..., DataFrame]
    outcome: Callable[..., DataFrame]


BULK = Kind(decode_bulk, bulk_events, bulk_outcome)
SINGLE = Kind(decode_single, single_events, single_outcome)


def to_folder(folder: str, topic: str = "events") -> Publish:
    """Publishes to files, one folder per batch; a batch that runs again replaces its own."""

    def publish(messages: DataFrame, batch_id: str) -> None:
        as_topic(messages, topic, "timestamp").write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return publish


def to_kafka(servers: str, topic: str = "events") -> Publish:
    """Publishes to a broker's topic; a batch that runs again sends its messages again, with the same event ids."""
    return lambda messages, batch_id: publish_kafka(messages, servers, topic)


def refused(decoded: DataFrame, events: DataFrame) -> DataFrame:
    """What did not get in: whole requests with their reason, and single events with their errors."""
    requests = decoded.where("request_error IS NOT NULL").select(
        "request_id", F.lit(None).cast("int").alias("index"), F.col("request_error").alias("reason")
    )
    single = invalid(events).select("request_id", "index", F.expr(errors_text("errors")).alias("reason"))
    return requests.unionByName(single)


def take_in(batch: DataFrame, number: int, root: str, publish: Publish, at: datetime, stream: str = "intake", kind: Kind = BULK) -> None:
    """One micro-batch of requests. When publishing fails, every request of the batch is told so.

    The reason goes to the refused table as a row without a request.
    """
    batch_id = batch_name(stream, number)
    decoded = kind.decode(batch).persist()
    events = with_errors(kind.events(decoded, at), at).persist()  # judged once, for the topic and for what is refused
    try:
        try:
            publish(to_messages(valid(events)), batch_id)
            published, said = True, None
        except Exception as reason:
            published, said = False, first_line(reason)
        answers = kind.outcome(decoded, at, F.lit(published))
        answers.write.mode("overwrite").parquet(f"{root}/answers/batch_id={batch_id}")
        out = refused(decoded, events)
        if not published:
            why = decoded.sparkSession.range(1).select(F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("int").alias("index"), F.lit(f"publish: {said}").alias("reason"))
            out = out.unionByName(why)
        out.write.mode("overwrite").parquet(f"{root}/refused/batch_id={batch_id}")
    finally:
        events.unpersist()
        decoded.unpersist()


def start_intake(
    bodies: DataFrame,
    root: str,
    publish: Publish,
    checkpoint: str,
    stream: str = "intake",
    clock: Clock = utc_now,
    trigger: dict | None = None,
    kind: Kind = BULK,
) -> StreamingQuery:
    """Start the job for one kind of requests; single events and bulk requests have a stream and a root of their own."""
    known: list[str] = []

    def each(batch: DataFrame, number: int) -> None:
        if not known:
            known.append(f"{stream}-{checkpoint_id(batch.sparkSession, checkpoint)}")
        take_in(batch, number, root, publish, clock(), known[0], kind)

    writer = bodies.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
