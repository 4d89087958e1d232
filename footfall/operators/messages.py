"""Events as topic messages, and messages back to events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions import json_fields as jf
from footfall.functions.clock import Moment, as_timestamp, rfc3339
from footfall.functions.schema import EVENTS

FIELDS = [*jf.TEXT_FIELDS, *jf.OTHER_FIELDS]


def to_messages(events: DataFrame) -> DataFrame:
    """Key: the user id, so a user's messages keep their order. Value: the event as JSON."""
    body = F.struct(
        *jf.TEXT_FIELDS,
        "timestamp",
        "tags",
        F.try_parse_json("metadata").alias("metadata"),
        rfc3339(F.col("created_at")).alias("created_at"),
    )
    kept = [c for c in events.columns if c not in EVENTS.fieldNames()]
    return events.select(
        *kept,
        "timestamp",
        F.col("user_id").cast("binary").alias("key"),
        F.to_json(body).cast("binary").alias("value"),
    )


def decode(messages: DataFrame) -> DataFrame:
    """Add ``event`` (a struct) and ``problem``; a message with a problem is malformed.

    Missing and null fields read as blanks, unknown fields are passed over. Ids are taken as they are and nothing
    is checked again; but a time that the events table cannot hold makes the message malformed.
    """
    stored = [name for name in FIELDS if name != "created_at"]
    given = [f"`{c}`" for c in messages.columns]
    event = jf.as_struct(jf.as_values("fields", "metadata_text", stored))
    problem = f"""coalesce(unreadable, wrong, if(event.timestamp BETWEEN {jf.FIRST_SECOND} AND {jf.LAST_SECOND}, NULL,
        'field timestamp is out of range'))"""
    return (
        jf.open_objects(messages, "CAST(value AS string)", FIELDS)
        .selectExpr(
            *given,
            "unreadable",
            f"{jf.once(event)} AS event",
            f"{jf.once(jf.wrong('fields', 'metadata_text', FIELDS))} AS wrong",
        )
        .selectExpr(*given, "event", f"{problem} AS problem")
    )


def well_formed(decoded: DataFrame, created_at: Moment) -> DataFrame:
    """Event rows, ready to store, out of the messages without a problem."""
    ts = F.timestamp_seconds("event.timestamp")
    return decoded.where("problem IS NULL").select(
        "event.*",
        as_timestamp(created_at).alias("created_at"),
        ts.alias("ts"),
        F.to_date(ts).alias("event_date"),
    )


def malformed(decoded: DataFrame) -> DataFrame:
    return decoded.where("problem IS NOT NULL").drop("event")
