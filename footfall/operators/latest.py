"""Keeping one version of an event that was stored more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["event_id", "event_name", "timestamp"]


def latest_versions(events: DataFrame) -> DataFrame:
    """The row with the highest ``created_at`` for each (event_id, event_name, timestamp).

    ``batch_id`` (where there is one), ``metadata``, ``campaign_id`` and ``tags`` only settle exact ties, so that rows
    which differ in nothing but these give the same winner in any order. Spark keeps the first row of each
    key before the shuffle already (WindowGroupLimit), so an event sent millions of times travels once per task.
    """
    ties = [c for c in ("batch_id", "metadata", "campaign_id", "tags") if c in events.columns]
    newest = Window.partitionBy(*KEY).orderBy(*[F.col(c).desc() for c in ["created_at", *ties]])
    return events.withColumn("version", F.row_number().over(newest)).where("version = 1").drop("version")


def unseen(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Strict intake: only events whose id is not stored yet. Reads the stored dates that the new events span."""
    span = events.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    dates = F.col("event_date").between(span.select("first").scalar(), span.select("last").scalar())
    known = stored.where(dates).select("event_date", "event_id")
    return latest_versions(events).join(known, ["event_date", "event_id"], "left_anti")


def first_seen(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Strict intake for a stream: drops an id that came before within the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
