"""From what a client sends (a command) to a stored event row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.clock import Moment, as_timestamp
from footfall.functions.ids import event_id
from footfall.functions.json_fields import canonical_object
from footfall.functions.schema import COMMAND_COLUMNS


def to_events(commands: DataFrame, ingest_time: Moment) -> DataFrame:
    """Stamp commands with an id and the ingest time; blanks instead of NULLs; other columns are kept."""
    kept = [c for c in commands.columns if c not in COMMAND_COLUMNS]
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("event_name", "channel", "campaign_id", "user_id")}
    seconds = F.coalesce(F.col("timestamp"), F.lit(0)).cast("bigint")
    return commands.select(
        *kept,
        event_id(F.col("event_name"), F.col("user_id"), F.col("timestamp"), F.col("channel")).alias("event_id"),
        *[value.alias(name) for name, value in text.items()],
        seconds.alias("timestamp"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
        F.expr(canonical_object("metadata")).alias("metadata"),
        as_timestamp(ingest_time).alias("created_at"),
    )


def to_rows(events: DataFrame) -> DataFrame:
    """Add the derived time columns of the events table: ``ts`` and the partition column ``event_date``."""
    ts = F.timestamp_seconds("timestamp")
    return events.withColumns({"ts": ts, "event_date": F.to_date(ts)})


