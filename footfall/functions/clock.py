"""Time columns. "Now" is always an argument, so a job can be run again with the same result."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.fixed import KEY_FORMAT, RFC3339_FORMAT

Moment = Column | datetime | int


def as_timestamp(moment: Moment) -> Column:
    """A timestamp column from a Column, a datetime (naive means UTC) or epoch seconds."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, datetime):
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=timezone.utc)
        return F.lit(moment)
    return F.timestamp_seconds(F.lit(moment))


def as_seconds(moment: Moment) -> Column:
    """Epoch seconds from the same inputs; a Column argument already holds seconds."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, datetime):
        return F.unix_seconds(as_timestamp(moment))
    return F.lit(moment).cast("bigint")


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def day_of(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def key_text(ts: Column) -> Column:
    """Hour and day keys share one text form; a day's key is its midnight."""
    return F.date_format(ts, KEY_FORMAT)


def rfc3339(moment: Moment) -> Column:
    return F.date_format(as_timestamp(moment), RFC3339_FORMAT)
