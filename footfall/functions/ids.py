"""Deterministic event ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_id(name: Column, user: Column, timestamp: Column, channel: Column) -> Column:
    """Hex SHA-256 over ``name|user|timestamp|channel``; the same event sent again gets the same id.

    ``concat_ws`` drops NULLs, which would shift the fields, so blanks are put in first.
    """
    parts = [
        F.coalesce(name, F.lit("")),
        F.coalesce(user, F.lit("")),
        F.coalesce(timestamp, F.lit(0)).cast("string"),
        F.coalesce(channel, F.lit("")),
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)
