"""Deciding requests: what is accepted, what is not and why.

A bulk request is one row that holds its events, so its outcome is worked out inside the row; nothing is
grouped or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions import fixed as fx
from footfall.functions.clock import Moment, as_seconds
from footfall.functions.ids import event_id
from footfall.functions.json_fields import once, quoted
from footfall.operators.commands import to_events
from footfall.operators.validate import errors_of, first_errors_text, valid, with_errors


def bulk_events(decoded: DataFrame, ingest_time: Moment) -> DataFrame:
    """One row per event of every request that was not turned down whole, with its place in the request.

    An event that a request holds twice stays twice.
    """
    taken = decoded.where("request_error IS NULL")
    rows = taken.select("request_id", F.posexplode("events").alias("index", "command"))
    return to_events(rows.select("request_id", "index", "command.*"), ingest_time)


def single_events(decoded: DataFrame, ingest_time: Moment) -> DataFrame:
    """The event of every single-event request that could be read; it has no place in a list."""
    taken = decoded.where("request_error IS NULL").drop("request_error")
    return to_events(taken.withColumn("index", F.lit(None).cast("int")), ingest_time)


def accepted(events: DataFrame, now: Moment) -> DataFrame:
    return valid(with_errors(events, now))


def _timed(decoded: DataFrame, now: Moment, published: Column | None) -> DataFrame:
    return decoded.withColumns(
        {"now": as_seconds(now), "published": F.lit(True) if published is None else published}
    )


def single_outcome(decoded: DataFrame, now: Moment, published: Column | None = None) -> DataFrame:
    """One answer per single-event request: 202 queued with the id, 400 with the errors, or 500."""
    stamp = event_id(F.col("event_name"), F.col("user_id"), F.col("timestamp"), F.col("channel"))
    checked = _timed(decoded, now, published).withColumn("stamp", stamp)
    judged = checked.selectExpr("*", f"{once(f'if(request_error IS NULL, {errors_of()}, NULL)')} AS errors")
    answered = judged.selectExpr(
        "*",
        "CASE WHEN request_error IS NOT NULL OR size(errors) > 0 THEN 400 WHEN published THEN 202 ELSE 500 END AS status",
    )
    return answered.selectExpr(
        "request_id",
        "status",
        "if(status = 202, stamp, NULL) AS event_id",
        """CASE WHEN request_error IS NOT NULL THEN request_error WHEN status = 400 THEN 'validation failed'
           WHEN status = 500 THEN 'failed to process event' END AS error""",
        "errors",
    )


def bulk_outcome(decoded: DataFrame, now: Moment, published: Column | None = None) -> DataFrame:
    """One answer per bulk request: status, counts and the failed indices.

    202 when all events were taken, 207 when some were, 400 when none was. ``published`` says whether handing the
    valid events on succeeded; where it did not, they fail too and are listed after the validation failures.
    """
    judge = f"(e, i) -> named_struct('index', i, 'error', {first_errors_text(prefix='e.')})"
    judged = once(f"if(request_error IS NULL, transform(events, {judge}), NULL)")
    unsent = f"transform(sound, e -> named_struct('index', e.index, 'error', {quoted(fx.SAY_NOT_PUBLISHED)}))"
    return (
        _timed(decoded, now, published)
        .selectExpr("request_id", "request_error", "published", f"{judged} AS judged")
        .selectExpr(
            "request_id",
            "request_error",
            "published",
            f"{once('filter(judged, e -> e.error IS NOT NULL)')} AS failed",
            f"{once('filter(judged, e -> e.error IS NULL)')} AS sound",
        )
        .selectExpr(
            "request_id",
            "request_error",
            "coalesce(if(published, size(sound), 0), 0) AS success_count",
            "coalesce(if(published, size(failed), size(failed) + size(sound)), 0) AS failed_count",
            f"if(published, failed, concat(failed, {unsent})) AS errors",
        )
        .selectExpr(
            "request_id",
            "request_error",
            """CASE WHEN request_error IS NOT NULL THEN 400 WHEN failed_count > 0 AND success_count > 0 THEN 207
               WHEN failed_count > 0 THEN 400 ELSE 202 END AS status""",
            "success_count",
            "failed_count",
            "errors",
        )
    )
