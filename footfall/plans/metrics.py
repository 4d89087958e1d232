"""Counts and unique users by event name, time range, channel, hour or day, read from the hourly rollup."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.clock import as_timestamp, day_of, key_text
from footfall.functions.fixed import GROUPINGS
from footfall.functions.sketches import distinct_count, merged_state, total
from footfall.operators.rollup import merge_hourly
from footfall.operators.validate import check_request, valid, with_request_errors
from footfall.plans import first_seen, spans


def in_range(event_name: str, start: int, end: int, channel: str = "") -> Column:
    """Rollup rows a request covers: hours whose *start* lies in [start, end]; '' as channel means any.

    A start inside an hour leaves that hour out, an end inside an hour takes the whole hour in. The bounds on
    ``event_date`` say nothing new; they let Spark skip the other day partitions.
    """
    first, last = as_timestamp(start), as_timestamp(end)
    parts = [
        F.col("event_name") == event_name,
        F.col("hour").between(first, last),
        F.col("event_date").between(F.to_date(first), F.to_date(last)),
    ]
    if channel:
        parts.append(F.col("channel") == channel)
    return reduce(and_, parts)


def group_key(group_by: str) -> Column:
    return {"channel": F.col("channel"), "hour": key_text(F.col("hour")), "day": key_text(day_of(F.col("hour")))}[
        group_by
    ]


def counts() -> list[Column]:
    return [
        total("event_count").alias("total_count"),
        distinct_count(merged_state("unique_users_state")).alias("unique_users"),
    ]


def metric_total(hourly: DataFrame, event_name: str, start: int, end: int, channel: str = "") -> DataFrame:
    """One row: total_count and unique_users, both 0 where nothing matches."""
    return hourly.where(in_range(event_name, start, end, channel)).agg(*counts())


def metric_groups(
    hourly: DataFrame, event_name: str, start: int, end: int, channel: str = "", group_by: str = ""
) -> DataFrame:
    """One row per channel, hour or day, in key order; no rows for any other grouping."""
    rows = hourly.where(in_range(event_name, start, end, channel))
    if group_by not in GROUPINGS:
        rows, group_by = rows.where(F.lit(False)), "channel"
    return rows.groupBy(group_key(group_by).alias("key")).agg(*counts()).orderBy("key")


def metrics(
    hourly: DataFrame, event_name: str, start: int, end: int, channel: str = "", group_by: str = ""
) -> DataFrame:
    """The checked answer to one request: a row of scope 'total', then rows of scope 'group' by key."""
    check_request(hourly.sparkSession, event_name, start, end, channel, group_by)
    scope, blank = F.lit("total").alias("scope"), F.lit("").alias("key")
    answer = metric_total(hourly, event_name, start, end, channel).select(scope, blank, "total_count", "unique_users")
    if group_by:
        groups = metric_groups(hourly, event_name, start, end, channel, group_by)
        answer = answer.unionByName(groups.withColumn("scope", F.lit("group")))
    return answer.orderBy(F.col("scope").desc(), "key")


#: The last second an event can have (2106-02-07).
LATEST = 2**32 - 1

def answer_requests(requests: DataFrame, hourly: DataFrame, days: int = 64, tree: DataFrame | None = None) -> DataFrame:
    """Answer a whole table of requests (request_id, event_name, from, to, channel, group_by) in one job.

    Requests with errors get no answer. Requests are cut to whole hours that hold events and made distinct first, so a
    question asked a million times is worked out once. Their users are counted by when they were last seen
    (``plans.first_seen``): no states are merged for a question or a range, and what is counted grows with the rollup and
    the days asked from each day, not with the questions. So a range is exact as far as the states of its single hours are.

    A question has at most one group per hour it covers, so its finished groups (three values each) travel in a list.
    Days before the earliest and after the latest that any request asks for are not read. ``tree`` may hold the spans of
    the rollup if they are kept (``spans.write_tree``); its hours are merged already. ``days``, the longest span, decides
    nothing here since single hours settle all questions.
    """
    hour_seconds = F.unix_seconds("hour")
    asked = valid(with_request_errors(requests)).selectExpr(
        "request_id",
        "event_name",
        "ceil(`from` / 3600) * 3600 AS first_hour",
        "floor(`to` / 3600) * 3600 AS last_hour",
        "channel",
        "group_by",
    )
    dates = [F.to_date(F.timestamp_seconds(F.least(F.greatest(x, F.lit(0)), F.lit(LATEST)))) for x in (F.min("first_hour"), F.max("last_hour"))]
    span = asked.agg(dates[0].alias("first"), dates[1].alias("last"))
    hourly = hourly.where(F.col("event_date").between(span.select("first").scalar(), span.select("last").scalar()))
    names = hourly.groupBy("event_name").agg(F.min(hour_seconds).alias("low"), F.max(hour_seconds).alias("high"), F.sum("event_count").alias("n"), F.count("*").alias("rows"))
    parts = F.ceil(F.col("n") / F.greatest(F.lit(first_seen.PART), first_seen.SHARE * F.col("rows")))
    busy = F.collect_list(F.when(F.col("event_name").isNotNull() & (parts > 1), F.struct("event_name", parts)))
    held = names.agg(F.struct(F.min("low").alias("low"), F.max("high").alias("high"), F.map_from_entries(busy).alias("parts"))).scalar()
    asked = asked.withColumns({"first": F.greatest("first_hour", held["low"]), "last": F.least("last_hour", held["high"])})
    asked = asked.selectExpr(
        "request_id", "event_name", "channel", "if(first <= last, first div 3600, NULL) AS first", "if(first <= last, last div 3600 + 1, NULL) AS after", "group_by"
    )
    if tree is None:
        hours = merge_hourly(hourly).withColumn("hour", spans.hour_number(F.col("hour")))
    else:
        hours = tree.where("level = 0 AND channel IS NOT NULL").withColumnRenamed("start", "hour")
    split = F.coalesce(F.try_element_at(held["parts"], F.col("event_name")), F.lit(1))
    found = first_seen.answers(asked.where("first IS NOT NULL").select(*first_seen.QUESTION), hours, split)
    total = "named_struct('key', CAST(NULL AS string), 'total_count', coalesce(total_count, 0L), 'unique_users', coalesce(unique_users, 0L))"
    rows = asked.join(found, first_seen.QUESTION, "left").selectExpr("request_id", f"inline(if(grouped IS NULL, array({total}), concat(array({total}), grouped)))")
    scope = F.when(F.col("key").isNull(), F.lit("total")).otherwise(F.lit("group"))
    return rows.select("request_id", scope.alias("scope"), F.coalesce("key", F.lit("")).alias("key"), "total_count", "unique_users")


def shaped(answers: DataFrame) -> DataFrame:
    """One row per request with its groups as a list in key order; a request has at most one group per hour asked."""
    group = F.when(F.col("scope") == "group", F.struct("key", "total_count", "unique_users"))
    is_total = F.col("scope") == "total"
    return answers.groupBy("request_id").agg(
        F.max(F.when(is_total, F.col("total_count"))).alias("total_count"),
        F.max(F.when(is_total, F.col("unique_users"))).alias("unique_users"),
        F.array_sort(F.collect_list(group)).alias("grouped_data"),
    )
