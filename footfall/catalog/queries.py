"""The registered queries: name -> function of (spark, folder of the given tables)."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.catalog import inputs
from footfall.functions import fixed as fx
from footfall.functions.clock import key_text, rfc3339
from footfall.functions.schema import MESSAGE
from footfall.functions.sketches import distinct_count
from footfall.operators import failures, latest, messages, requests, rollup, validate
from footfall.operators.commands import to_rows
from footfall.plans import dashboard, metrics
from footfall.session import fresh_folder
from footfall.sources import raw_events, request_bodies, synthetic
from footfall.sources.campaigns import CampaignStates
from footfall.sources.layout import merge_by_curve_into
from footfall.sources.maintained import LatestEvents
from footfall.sources.membership import StoredIds
from footfall.sources.tables import Tables
from footfall.sources.topic import stream_files
from footfall.streaming import intake
from footfall.streaming.hours import read_hours, start_hours
from footfall.streaming.landing import start_landing
from footfall.streaming.retrying import retry_due

Query = Callable[[SparkSession, str], DataFrame]


# Events ----------------------------------------------------------------------------------------------------


def event_id_stamp(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.events(spark, folder).select("src", "event_id")


def canonical_events(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.spread_events(spark, folder).select(
        "src",
        "event_name",
        "channel",
        "campaign_id",
        "user_id",
        "timestamp",
        F.array_join("tags", ",").alias("tags"),
        "metadata",
        key_text(F.col("created_at")).alias("created_at"),
        key_text(F.col("ts")).alias("ts"),
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
        dashboard.price().alias("price"),
    )


def synthetic_events(spark: SparkSession, folder: str) -> DataFrame:
    """Generated load, one command per given event."""
    numbers = inputs.table(spark, folder).select(F.col("event_id").alias("n"))
    made = synthetic.generate(numbers, now=1704067200)
    return made.withColumn("tags", F.array_join("tags", ","))


# Validation and requests -----------------------------------------------------------------------------------


def validate_errors(spark: SparkSession, folder: str) -> DataFrame:
    faulty, now = inputs.faulty_commands(spark, folder)
    errors = F.col("errors")
    return validate.with_errors(faulty, now).select(
        "src", F.size(errors).alias("n"), validate.codes_text(errors).alias("codes"), F.expr(validate.errors_text("errors")).alias("said")
    )


def valid_invalid_split(spark: SparkSession, folder: str) -> DataFrame:
    faulty, now = inputs.faulty_commands(spark, folder)
    verdict = F.when(F.size("errors") == 0, F.lit("valid")).otherwise(F.lit("invalid"))
    return validate.with_errors(faulty, now).select("src", "event_id", verdict.alias("verdict"))


def _bulk_answer(outcome: DataFrame) -> DataFrame:
    lines = F.transform("errors", lambda e: F.concat(e["index"].cast("string"), F.lit(": "), e["error"]))
    return outcome.select(
        "request_id",
        "status",
        "success_count",
        "failed_count",
        F.coalesce("request_error", F.lit("")).alias("request_error"),
        F.coalesce(F.array_join(lines, " | "), F.lit("")).alias("errors"),
    )


def bulk_outcome(spark: SparkSession, folder: str) -> DataFrame:
    bodies, now = inputs.bulk_bodies(spark, folder)
    return _bulk_answer(requests.bulk_outcome(request_bodies.decode_bulk(bodies), now))


def bulk_publish_failure(spark: SparkSession, folder: str) -> DataFrame:
    """Handing on fails for every third request."""
    bodies, now = inputs.bulk_bodies(spark, folder)
    went_out = F.col("request_id").cast("bigint") % 3 != 0
    return _bulk_answer(requests.bulk_outcome(request_bodies.decode_bulk(bodies), now, went_out))


def bulk_accepted_events(spark: SparkSession, folder: str) -> DataFrame:
    bodies, now = inputs.bulk_bodies(spark, folder)
    taken = requests.bulk_events(request_bodies.decode_bulk(bodies), F.timestamp_seconds(now))
    return requests.accepted(taken, now).select("request_id", "index", "event_id", "timestamp")


def single_outcome(spark: SparkSession, folder: str) -> DataFrame:
    bodies, now = inputs.single_bodies(spark, folder)
    answers = requests.single_outcome(request_bodies.decode_single(bodies), now)
    blank = F.lit("")
    return answers.select(
        "request_id",
        "status",
        F.coalesce("event_id", blank).alias("event_id"),
        F.coalesce("error", blank).alias("error"),
        F.coalesce(validate.codes_text(F.col("errors")), blank).alias("codes"),
    )


def _single(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The decoded requests and their judged events."""
    bodies, now = inputs.single_bodies(spark, folder)
    decoded = request_bodies.decode_single(bodies)
    return decoded, validate.with_errors(requests.single_events(decoded, F.timestamp_seconds(now)), now)


def single_accepted_messages(spark: SparkSession, folder: str) -> DataFrame:
    sent = messages.to_messages(validate.valid(_single(spark, folder)[1]))
    return sent.select("request_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def single_refused(spark: SparkSession, folder: str) -> DataFrame:
    return intake.refused(*_single(spark, folder)).select("request_id", "reason")


def metrics_request_errors(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate.with_request_errors(inputs.metric_requests(spark, folder))
    return checked.select("request_id", F.size("errors").alias("n"), validate.codes_text(F.col("errors")).alias("codes"))


# Rollup and versions ---------------------------------------------------------------------------------------


def _shown(hourly: DataFrame) -> DataFrame:
    return hourly.select(
        "event_name",
        "channel",
        key_text(F.col("hour")).alias("hour"),
        "event_count",
        distinct_count(F.col("unique_users_state")).alias("unique_users"),
    )


def hourly_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(rollup.merge_hourly(rollup.hourly_partials(inputs.events(spark, folder))))


def hourly_window_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(rollup.hourly_by_window(inputs.events(spark, folder)))


def rollup_resend(spark: SparkSession, folder: str) -> DataFrame:
    """An event that is sent again counts again, its user does not."""
    return _shown(rollup.merge_hourly(rollup.hourly_partials(inputs.sent_again(spark, folder))))


def rollup_of_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The exact option: versions first, then the rollup."""
    newest = latest.latest_versions(inputs.sent_again(spark, folder))
    return _shown(rollup.merge_hourly(rollup.hourly_partials(newest)))


def rollup_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of partial rows in the stored rollup, merged to one row per key."""
    tables = Tables(spark, fresh_folder(spark, "rollup")).create()
    tables.write_hourly(rollup.hourly_partials(inputs.events(spark, folder)), "load-1")
    tables.write_hourly(rollup.hourly_partials(inputs.sent_again(spark, folder)), "load-2")
    merged = Tables(spark, fresh_folder(spark, "merged"))
    tables.merge_hourly_into(merged, "merge-1")
    return _shown(merged.hourly())


def _versions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id", "event_name", "timestamp", "metadata", key_text(F.col("created_at")).alias("created_at")
    )


def latest_events(spark: SparkSession, folder: str) -> DataFrame:
    return _versions(latest.latest_versions(inputs.sent_again(spark, folder)))


def stored_latest_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same through the stored events table: write, merge each day, read."""
    tables = Tables(spark, fresh_folder(spark, "events")).create()
    tables.write_events(inputs.sent_again(spark, folder), "load-1")
    merged = Tables(spark, fresh_folder(spark, "merged"))
    tables.merge_events_into(merged, "merge-1")
    return _versions(merged.events())


def latest_events_by_curve(spark: SparkSession, folder: str) -> DataFrame:
    """The same, merged along the curve over name, user and time."""
    tables = Tables(spark, fresh_folder(spark, "events")).create()
    tables.write_events(inputs.sent_again(spark, folder), "load-1")
    merged = Tables(spark, fresh_folder(spark, "merged"))
    merge_by_curve_into(tables, merged, "merge-1")
    return _versions(merged.events())


def maintained_latest_events(spark: SparkSession, folder: str) -> DataFrame:
    """Three loads, each with rows for days that are merged already; the last is not merged when it is read."""
    rows = inputs.sent_again(spark, folder)
    loads = [rows.where("copy = 0 AND src % 2 = 0"), rows.where("copy = 1"), rows.where("copy = 0 AND src % 2 = 1")]
    tables = Tables(spark, fresh_folder(spark, "events")).create()
    latest_events = LatestEvents(spark, tables, fresh_folder(spark, "maintained")).create()
    for n, load in enumerate(loads):
        tables.write_events(load, f"load-{n}")
        if n < 2:
            latest_events.merge()
    return _versions(latest_events.read())


def unseen_events(spark: SparkSession, folder: str) -> DataFrame:
    """Strict intake of the resent set when the events up to the asked end are stored already."""
    stored = inputs.events(spark, folder).where(F.col("timestamp") <= inputs.ASK_TO)
    return _versions(latest.unseen(inputs.sent_again(spark, folder), stored))


def unseen_by_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The same over stored events in two batches, whose filters say which days to read."""
    stored = inputs.events(spark, folder).where(F.col("timestamp") <= inputs.ASK_TO)
    tables = Tables(spark, fresh_folder(spark, "events")).create()
    ids = StoredIds(spark, tables, fresh_folder(spark, "ids")).create()
    for n in range(2):
        tables.write_events(stored.where(F.col("src") % 2 == n), f"load-{n}")
        ids.add(f"load-{n}")
    return _versions(ids.unseen(inputs.sent_again(spark, folder)))


# Metrics ---------------------------------------------------------------------------------------------------


def _asked_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Partial rollup rows over the hours the fixed question covers; metrics merge partial rows as they read."""
    first, after = rollup.whole_hours(inputs.ASK_FROM, inputs.ASK_TO)
    rows = inputs.rows_of(raw_events.raw_between(inputs.table(spark, folder), first, after))
    return rollup.hourly_partials(rows.where(F.col("event_name") == inputs.ASK_NAME))


ASK = (inputs.ASK_NAME, inputs.ASK_FROM, inputs.ASK_TO)


def metrics_total(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.metric_total(_asked_hours(spark, folder), *ASK)


def metrics_total_channel(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.metric_total(_asked_hours(spark, folder), *ASK, "web")


def metrics_by(group_by: str) -> Query:
    return lambda spark, folder: metrics.metric_groups(_asked_hours(spark, folder), *ASK, group_by=group_by)


def metrics_by_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """An unknown grouping: the total is answered, without groups."""
    hourly = _asked_hours(spark, folder)
    total = metrics.metric_total(hourly, *ASK).withColumn("key", F.lit("total"))
    return total.unionByName(metrics.metric_groups(hourly, *ASK, group_by="week"))


def metrics_shaped(spark: SparkSession, folder: str) -> DataFrame:
    """One row per request; its groups as one text, which compares alike in any engine."""
    groups = F.array_join(F.transform("grouped_data", lambda g: F.concat_ws(":", g["key"], g["total_count"].cast("string"), g["unique_users"].cast("string"))), ";")
    return metrics.shaped(metrics_requests_batch(spark, folder)).withColumn("grouped_data", groups)


def metrics_answer(spark: SparkSession, folder: str) -> DataFrame:
    """The whole answer to one request: total and days."""
    return metrics.metrics(_asked_hours(spark, folder), *ASK, channel="api", group_by="day")


def metrics_requests_batch(spark: SparkSession, folder: str) -> DataFrame:
    hourly = rollup.hourly_partials(inputs.events(spark, folder))
    return metrics.answer_requests(inputs.metric_requests(spark, folder), hourly)


# Dashboard -------------------------------------------------------------------------------------------------


def _panel(panel: Callable[[DataFrame, Column], DataFrame], over_rollup: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        given = inputs.table(spark, folder)
        as_of = F.timestamp_seconds(raw_events.newest_second(given))
        rows = to_rows(raw_events.as_commands(raw_events.raw_last_day(given)))
        return panel(rollup.hourly_partials(rows) if over_rollup else rows, as_of)

    return query


def panels_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """All panels in one job."""
    given = inputs.table(spark, folder)
    as_of = F.timestamp_seconds(raw_events.newest_second(given))
    rows = to_rows(raw_events.as_commands(raw_events.raw_last_day(given)))
    return dashboard.refresh(rollup.hourly_partials(rows), rows, as_of)


def _campaign_states(spark: SparkSession, folder: str) -> tuple[CampaignStates, Column]:
    """The events stored in two batches, and their states."""
    given = inputs.table(spark, folder)
    rows = inputs.events(spark, folder)
    tables = Tables(spark, fresh_folder(spark, "events")).create()
    states = CampaignStates(spark, tables, fresh_folder(spark, "campaigns")).create()
    for n in range(2):
        tables.write_events(rows.where(F.col("src") % 2 == n), f"load-{n}")
        states.add(f"load-{n}")
    return states, F.timestamp_seconds(raw_events.newest_second(given))


def b04_from_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    states, as_of = _campaign_states(spark, folder)
    return states.active_campaigns(as_of)


def b13_from_lists(spark: SparkSession, folder: str) -> DataFrame:
    states, as_of = _campaign_states(spark, folder)
    return states.top_campaigns(as_of)


PANELS: dict[str, Query] = {
    "b01_total_events": _panel(dashboard.total_events, True),
    "b02_unique_users": _panel(dashboard.unique_users, True),
    "b03_purchases": _panel(dashboard.purchases, True),
    "b04_active_campaigns": _panel(dashboard.active_campaigns, False),
    "b05_total_revenue": _panel(dashboard.total_revenue, False),
    "b06_avg_order_value": _panel(dashboard.avg_order_value, False),
    "b07_revenue_over_time": _panel(dashboard.revenue_over_time, False),
    "b08_events_over_time": _panel(dashboard.events_over_time, True),
    "b09_unique_users_over_time": _panel(dashboard.unique_users_over_time, True),
    "b10_events_by_channel": _panel(dashboard.events_by_channel, True),
    "b11_events_by_type": _panel(dashboard.events_by_type, True),
    "b12_events_by_type_channel": _panel(dashboard.events_by_type_and_channel, True),
    "b13_top_campaigns": _panel(dashboard.top_campaigns, False),
}


# Messages and failures -------------------------------------------------------------------------------------


def publish_messages(spark: SparkSession, folder: str) -> DataFrame:
    sent = messages.to_messages(inputs.spread_events(spark, folder))
    return sent.select("src", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def decode_split(spark: SparkSession, folder: str) -> DataFrame:
    decoded = messages.decode(inputs.messages(spark, folder))
    fields = {c: F.col(f"event.{c}") for c in ("event_name", "channel", "campaign_id", "user_id", "timestamp", "metadata")}
    fields["tags"] = F.array_join("event.tags", ",")
    good = [F.when(F.col("problem").isNull(), value).alias(c) for c, value in fields.items()]
    return decoded.select("src", F.coalesce("problem", F.lit("")).alias("problem"), *good)


def malformed_to_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    bad = messages.malformed(messages.decode(inputs.messages(spark, folder)))
    return _headers(failures.dead_on_arrival(bad, "events", at=1704067200))


def _headers(rows: DataFrame) -> DataFrame:
    return rows.select("src", failures.headers_text(F.col("headers")).alias("headers"))


def insert_failed_to_retry(spark: SparkSession, folder: str) -> DataFrame:
    good = messages.decode(inputs.messages(spark, folder)).where("problem IS NULL")
    handed = failures.first_failure(good, "events", "no room", at=1704067200)
    text = failures.headers_text(F.col("headers")).alias("headers")
    return (
        failures.queued(handed, at=1704067200)
        .withColumn("src", F.col("offset"))
        .select("src", text, "retry_count", rfc3339(F.col("next_attempt_at")).alias("next_attempt_at"))
    )


def retry_count_decode(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.retry_messages(spark, folder)
    return rows.select("src", failures.retry_count(F.col("headers")).alias("retry_count"))


def retry_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """The wait of each batch of retry messages; a batch here is one topic partition."""
    return failures.batch_delay(inputs.retry_messages(spark, folder), by="partition")


def retry_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """The insert failed again: back to retry, or to the dead letters after the last try."""
    routed = failures.route_failed_retry(inputs.retry_messages(spark, folder), "still no room", at=1704067200)
    return routed.select("src", failures.headers_text(F.col("headers")).alias("headers"), "route")


def dlq_envelope(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that turn out malformed only in retry."""
    rows = inputs.damaged(inputs.retry_messages(spark, folder))
    bad = messages.malformed(messages.decode(rows))
    return _headers(failures.dead_letter(bad, fx.UNMARSHAL_ERROR, F.col("problem"), at=1704067200))


def failure_counts(spark: SparkSession, folder: str) -> DataFrame:
    decoded = messages.decode(inputs.messages(spark, folder))
    return failures.failure_counts(failures.route_failed_batch(decoded, "events", "no room", at=1704067200))


# Streams ---------------------------------------------------------------------------------------------------


def _landed(spark: SparkSession, folder: str, **how) -> Tables:
    """The given events as a stream of messages, some malformed, landed in tables of their own."""
    root = fresh_folder(spark, "stream")
    raw_stream = raw_events.stream_raw(inputs.prepare(spark), folder)
    sent = inputs.damaged(inputs.placed(messages.to_messages(inputs.rows_of(raw_stream))))
    tables = Tables(spark, f"{root}/tables")
    start_landing(sent, tables, f"{root}/checkpoint", **how).awaitTermination()
    return tables


def stream_ingest_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(rollup.merge_hourly(_landed(spark, folder).hourly()))


#: Messages of one topic partition that go to one file, about.
IN_A_FILE = 100_000


def stream_batches_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The same messages out of twenty topic files, three to a micro-batch; each batch brings rows for every day.

    Of a larger table each of the twenty is several files, and a micro-batch takes as many times three.
    """
    root = fresh_folder(spark, "batches")
    sent = inputs.messages(spark, folder).select(*MESSAGE.fieldNames())
    each = math.ceil(max(1, inputs.table(spark, folder).count()) / (fx.TOPIC_PARTITIONS * IN_A_FILE))
    sent.repartition(fx.TOPIC_PARTITIONS * each, "partition", F.pmod(F.xxhash64("offset"), F.lit(each))).write.parquet(f"{root}/topic")
    tables = Tables(spark, f"{root}/tables")
    start_landing(stream_files(spark, f"{root}/topic", files_per_trigger=3 * each), tables, f"{root}/checkpoint").awaitTermination()
    return _shown(rollup.merge_hourly(tables.hourly()))


def stream_hours_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The job with state over sixteen files in the order of time, three to a micro-batch; a file in the middle comes last.

    No hour closes before 30 days, so the running counts end as the rollup of all events.
    """
    root = fresh_folder(spark, "hours")
    rows = inputs.events(spark, folder).select("event_name", "channel", "user_id", "ts")
    late = F.pmod(F.datediff("ts", F.lit("2024-01-01")), F.lit(5)) == 2
    for n, part in enumerate((rows.where(~late).repartitionByRange(15, "ts"), rows.where(late).coalesce(1))):
        part.write.parquet(f"{root}/in/part={n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{root}/in/*")
    start_hours(stream, f"{root}/out", f"{root}/checkpoint", lateness=30 * 86400, blocks=2).awaitTermination()
    return read_hours(spark, f"{root}/out").withColumn("hour", key_text(F.col("hour")))


def stream_ingest_events(spark: SparkSession, folder: str) -> DataFrame:
    stored = _landed(spark, folder).events()
    tags = F.array_join("tags", ",").alias("tags")
    return stored.select("event_id", "event_name", "channel", "campaign_id", "user_id", "timestamp", tags, "metadata")


def stream_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    dead = _landed(spark, folder, clock=lambda: datetime(2024, 1, 1, tzinfo=timezone.utc)).stored("dead_letters")
    value, headers = F.col("value").cast("string").alias("value"), failures.headers_text(F.col("headers")).alias("headers")
    return dead.select(F.col("offset").alias("src"), "partition", value, headers)


def _failing(tables: Tables, rows: DataFrame, batch_id: str) -> None:
    raise RuntimeError("no room")


def stream_retry_recovers(spark: SparkSession, folder: str) -> DataFrame:
    """Every first insert fails; the retry job stores the events later. The rollup ends up the same."""
    tables = _landed(spark, folder, store=_failing)
    root = fresh_folder(spark, "retry")
    retry_due(spark, tables, f"{root}/checkpoint", clock=_much_later)
    return _shown(rollup.merge_hourly(tables.hourly()))


def failure_counts_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The insert fails, and two more tries do: each message counts once over the stored tables."""
    tables = _landed(spark, folder, store=_failing)
    root = fresh_folder(spark, "retry")
    for later in range(2):
        clock = lambda: _much_later() + timedelta(days=later)  # noqa: B023, E731
        retry_due(spark, tables, f"{root}/checkpoint", clock=clock, store=_failing)
    return failures.stored_failure_counts(tables.stored("retry"), tables.stored("dead_letters"))


def _much_later() -> datetime:
    return datetime(2100, 1, 1, tzinfo=timezone.utc)


ALL: dict[str, Query] = {
    "event_id_stamp": event_id_stamp,
    "canonical_events": canonical_events,
    "synthetic_events": synthetic_events,
    "validate_errors": validate_errors,
    "valid_invalid_split": valid_invalid_split,
    "bulk_outcome": bulk_outcome,
    "bulk_publish_failure": bulk_publish_failure,
    "bulk_accepted_events": bulk_accepted_events,
    "single_outcome": single_outcome,
    "single_accepted_messages": single_accepted_messages,
    "single_refused": single_refused,
    "metrics_request_errors": metrics_request_errors,
    "hourly_rollup": hourly_rollup,
    "hourly_window_rollup": hourly_window_rollup,
    "rollup_resend": rollup_resend,
    "rollup_of_latest": rollup_of_latest,
    "rollup_compacted": rollup_compacted,
    "latest_events": latest_events,
    "stored_latest_events": stored_latest_events,
    "latest_events_by_curve": latest_events_by_curve,
    "maintained_latest_events": maintained_latest_events,
    "unseen_events": unseen_events,
    "unseen_by_filters": unseen_by_filters,
    "metrics_total": metrics_total,
    "metrics_total_channel": metrics_total_channel,
    "metrics_by_channel": metrics_by("channel"),
    "metrics_by_hour": metrics_by("hour"),
    "metrics_by_day": metrics_by("day"),
    "metrics_by_unknown": metrics_by_unknown,
    "metrics_shaped": metrics_shaped,
    "metrics_answer": metrics_answer,
    "metrics_requests_batch": metrics_requests_batch,
    **PANELS,
    "b04_from_bitmaps": b04_from_bitmaps,
    "b13_from_lists": b13_from_lists,
    "panels_refresh": panels_refresh,
    "publish_messages": publish_messages,
    "decode_split": decode_split,
    "malformed_to_dead_letters": malformed_to_dead_letters,
    "insert_failed_to_retry": insert_failed_to_retry,
    "retry_count_decode": retry_count_decode,
    "retry_backoff": retry_backoff,
    "retry_outcome": retry_outcome,
    "dlq_envelope": dlq_envelope,
    "failure_counts": failure_counts,
    "stream_ingest_rollup": stream_ingest_rollup,
    "stream_batches_rollup": stream_batches_rollup,
    "stream_hours_rollup": stream_hours_rollup,
    "stream_ingest_events": stream_ingest_events,
    "stream_dead_letters": stream_dead_letters,
    "stream_retry_recovers": stream_retry_recovers,
    "failure_counts_stored": failure_counts_stored,
}
