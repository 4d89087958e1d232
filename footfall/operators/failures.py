"""Messages that could not be stored: retry, back-off and the dead-letter table.

What is known about a failure travels in the message headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions import fixed as fx
from footfall.functions.clock import Moment, as_timestamp, rfc3339
from footfall.functions.schema import HEADERS, MESSAGE

MESSAGE_COLUMNS = MESSAGE.fieldNames()


def header(name: str, value: Column | str) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.struct(F.lit(name).alias("key"), value.cast("string").cast("binary").alias("value"))


def header_value(headers: Column, name: str) -> Column:
    """The text of the first header of that name, or NULL."""
    return F.get(F.filter(headers, lambda h: h["key"] == name), F.lit(0))["value"].cast("string")


def headers_text(headers: Column) -> Column:
    """``name=value`` pairs in order, for reading."""
    return F.array_join(F.transform(headers, lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), "; ")


def retry_count(headers: Column) -> Column:
    """How often a message was tried: 1 unless the header holds a whole number (signed, no blanks)."""
    text = header_value(headers, fx.H_RETRY_COUNT)
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.coalesce(number, F.lit(fx.DEFAULT_RETRY_COUNT).cast("bigint"))


def backoff_seconds(count: Column) -> Column:
    """The wait before the next try doubles with each one, from 2 s up to 60 s; none for a count below 1."""
    doublings = F.least(count, F.lit(6)).cast("int") - 1
    delay = F.least(F.lit(fx.FIRST_DELAY_SECONDS) * F.pow(F.lit(2), doublings), F.lit(fx.LONGEST_DELAY_SECONDS))
    return F.when(count > 0, delay).otherwise(0).cast("bigint")


def batch_delay(messages: DataFrame, by: str | None = None) -> DataFrame:
    """The wait of a whole batch: that of its highest retry count."""
    grouped = messages.groupBy(by) if by else messages.groupBy()
    highest = grouped.agg(F.max(retry_count(F.col("headers"))).alias("max_retry_count"))
    return highest.withColumn("delay_seconds", F.coalesce(backoff_seconds(F.col("max_retry_count")), F.lit(0)))


def _kept(dropped: list[str]) -> Column:
    old = F.coalesce(F.col("headers"), F.array().cast(HEADERS))
    return F.filter(old, lambda h: ~h["key"].isin(dropped))


def _origin(topic: str) -> list[Column]:
    return [
        header(fx.H_TOPIC, topic),
        header(fx.H_PARTITION, F.col("partition")),
        header(fx.H_OFFSET, F.col("offset")),
    ]


def _arrival_headers(topic: str, at: Moment) -> Column:
    return F.array(
        header(fx.H_ERROR_TYPE, fx.UNMARSHAL_ERROR),
        header(fx.H_ERROR_MESSAGE, F.col("problem")),
        *_origin(topic),
        header(fx.H_FAILED_AT, rfc3339(at)),
    )


def _first_headers(topic: str, error_message: str, at: Moment) -> Column:
    return F.array(
        header(fx.H_RETRY_COUNT, "1"),
        header(fx.H_ERROR_TYPE, fx.INSERT_FAILED),
        header(fx.H_ERROR_MESSAGE, error_message),
        *_origin(topic),
        header(fx.H_FAILED_AT, rfc3339(at)),
    )


def _again_headers(error_message: str, at: Moment) -> Column:
    added = F.array(
        header(fx.H_RETRY_COUNT, retry_count(F.col("headers")) + 1),
        header(fx.H_ERROR_TYPE, fx.INSERT_FAILED),
        header(fx.H_ERROR_MESSAGE, error_message),
        header(fx.H_LAST_RETRY_AT, rfc3339(at)),
    )
    return F.concat(added, _kept([fx.H_RETRY_COUNT, fx.H_ERROR_TYPE, fx.H_ERROR_MESSAGE, fx.H_LAST_RETRY_AT]))


def _dead_headers(error_type: str, error_message: Column | str, at: Moment) -> Column:
    added = F.array(
        header(fx.H_FINAL_COUNT, retry_count(F.col("headers"))),
        header(fx.H_ERROR_TYPE, error_type),
        header(fx.H_ERROR_MESSAGE, error_message),
        header(fx.H_DEAD_AT, rfc3339(at)),
    )
    return F.concat(added, _kept([fx.H_RETRY_COUNT, fx.H_ERROR_TYPE, fx.H_ERROR_MESSAGE]))


def _headed(messages: DataFrame, headers: Column) -> DataFrame:
    return messages.withColumn("headers", headers.cast(HEADERS))


def dead_on_arrival(bad: DataFrame, topic: str, at: Moment) -> DataFrame:
    """Malformed messages of the main topic, as dead letters."""
    return _headed(bad, _arrival_headers(topic, at)).drop("problem")


def first_failure(messages: DataFrame, topic: str, error_message: str, at: Moment) -> DataFrame:
    """Messages whose batch could not be inserted, as the first entry for retry."""
    return _headed(messages, _first_headers(topic, error_message, at))


def route_failed_batch(decoded: DataFrame, topic: str, error_message: str, at: Moment) -> DataFrame:
    """Both at once, for a batch that could not be inserted: ``route`` is 'dead' or 'retry'."""
    bad = F.col("problem").isNotNull()
    headers = F.when(bad, _arrival_headers(topic, at)).otherwise(_first_headers(topic, error_message, at))
    routed = decoded.withColumn("route", F.when(bad, F.lit("dead")).otherwise(F.lit("retry")))
    return _headed(routed, headers).drop("problem", "event")


def is_exhausted(max_retries: int = fx.MAX_RETRIES) -> Column:
    return retry_count(F.col("headers")) >= max_retries


def requeue(messages: DataFrame, error_message: str, at: Moment) -> DataFrame:
    """A message that failed again goes back with its count raised by one; where it came from stays known."""
    return _headed(messages, _again_headers(error_message, at))


def dead_letter(messages: DataFrame, error_type: str, error_message: Column | str, at: Moment) -> DataFrame:
    """A message from retry that is given up."""
    return _headed(messages, _dead_headers(error_type, error_message, at))


def route_failed_retry(
    messages: DataFrame, error_message: str, at: Moment, max_retries: int = fx.MAX_RETRIES
) -> DataFrame:
    """Both at once, for a retry that failed: ``route`` is 'dead' for spent messages, else 'retry'."""
    spent = is_exhausted(max_retries)
    dead, again = _dead_headers(fx.RETRIES_EXHAUSTED, error_message, at), _again_headers(error_message, at)
    routed = messages.withColumn("route", F.when(spent, F.lit("dead")).otherwise(F.lit("retry")))
    return _headed(routed, F.when(spent, dead).otherwise(again))


def queued(messages: DataFrame, at: Moment) -> DataFrame:
    """Rows of the retry table: the message, its count and when it may be tried again. Nothing ever sleeps."""
    count = retry_count(F.col("headers"))
    moment = as_timestamp(at)
    due = F.timestamp_seconds(F.unix_seconds(moment) + backoff_seconds(count))
    return messages.select(
        *MESSAGE_COLUMNS, count.alias("retry_count"), moment.alias("queued_at"), due.alias("next_attempt_at")
    )


def failure_counts(*kept: DataFrame) -> DataFrame:
    """How many messages sit in the given tables, by kind of failure."""
    kinds = [t.select(header_value(F.col("headers"), fx.H_ERROR_TYPE).alias("error_type")) for t in kept]
    rows = kinds[0]
    for more in kinds[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("error_type").agg(F.count("*").alias("messages"))


def stored_failure_counts(retry: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """``failure_counts`` over the stored tables, where a message that was tried several times has several rows.

    Each message counts once, as it stands last: given up, or else with its highest count. It is told by the topic,
    partition and offset it came from, or has itself where no header says so.
    """
    headers = F.col("headers")
    origin = {"topic": fx.H_TOPIC, "partition": fx.H_PARTITION, "offset": fx.H_OFFSET}
    place = [F.coalesce(header_value(headers, name), F.col(own).cast("string")).alias(own) for own, name in origin.items()]

    def states(rows: DataFrame, dead: bool) -> DataFrame:
        state = F.struct(F.lit(dead).alias("dead"), retry_count(headers).alias("tries"))
        return rows.select(*place, header_value(headers, fx.H_ERROR_TYPE).alias("error_type"), state.alias("state"))

    rows = states(retry, False).unionByName(states(dead_letters, True))
    last = rows.groupBy(*origin).agg(F.max_by("error_type", "state").alias("error_type"))
    return last.groupBy("error_type").agg(F.count("*").alias("messages"))
