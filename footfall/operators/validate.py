"""Data-quality rules: every row gets the list of all its failures.

A rule is a function from a prefix to a SQL expression that gives an error struct or NULL. With the prefix '' it
speaks of the columns of a row, with 'e.' of the fields of an event ``e`` inside an array. ``now`` is a column
of the row, in epoch seconds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import fixed as fx
from footfall.functions.clock import Moment, as_seconds
from footfall.functions.json_fields import bind, once, quoted

Rule = Callable[[str], str]

ERRORS = "array<struct<field: string, code: string, message: string>>"


def error(field: str, code: str, message: str) -> str:
    """An error struct; ``field`` is a SQL expression."""
    return f"named_struct('field', {field}, 'code', {quoted(code)}, 'message', {quoted(message)})"


def short_text(field: str, say_required: str, say_too_long: str) -> Rule:
    """A rule for a text that must be there and fit in the byte limit."""
    missing = error(quoted(field), fx.REQUIRED, say_required)
    too_long = error(quoted(field), fx.TOO_LONG, say_too_long)
    return lambda e: f"""CASE WHEN {e}{field} = '' THEN {missing}
        WHEN octet_length({e}{field}) > {fx.MAX_NAME_BYTES} THEN {too_long} END"""


name_rule = short_text("event_name", fx.SAY_NAME_REQUIRED, fx.SAY_NAME_TOO_LONG)
user_rule = short_text("user_id", fx.SAY_USER_REQUIRED, fx.SAY_USER_TOO_LONG)


def time_rule(e: str) -> str:
    return f"""CASE
        WHEN {e}timestamp = 0 THEN {error("'timestamp'", fx.REQUIRED, fx.SAY_TIME_REQUIRED)}
        WHEN {e}timestamp > now THEN {error("'timestamp'", fx.IN_FUTURE, fx.SAY_TIME_FUTURE)}
        WHEN {e}timestamp < now - {fx.MAX_AGE_SECONDS}
          THEN {error("'timestamp'", fx.EXPIRED, fx.SAY_TIME_EXPIRED)} END"""


def one_of(field: str, words: list[str], code: str, message: str) -> Rule:
    """A rule for a text that must be one of a few words or ''."""
    allowed = ", ".join(quoted(word) for word in ["", *words])
    return lambda e: f"CASE WHEN {e}{field} NOT IN ({allowed}) THEN {error(quoted(field), code, message)} END"


channel_rule = one_of("channel", fx.CHANNELS, fx.BAD_CHANNEL, fx.SAY_CHANNEL)


def tags_rule(e: str) -> str:
    too_long = f"transform({e}tags, tag -> octet_length(tag) > {fx.MAX_TAG_BYTES})"
    first = f"(array_position({too_long}, true) - 1)"
    which = error(f"concat('tags[', {first}, ']')", fx.TAG_TOO_LONG, fx.SAY_TAG)
    return f"""CASE WHEN size({e}tags) > {fx.MAX_TAGS} THEN {error("'tags'", fx.TOO_MANY_TAGS, fx.SAY_TAGS)}
        WHEN {first} >= 0 THEN {which} END"""


EVENT_RULES: Sequence[Rule] = (name_rule, user_rule, time_rule, channel_rule, tags_rule)


def errors_of(rules: Sequence[Rule] = EVENT_RULES, prefix: str = "") -> str:
    """All failures of one event, in the order of the rules."""
    found = ", ".join(rule(prefix) for rule in rules)
    return f"CAST(filter(array({found}), x -> x IS NOT NULL) AS {ERRORS})"


def errors_text(errors: str) -> str:
    """``field: message; field: message``."""
    lines = f"array_join(transform({errors}, x -> concat(x.field, ': ', x.message)), '; ')"
    return f"if(size({errors}) = 0, {quoted(fx.SAY_NO_DETAIL)}, {lines})"


def first_errors_text(rules: Sequence[Rule] = EVENT_RULES, prefix: str = "") -> str:
    """The text of all failures of one event, NULL when there are none."""
    return bind(errors_of(rules, prefix), "errs", f"if(size(errs) = 0, NULL, {errors_text('errs')})")


def with_errors(events: DataFrame, now: Moment, rules: Sequence[Rule] = EVENT_RULES) -> DataFrame:
    given = [f"`{c}`" for c in events.columns]
    timed = events.withColumn("now", as_seconds(now))
    return timed.selectExpr(*given, f"{once(errors_of(rules))} AS errors")


def valid(checked: DataFrame) -> DataFrame:
    return checked.where("size(errors) = 0").drop("errors")


def invalid(checked: DataFrame) -> DataFrame:
    return checked.where("size(errors) > 0")


# Metrics requests ------------------------------------------------------------------------------------------


def required(field: str, blank: str, message: str) -> Rule:
    return lambda e: f"CASE WHEN {e}`{field}` = {blank} THEN {error(quoted(field), fx.REQUIRED, message)} END"


def range_rule(e: str) -> str:
    start, end = f"{e}`from`", f"{e}`to`"
    return f"""CASE WHEN {start} <> 0 AND {end} <> 0 AND {end} <= {start}
        THEN {error("'to'", fx.BAD_RANGE, fx.SAY_RANGE)} END"""


REQUEST_RULES: Sequence[Rule] = (
    required("event_name", "''", fx.SAY_NAME_REQUIRED),
    required("from", "0", fx.SAY_FROM_REQUIRED),
    required("to", "0", fx.SAY_TO_REQUIRED),
    range_rule,
    one_of("channel", fx.CHANNELS, fx.BAD_CHANNEL, fx.SAY_QUERY_CHANNEL),
    one_of("group_by", fx.GROUPINGS, fx.BAD_GROUPING, fx.SAY_GROUPING),
)

# What a missing part of a metrics request reads as.
REQUEST_BLANKS = {"event_name": "", "from": 0, "to": 0, "channel": "", "group_by": ""}


def with_request_errors(requests: DataFrame) -> DataFrame:
    """A table of metrics requests with the list of what is wrong with each."""
    filled = requests.withColumns({c: F.coalesce(F.col(c), F.lit(blank)) for c, blank in REQUEST_BLANKS.items()})
    return filled.withColumn("errors", F.expr(errors_of(REQUEST_RULES)))


def check_request(
    spark: SparkSession, event_name: str, start: int, end: int, channel: str = "", group_by: str = ""
) -> None:
    """The same for one request; raises ``ValueError`` with the list of (field, code, message)."""
    asked = dict(zip(REQUEST_BLANKS, (event_name, start, end, channel, group_by)))
    one = spark.range(1).select(*[F.lit(value).alias(name) for name, value in asked.items()])
    errors = with_request_errors(one).first()["errors"]
    if errors:
        raise ValueError([tuple(e) for e in errors])


def codes_text(errors: Column) -> Column:
    """``field=code,field=code``."""
    return F.array_join(F.transform(errors, lambda x: F.concat(x["field"], F.lit("="), x["code"])), ",")
