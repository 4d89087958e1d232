"""Ids, stored rows, validation rules and their boundaries."""

import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from footfall.functions.json_fields import money_sum, number_at
from footfall.operators.latest import latest_versions
from footfall.operators.commands import to_events, to_rows
from footfall.operators.validate import (
    EVENT_RULES,
    check_request,
    errors_text,
    invalid,
    name_rule,
    short_text,
    valid,
    with_errors,
    with_request_errors,
)

COMMAND = "event_name string, channel string, campaign_id string, user_id string, timestamp bigint, tags array<string>, metadata string"
NOW = 1_700_000_000


def event(name="purchase", channel="web", campaign="c", user="u", timestamp=NOW - 60, tags=("a",), metadata="{}"):
    return (name, channel, campaign, user, timestamp, list(tags) if tags is not None else None, metadata)


def stamped(spark, *rows):
    return to_events(spark.createDataFrame(list(rows), COMMAND), NOW)


def codes(spark, *rows, rules=EVENT_RULES):
    checked = with_errors(stamped(spark, *rows), NOW, rules)
    return [[(e.field, e.code.split(".")[1]) for e in r.errors] for r in checked.select("errors").collect()]


def test_id_is_sha256_of_four_fields(spark):
    row = stamped(spark, event()).first()
    assert row.event_id == hashlib.sha256(f"purchase|u|{NOW - 60}|web".encode()).hexdigest()


def test_id_ignores_campaign_tags_and_metadata(spark):
    ids = stamped(spark, event(), event(campaign="d", tags=("b",), metadata='{"a":1}')).select("event_id").distinct()
    assert ids.count() == 1


@pytest.mark.parametrize("change", [{"name": "x"}, {"user": "x"}, {"timestamp": 5}, {"channel": "api"}])
def test_id_depends_on_each_of_the_four(spark, change):
    assert stamped(spark, event(), event(**change)).select("event_id").distinct().count() == 2


def test_missing_fields_are_blank(spark):
    row = stamped(spark, (None, None, None, None, None, None, None)).first()
    assert row.event_id == hashlib.sha256(b"||0|").hexdigest()
    assert (row.event_name, row.channel, row.campaign_id, row.user_id, row.timestamp) == ("", "", "", "", 0)
    assert (row.tags, row.metadata) == ([], "{}")


@pytest.mark.parametrize(
    "given, kept",
    [('{"b":1,"a":"x"}', '{"a":"x","b":1}'), (None, "{}"), ("nonsense", "{}"), ("[1]", "{}"), (' {"a": 1}', '{"a":1}')],
)
def test_metadata_is_canonical(spark, given, kept):
    assert stamped(spark, event(metadata=given)).first().metadata == kept


def test_stored_row_has_day(spark):
    row = to_rows(stamped(spark, event(timestamp=1704067199))).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_date").cast("string")
    )
    assert tuple(row.first()) == ("2023-12-31 23:59:59", "2023-12-31")


@pytest.mark.parametrize(
    "change, found",
    [
        ({}, []),
        ({"name": ""}, [("event_name", "required")]),
        ({"name": "n" * 100}, []),
        ({"name": "n" * 101}, [("event_name", "max-length")]),
        ({"name": "é" * 50}, []),
        ({"name": "é" * 51}, [("event_name", "max-length")]),
        ({"user": ""}, [("user_id", "required")]),
        ({"user": "u" * 101}, [("user_id", "max-length")]),
        ({"timestamp": 0}, [("timestamp", "required")]),
        ({"timestamp": NOW}, []),
        ({"timestamp": NOW + 1}, [("timestamp", "timestamp-future")]),
        ({"timestamp": NOW - 30 * 86400}, []),
        ({"timestamp": NOW - 30 * 86400 - 1}, [("timestamp", "timestamp-expired")]),
        ({"timestamp": -1}, [("timestamp", "timestamp-expired")]),
        ({"channel": ""}, []),
        ({"channel": "mobile_app"}, []),
        ({"channel": "tv"}, [("channel", "invalid-channel")]),
        ({"tags": ["t"] * 20}, []),
        ({"tags": ["t"] * 21}, [("tags", "max-tags")]),
        ({"tags": ["t" * 101] * 21}, [("tags", "max-tags")]),
        ({"tags": ["t" * 100]}, []),
        ({"tags": ["a", "t" * 101, "t" * 102]}, [("tags[1]", "tag-too-long")]),
        ({"tags": None}, []),
        ({"campaign": "c" * 500}, []),
    ],
)
def test_rules(spark, change, found):
    assert codes(spark, event(**change)) == [found]


def test_all_errors_in_rule_order(spark):
    rows = codes(spark, event(name="", user="", timestamp=0, channel="tv", tags=["t"] * 21))
    assert [field for field, _ in rows[0]] == ["event_name", "user_id", "timestamp", "channel", "tags"]


def test_rules_can_be_chosen_and_added(spark):
    campaign = short_text("campaign_id", "campaign is required", "campaign too long")
    assert codes(spark, event(channel="tv", campaign=""), rules=[name_rule, campaign]) == [[("campaign_id", "required")]]


def test_split_keeps_every_row_once(spark):
    checked = with_errors(stamped(spark, event(), event(name=""), event(channel="tv")), NOW)
    assert (valid(checked).count(), invalid(checked).count()) == (1, 2)


def test_errors_as_text(spark):
    checked = with_errors(stamped(spark, event(name="", channel="tv"), event()), NOW)
    said = [r[0] for r in checked.select(F.expr(errors_text("errors"))).collect()]
    assert said == [
        "event_name: event_name is required; channel: channel must be one of: web, mobile_app, api",
        "validation error",
    ]


REQUEST = "event_name string, from bigint, to bigint, channel string, group_by string"


@pytest.mark.parametrize(
    "asked, fields",
    [
        (("e", 1, 2, "", ""), []),
        (("e", 1, 2, "web", "day"), []),
        (("", 1, 2, "", ""), ["event_name"]),
        (("e", 0, 2, "", ""), ["from"]),
        (("e", 1, 0, "", ""), ["to"]),
        (("e", 2, 2, "", ""), ["to"]),
        (("e", 3, 2, "", ""), ["to"]),
        (("e", 1, 2, "tv", "week"), ["channel", "group_by"]),
        (("", None, None, None, None), ["event_name", "from", "to"]),
    ],
)
def test_metrics_request_rules(spark, asked, fields):
    row = with_request_errors(spark.createDataFrame([asked], REQUEST)).first()
    assert [e.field for e in row.errors] == fields


def test_single_metrics_request_raises(spark):
    check_request(spark, "e", 1, 2)
    with pytest.raises(ValueError, match="validation.invalid-range.error"):
        check_request(spark, "e", 2, 2)


@pytest.mark.parametrize(
    "text, price",
    [
        ('{"price":12.5}', 12.5),
        ('{"price":3}', 3.0),
        ('{"price":"12.5"}', 0.0),
        ('{"price":"NaN"}', 0.0),
        ('{"price":1e400}', 0.0),
        ('{"price":null}', 0.0),
        ('{"price":true}', 0.0),
        ('{"total":5}', 0.0),
        ("{}", 0.0),
        ("broken", 0.0),
    ],
)
def test_price(spark, text, price):
    assert spark.createDataFrame([(text,)], "m string").select(number_at(F.col("m"), "price")).first()[0] == price


def test_money_adds_small_and_huge_amounts(spark):
    rows = spark.createDataFrame([(0.1,)] * 10 + [(1e15,)], "x double")
    assert rows.where("x < 1").agg(money_sum(F.col("x"))).first()[0] == pytest.approx(1.0, rel=1e-14)
    assert rows.agg(money_sum(F.col("x"))).first()[0] == pytest.approx(1e15 + 1.0, rel=1e-15)
    assert rows.where("x < 0").agg(money_sum(F.col("x"))).first()[0] == 0.0
    for amount in (1e-7, 999_999_999_999.5, 1e12, 1_000_000_000_000.5):
        rows = spark.createDataFrame([(amount,)] * 3, "x double")
        assert rows.agg(money_sum(F.col("x"))).first()[0] == pytest.approx(3 * amount, rel=1e-14)


def test_money_adds_up_alike_in_any_order(spark):
    draw = random.Random(3)
    amounts = [1e12, 1e-7, 0.1, 19.99, -5.05, 123456789.01, 3e18, -1e17, 1e15 + 0.5] * 40
    found = set()
    for parts in (1, 3, 7):
        draw.shuffle(amounts)
        rows = spark.createDataFrame([(x,) for x in amounts], "x double").repartition(parts)
        found.add(rows.agg(money_sum(F.col("x"))).first()[0])
        few = rows.where("x < 1e17 AND x > -1e17")
        exact = sum(Decimal(repr(x)) for x in amounts if abs(x) < 1e17)
        assert few.agg(money_sum(F.col("x"))).first()[0] == float(exact)
    assert len(found) == 1
    assert spark.createDataFrame([(1e300,), (1e300,), (None,)], "x double").agg(money_sum(F.col("x"))).first()[0] == 2e300


def test_latest_version_does_not_depend_on_the_order(spark):
    rows = [("e", "n", 1, "{}", c, [t], 5) for c, t in (("c1", "a"), ("c2", "a"), ("c2", "b"))]
    kind = "event_id string, event_name string, timestamp long, metadata string, campaign_id string, tags array<string>, created_at long"
    found = [latest_versions(spark.createDataFrame(x, kind)).collect() for x in (rows, rows[::-1])]
    assert found[0] == found[1] and (found[0][0].campaign_id, found[0][0].tags) == ("c2", ["b"])
