"""The thirteen panels of the business dashboard, all over the 24 hours before ``as_of``.

Panels over the rollup compare the *hour start* with that bound, so the oldest, partly covered hour is left out;
panels over events compare each event's own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.clock import Moment, as_timestamp, hour_of, key_text
from footfall.functions.json_fields import money_sum, number_at
from footfall.functions.sketches import distinct_count, distinct_state, merged_state, total
from footfall.operators.rollup import input_block
from footfall.session import fresh_folder


def last_day(rows: DataFrame, time: str, as_of: Moment) -> DataFrame:
    """Rows from 24 hours before ``as_of`` on, with the day-partition bound spelled out for pruning."""
    since = as_timestamp(as_of) - F.expr("INTERVAL 24 HOURS")
    return rows.where((F.col(time) >= since) & (F.col("event_date") >= F.to_date(since)))


def price() -> Column:
    return number_at(F.col("metadata"), "price")


def _purchases(events: DataFrame, as_of: Moment) -> DataFrame:
    return last_day(events, "ts", as_of).where("event_name = 'purchase'")


def _unique_users() -> Column:
    return distinct_count(merged_state("unique_users_state")).alias("unique_users")


def total_events(hourly: DataFrame, as_of: Moment) -> DataFrame:
    return last_day(hourly, "hour", as_of).agg(total("event_count").alias("total_events"))


def unique_users(hourly: DataFrame, as_of: Moment) -> DataFrame:
    return last_day(hourly, "hour", as_of).agg(_unique_users())


def purchases(hourly: DataFrame, as_of: Moment) -> DataFrame:
    rows = last_day(hourly, "hour", as_of).where("event_name = 'purchase'")
    return rows.agg(total("event_count").alias("purchases"))


def active_campaigns(events: DataFrame, as_of: Moment) -> DataFrame:
    """Exact; the empty campaign counts as one."""
    return last_day(events, "ts", as_of).agg(F.count_distinct("campaign_id").alias("active_campaigns"))


def total_revenue(events: DataFrame, as_of: Moment) -> DataFrame:
    return _purchases(events, as_of).agg(money_sum(price()).alias("total_revenue"))


def avg_order_value(events: DataFrame, as_of: Moment) -> DataFrame:
    """Revenue over *all* purchases; one without a price counts as 0. With no purchases the answer is 0."""
    sums = _purchases(events, as_of).agg(money_sum(price()).alias("revenue"), F.count("*").alias("orders"))
    value = F.when(F.col("orders") > 0, F.col("revenue") / F.col("orders")).otherwise(F.lit(0.0))
    return sums.select(value.alias("avg_order_value"))


def revenue_over_time(events: DataFrame, as_of: Moment) -> DataFrame:
    rows = _purchases(events, as_of).select(hour_of(F.col("ts")).alias("hour"), price().alias("price"))
    by_hour = rows.groupBy("hour").agg(money_sum(F.col("price")).alias("revenue"))
    return by_hour.select(key_text(F.col("hour")).alias("time"), "revenue").orderBy("time")


def events_over_time(hourly: DataFrame, as_of: Moment) -> DataFrame:
    by_hour = last_day(hourly, "hour", as_of).groupBy("hour").agg(total("event_count").alias("events"))
    return by_hour.select(key_text(F.col("hour")).alias("time"), "events").orderBy("time")


def unique_users_over_time(hourly: DataFrame, as_of: Moment) -> DataFrame:
    by_hour = last_day(hourly, "hour", as_of).groupBy("hour").agg(_unique_users())
    return by_hour.select(key_text(F.col("hour")).alias("time"), "unique_users").orderBy("time")


def _most_first(hourly: DataFrame, as_of: Moment, *keys: str) -> DataFrame:
    counted = last_day(hourly, "hour", as_of).groupBy(*keys).agg(total("event_count").alias("count"))
    return counted.orderBy(F.col("count").desc(), *keys)


def events_by_channel(hourly: DataFrame, as_of: Moment) -> DataFrame:
    return _most_first(hourly, as_of, "channel")


def events_by_type(hourly: DataFrame, as_of: Moment) -> DataFrame:
    return _most_first(hourly, as_of, "event_name")


def events_by_type_and_channel(hourly: DataFrame, as_of: Moment) -> DataFrame:
    return _most_first(hourly, as_of, "event_name", "channel")


def top_campaigns(events: DataFrame, as_of: Moment, k: int = 10) -> DataFrame:
    """The k busiest campaigns; ties go to the smaller campaign id.

    User states of a busy campaign are merged in blocks of input partitions before they meet in one task.
    """
    rows = last_day(events, "ts", as_of).select("campaign_id", "user_id", input_block().alias("block"))
    blocks = rows.groupBy("campaign_id", "block").agg(F.count("*").alias("n"), distinct_state("user_id").alias("users"))
    merged = blocks.groupBy("campaign_id").agg(
        F.sum("n").alias("event_count"), distinct_count(merged_state("users")).alias("unique_users")
    )
    return merged.orderBy(F.col("event_count").desc(), "campaign_id").limit(k)


def _rows(rows: DataFrame, panel: str, value: Column | str, *keys: Column) -> DataFrame:
    """(panel, key, second_key, value) rows."""
    keys = [*keys, F.lit(""), F.lit("")][:2]
    value = value if isinstance(value, Column) else F.col(value)
    return rows.select(F.lit(panel).alias("panel"), keys[0].alias("key"), keys[1].alias("second_key"), value.cast("double").alias("value"))


def _all_of(frames: list[DataFrame]) -> DataFrame:
    found = frames[0]
    for more in frames[1:]:
        found = found.unionByName(more)
    return found


def _kept(sums: DataFrame) -> DataFrame:
    folder = fresh_folder(sums.sparkSession, "panels")
    sums.write.parquet(folder)
    return sums.sparkSession.read.schema(sums.schema).parquet(folder)


def refresh(hourly: DataFrame, events: DataFrame, as_of: Moment, k: int = 10) -> DataFrame:
    """All thirteen panels together: (panel, key, second_key, value); the thirteenth has a row for each of its numbers.

    The rollup and the events are each read once: grouping sets give the sums of all panels over a table in one pass.
    They are written down, a few rows for each hour, name, channel and campaign, and the panels pick theirs out of them.
    Values are those of the single panels; where a table has no rows for the day, its panels but the third and fourth
    have none.
    """
    recent = last_day(hourly, "hour", as_of)
    sets = [[], ["hour"], ["channel"], ["event_name"], ["event_name", "channel"]]
    sums = recent.groupingSets(sets, "event_name", "channel", "hour").agg(
        F.grouping_id().alias("of"), total("event_count").alias("events"), distinct_count(merged_state("unique_users_state")).alias("users")
    )
    sums = _kept(sums)
    every, by_hour, by_channel, by_name, by_both = (sums.where(F.col("of") == n) for n in (7, 6, 5, 3, 1))
    hour, none = key_text(F.col("hour")), F.lit(0.0)
    sold = F.sum(F.when(F.col("event_name") == "purchase", F.col("events")))
    found = [
        _rows(every, "b01_total_events", "events"),
        _rows(every, "b02_unique_users", "users"),
        _rows(by_name.agg(F.coalesce(sold, none).alias("events")), "b03_purchases", "events"),
        _rows(by_hour, "b08_events_over_time", "events", hour),
        _rows(by_hour, "b09_unique_users_over_time", "users", hour),
        _rows(by_channel, "b10_events_by_channel", "events", F.col("channel")),
        _rows(by_name, "b11_events_by_type", "events", F.col("event_name")),
        _rows(by_both, "b12_events_by_type_channel", "events", F.col("event_name"), F.col("channel")),
    ]

    is_sold = F.col("event_name") == "purchase"
    each = last_day(events, "ts", as_of).select(
        "campaign_id", "user_id", input_block().alias("block"), is_sold.alias("sold"), F.when(is_sold, hour_of(F.col("ts"))).alias("hour"), F.when(is_sold, price()).alias("price")
    )
    # Of the campaigns' rows user states are kept by blocks of input partitions, as for the panel alone.
    sums = each.groupingSets([[], ["hour"], ["campaign_id", "block"]], "campaign_id", "block", "hour").agg(
        F.grouping_id().alias("of"), F.count("*").alias("n"), F.count_if("sold").alias("orders"), money_sum(F.col("price")).alias("revenue"), distinct_state("user_id").alias("state")
    )
    sums = _kept(sums)
    every, by_hour = sums.where("of = 7"), sums.where("of = 6 AND hour IS NOT NULL")
    campaigns = sums.where("of = 1").groupBy("campaign_id").agg(F.sum("n").alias("n"), distinct_count(merged_state("state")).alias("users"))
    top = campaigns.orderBy(F.col("n").desc(), "campaign_id").limit(k)
    name, average = F.col("campaign_id"), F.when(F.col("orders") > 0, F.col("revenue") / F.col("orders")).otherwise(none)
    found += [
        _rows(campaigns.agg(F.count("campaign_id").alias("n")), "b04_active_campaigns", "n"),
        _rows(every, "b05_total_revenue", "revenue"),
        _rows(every, "b06_avg_order_value", average),
        _rows(by_hour, "b07_revenue_over_time", "revenue", hour),
        _rows(top, "b13_top_campaigns", "n", name, F.lit("event_count")),
        _rows(top, "b13_top_campaigns", "users", name, F.lit("unique_users")),
    ]
    return _all_of(found)
