"""A tree of merged rollup states over spans of time, and the few spans that cover a range of hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.sketches import distinct_count, merged_state, total

#: Spans of a day in hours; each length divides the next, and spans start at multiples of their length.
IN_A_DAY = [1, 2, 4, 8, 24]
DAY = len(IN_A_DAY) - 1


def lengths(days: int = 64) -> list[int]:
    """The lengths of spans in hours: parts of a day, a day, and its doublings up to ``days``."""
    found = list(IN_A_DAY)
    while found[-1] * 2 <= days * 24:
        found.append(found[-1] * 2)
    return found


def hour_number(hour: Column) -> Column:
    return F.floor(F.unix_seconds(hour) / 3600)


KEYS = ["event_name", "channel", "day", "level", "start"]


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(
        total("event_count").alias("event_count"), merged_state("unique_users_state").alias("unique_users_state")
    )


def _levels(sizes: list[int], first: int) -> Column:
    """The spans of each length that a row's hour lies in."""
    found = [F.struct(F.lit(k).alias("level"), (F.col("hour") - F.col("hour") % n).alias("start")) for k, n in enumerate(sizes, first)]
    return F.explode(F.array(*found)).alias("span")


def tree(hourly: DataFrame, days: int = 64) -> DataFrame:
    """(level, start, event_name, channel, event_count, unique_users, unique_users_state) for each span with events.

    ``start`` counts hours from 1970 on, ``level`` is the place of the span's length among ``lengths(days)``, and a
    row without channel holds all channels of its name together. Partial rows of a name, channel and day are sent once:
    all spans within the day are merged where they lie. The spans of several days are merged out of those of single
    days, a twenty-fourth of the hours. So all levels take little more than one pass over the rollup.
    """
    channels = F.explode(F.array(F.col("channel"), F.lit(None).cast("string"))).alias("channel")
    hour = hour_number(F.col("hour"))
    rows = hourly.select("event_name", channels, hour.alias("hour"), "event_count", "unique_users_state")
    rows = rows.withColumns({"day": F.floor(F.col("hour") / 24), "level": F.lit(0), "start": F.col("hour")})
    hours = _merged(rows.repartition("event_name", "channel", "day"))  # what follows of a day needs no further exchange
    state = ["event_count", "unique_users_state"]
    hours = hours.select("event_name", "channel", "day", F.col("start").alias("hour"), *state)
    within = _merged(hours.select("event_name", "channel", "day", _levels(IN_A_DAY, 0), *state).select("event_name", "channel", "day", "span.*", *state))
    found = within
    if len(lengths(days)) > DAY + 1:
        single = within.where(F.col("level") == DAY).select("event_name", "channel", F.col("start").alias("hour"), *state)
        longer = single.select("event_name", "channel", _levels(lengths(days)[DAY + 1 :], DAY + 1), *state)
        found = found.unionByName(_merged(longer.select("event_name", "channel", F.lit(None).cast("bigint").alias("day"), "span.*", *state)))
    users = distinct_count(F.col("unique_users_state")).alias("unique_users")
    return found.select("level", "start", "event_name", "channel", "event_count", users, "unique_users_state")


def write_tree(hourly: DataFrame, folder: str, days: int = 64) -> None:
    """Keep the tree as Parquet by level, for tables that are asked far more often than they grow."""
    tree(hourly, days).write.partitionBy("level").mode("overwrite").parquet(folder)


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


NONE = "CAST(array() AS array<struct<level:int,start:bigint>>)"


def cover(first: str, after: str, days: int = 64, top: int | None = None) -> str:
    """The spans that make up the hours from ``first`` to before ``after``, as (level, start), none above level ``top``.

    An expression in SQL. From the shortest length on, spans fill both ends up to where a longer one can start and stop,
    so a range of n days takes at most ten spans within days and two of each doubling, and one for every ``days`` days
    beyond.
    """
    sizes = lengths(days) if top is None else lengths(days)[: top + 1]
    steps = ", ".join(f"named_struct('level', {k}, 'size', {n}L, 'next', {sizes[min(k + 1, len(sizes) - 1)]}L)" for k, n in enumerate(sizes))
    up, down = "(s.a + x.next - 1 - pmod(s.a - 1, x.next))", "(s.b - pmod(s.b, x.next))"
    on = f"(x.level < {len(sizes) - 1} AND {up} <= {down})"

    def spans(low: str, high: str) -> str:
        each = f"transform(sequence({low}, {high} - x.size, x.size), p -> named_struct('level', x.level, 'start', p))"
        return f"if({low} < {high}, {each}, {NONE})"

    found = f"if({on}, concat({spans('s.a', up)}, {spans(down, 's.b')}), {spans('s.a', 's.b')})"
    step = f"(s, x) -> named_struct('a', if({on}, {up}, s.b), 'b', if({on}, {down}, s.b), 'found', concat(s.found, {found}))"
    start = f"named_struct('a', CAST({first} AS bigint), 'b', CAST({after} AS bigint), 'found', {NONE})"
    return f"aggregate(array({steps}), {start}, {step}).found"
