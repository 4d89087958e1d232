"""Stored events along a space-filling curve over name, user and time, so that filters on any of them skip row groups.

The plain order leads with the name: a user's rows lie in every name's stretch. On the curve a row group spans a small
range of each of the three, and the min/max that Parquet keeps of each tells which groups a filter can skip.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.fixed import MAX_ROWS_PER_FILE
from footfall.operators.latest import latest_versions
from footfall.sources.tables import PARTS, SCHEMAS, Tables

#: Bits of the curve for each of the three.
BITS = 8
SAMPLE = 16 << BITS


def cut_points(rows: DataFrame, column: str) -> list[str]:
    """At most 255 values that cut the distinct values of a column into ranges of about the same number of values.

    They come from the 4,096 values least by hash, a fixed number whatever the data; they decide where rows lie, never
    what a query answers.
    """
    some = rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.xxhash64(column), column).limit(SAMPLE)
    found = sorted(r[0] for r in some.collect())  # SAMPLE values at most
    return sorted({found[len(found) * i >> BITS] for i in range(1, 1 << BITS)}) if found else []


def _range(value: Column, cuts: list[str]) -> Column:
    """How many cut points are not above the value, by halving; null is 0."""
    if not cuts:
        return F.lit(0)
    points = F.array(*[F.lit(c) for c in cuts])

    def step(at: Column, width: Column) -> Column:
        ahead = at + width
        return F.when((ahead <= len(cuts)) & (F.get(points, ahead - 1) <= value), ahead).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(BITS))]), F.lit(0), step)


def _spread(name: str, cuts: list[str]) -> Column:
    """The range of a value, with few ranges spread over all bits: the highest bits come first on the curve."""
    return F.floor(_range(F.col(name), cuts) * (1 << BITS) / (len(cuts) + 1)).cast("int")


def _time_of_day(ts: Column) -> Column:
    return F.floor(F.pmod(F.unix_seconds(ts), F.lit(86400)) * (1 << BITS) / 86400).cast("int")


def curve(parts: list[Column]) -> Column:
    """The place on the Z-curve: the bits of the parts in turns, the highest first."""
    found = [
        F.shiftleft(F.shiftright(part, bit).bitwiseAND(F.lit(1)), len(parts) * bit + len(parts) - 1 - n)
        for bit in range(BITS)
        for n, part in enumerate(parts)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), found)


def write_by_curve(tables: Tables, rows: DataFrame, batch_id: str, rows_per_group: int = 100_000) -> None:
    """Write events as ``Tables.write_events`` does, in the order of the curve within each day.

    Ranges of (day, place, id) go to tasks, so a place that holds most of a day's rows is split by id.
    """
    names = [c for c in SCHEMAS["events"].fieldNames() if c != "batch_id"]
    place = curve([*(_spread(x, cut_points(rows, x)) for x in ("event_name", "user_id")), _time_of_day(F.col("ts"))])
    placed = rows.select(*names).withColumns({"_place": place, "batch_id": F.lit(batch_id)})
    spread = placed.repartitionByRange("event_date", "_place", "event_id").sortWithinPartitions("event_date", "batch_id", "_place", "event_id").drop("_place")
    (
        spread.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .option("parquet.block.row.count.limit", rows_per_group)
        .partitionBy(*PARTS["events"])
        .parquet(tables.path("events"))
    )


def merge_by_curve_into(source: Tables, target: Tables, name: str, dates: list[str] | None = None, rows_per_group: int = 100_000) -> None:
    """Write the latest version of each event of the given days (all by default) along the curve to another root."""
    write_by_curve(source._other(target), latest_versions(source._days("events", dates)), name, rows_per_group)
