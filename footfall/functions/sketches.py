"""Mergeable distinct counts (theta sketches, a built-in Spark aggregate)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.fixed import SKETCH_LOG_ENTRIES


# The sketch passes over empty texts, which count as a value here; they go in under this name.
EMPTY = "\0(empty)"


def distinct_state(name: str) -> Column:
    value = F.when(F.col(name) == "", F.lit(EMPTY)).otherwise(F.col(name))
    return F.theta_sketch_agg(value, SKETCH_LOG_ENTRIES)


def merged_state(state: Column | str) -> Column:
    return F.theta_union_agg(state, SKETCH_LOG_ENTRIES)


def distinct_count(state: Column) -> Column:
    """The count held in a state; no state at all counts as 0."""
    return F.coalesce(F.theta_sketch_estimate(state), F.lit(0)).cast("bigint")


def total(count: Column | str) -> Column:
    """A sum that is 0, not NULL, over no rows."""
    return F.coalesce(F.sum(count), F.lit(0)).cast("bigint")
