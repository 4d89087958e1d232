"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.tables import saved


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _round(links: DataFrame) -> DataFrame:
    """One large star and one small star. No node's neighbours are ever gathered: each link meets a minimum."""
    ways = _both_ways(links)
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    large = large.where("a != b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("least"))
    small = large.join(low, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
    return small.where("a != b").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) but the roots; a root is the smallest node of its component.

    Links may repeat, point either way or at themselves. Each round is written out, and the driver sees one count and
    one checksum of it. The number of rounds grows with the logarithm of the longest path.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    links = saved(links, "links")
    before, now = None, _state(links)
    while now != before and now[0]:
        links = saved(_round(links), "links")
        before, now = now, _state(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
