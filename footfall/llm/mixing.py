"""Mixing sources to target weights: how often each document is taken, by its source's repetition rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.tables import saved

WORD = r"[^\x20\x09-\x0D]+"
_HEX = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """(source, n): the distinct sources by code point from 0 on, null last.

    They are sorted in ranges; what a range's sources are moved up by is the number of sources in the ranges before.
    """
    placed = sources.select("source").repartitionByRange(F.col("source").asc_nulls_last())
    placed = placed.sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    placed = saved(placed.select("source", F.shiftright("place", 33).alias("range"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("within")), "sources")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("range").agg(F.count("*").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(ranges, "range").select("source", (F.col("before") + F.col("within")).alias("n"))


def shares(sources: DataFrame, cap: int = 3) -> DataFrame:
    """Each source's share of the summed sizes: (source, source_size, weight, target) of (source, source_size, weight).

    Targets are in proportion to the weights; one above ``cap`` times its source's size stops there and the excess is
    shared anew by weight. The price of a unit of weight only rises from round to round, so a source that stops has
    stopped for good, and rounds end when no further one does. The driver sees two sums a round.
    """
    sources = saved(sources, "weights")
    limit = F.col("source_size") * cap
    price = 0.0
    while True:
        stopped = F.col("weight") * F.lit(price) > limit
        total = F.sum("source_size") - F.sum(F.when(stopped, limit).otherwise(0))
        row = sources.agg(total.alias("size"), F.sum(F.when(stopped, 0).otherwise(F.col("weight"))).alias("weight")).first()
        new = row["size"] / row["weight"] if row["weight"] else price
        if new == price:
            break
        price = new
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(price), limit.cast("double")))


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id, the whole text and the seed alone."""
    parts = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    digest = F.md5(parts.cast("binary"))
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") / F.lit(float(16**_HEX))


def with_copies(rows: DataFrame, targets: DataFrame, draw: Column, source_col: str) -> DataFrame:
    """The rows with ``source_size``, ``target`` and ``copies``: floor(rate) and one more with the chance of the rest."""
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rows = rows.join(targets, F.col(source_col).eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    more = draw < rate - F.floor(rate)
    return rows.withColumn("copies", F.floor(rate) + F.when(more, 1).otherwise(0))


def plan_mix(docs: DataFrame, weights: DataFrame, id_col: str, text_col: str, source_col: str, cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sized rows, targets): (id, source, size, draw) for each document, and the target of each source.

    ``weights`` is (source, weight); a source that it does not name weighs 0.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), chance(F.col(id_col), F.col(text_col), seed).alias("draw"))
    sized = saved(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = weights.select(F.col("source").alias("_source"), "weight")
    sources = sources.join(weights, F.col("source").eqNullSafe(F.col("_source")), "left")
    return sized, saved(shares(sources.select("source", "source_size", F.coalesce("weight", F.lit(0)).alias("weight")), cap), "targets")


def mix_report(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, seed: int = 20240229) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each document: what the mix takes of it, in words.

    A source's rate is its target by its size. Each of its documents is taken floor(rate) times, and once more if a
    number drawn from its id, its text and the seed is below the fraction, so reruns agree and a source comes near its target;
    at most ``cap`` times in all.

    A null text has size 0. Null is a source like any other. Rows without id, or with the same one, are
    drawn by their texts; only rows equal in id and text share a draw. Where all sizes of a source are 0 nothing is taken; an empty table gives no rows.
    """
    sized, targets = plan_mix(docs, weights, id_col, text_col, source_col, cap, seed)
    return with_copies(sized, targets, F.col("draw"), "source").drop("draw").withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, seed: int = 20240229) -> DataFrame:
    """The documents themselves, each row as often as ``mix_report`` says, with their own columns."""
    _, targets = plan_mix(docs, weights, id_col, text_col, source_col, cap, seed)
    names = [f"c{n}" for n in range(len(docs.columns))]
    place = dict(zip(docs.columns, names))
    draw = chance(F.col(place[id_col]), F.col(place[text_col]), seed)
    rows = with_copies(docs.toDF(*names), targets, draw, place[source_col])
    rows = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*names).toDF(*docs.columns)


def turns(docs: DataFrame, source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): the sources in order of code point, null last, weigh as ``weights`` says, over and over."""
    order = numbered(docs.select(F.col(source_col).alias("source")).distinct())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    return order.select("source", weight.alias("weight"))
