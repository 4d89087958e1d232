"""What every packing of token ids into sequences shares: ranks of equal lengths, and pieces placed by a plan.

A document longer than a sequence fills whole sequences first; what is left has one of fewer lengths than a sequence has
tokens. How many documents leave which length is all that a plan needs, so it is made on the driver from a table of at
most ``capacity`` rows whatever the size of the corpus, and says for ranges of ranks which sequence they go to.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.tables import saved
from footfall.llm.tokens import tokenized

_BUCKET = 100_000


@dataclass
class Placed:
    """Documents that leave ``left`` tokens, ranks low to high (excluded): where ``length`` of them from ``cut`` on go.

    The k-th of them, counted from ``before``, goes to sequence ``first + k // each`` at ``offset + (k % each) * length``.
    """

    left: int
    low: int
    high: int
    cut: int
    length: int
    first: int
    each: int
    before: int
    offset: int


class Stock:
    """How many pieces of each length are still to be placed, and of which documents they are."""

    def __init__(self, counts: dict[int, int]):
        self.count = dict(counts)
        self._queues = {n: deque([(n, 0, c, 0)]) for n, c in counts.items()}

    def take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(left, low, high, cut) of the next n pieces of this length."""
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
        queue = self._queues[length]
        while n:
            left, low, high, cut = queue.popleft()
            if high - low > n:
                queue.appendleft((left, low + n, high, cut))
                high = low + n
            n -= high - low
            yield left, low, high, cut

    def put(self, length: int, part: tuple[int, int, int, int]) -> None:
        self.count[length] = self.count.get(length, 0) + part[2] - part[1]
        self._queues.setdefault(length, deque()).append(part)

    def place(self, length: int, sequences: int, first: int, each: int, offset: int, used: int | None = None) -> list[Placed]:
        """``each`` pieces of ``length`` in every sequence from ``first`` on; of ``used`` tokens, if fewer, each is cut."""
        out, before = [], 0
        for left, low, high, cut in list(self.take(length, sequences * each)):
            out.append(Placed(left, low, high, cut, used or length, first, each, before, offset))
            if used and used < length:
                self.put(length - used, (left, low, high, cut + used))
            before += high - low
        return out


def packed(docs: DataFrame, id_col: str, text_col: str, capacity: int, plan: Callable[[dict[int, int], int], tuple[list[Placed], int]], path: str | None = None, end: int = 0) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset, size) for each piece of each document.

    ``ids`` are the piece's ids as little-endian bytes, ``size`` bytes each. Ranks are counted inside buckets of about
    100,000 documents and moved up by what the buckets before hold, so equal lengths never meet in one task.
    """
    spark = docs.sparkSession
    known = saved(tokenized(docs, id_col, text_col, path, end).withColumn("uid", F.monotonically_increasing_id()), "tokens", "zstd")
    buckets = max(1, math.ceil(known.count() / _BUCKET))
    rows = known.select("uid", "n", (F.col("n") % capacity).cast("int").alias("left"), F.floor(F.col("n") / capacity).alias("full"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    in_order = Window.partitionBy("bucket").orderBy("uid")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "left").orderBy("uid")) - 1)
    rows = saved(rows.withColumn("filled", F.sum("full").over(in_order) - F.col("full")), "ranks")

    lengths = rows.groupBy("bucket", "left").agg(F.count("*").alias("n"), F.sum("full").alias("full"))
    lengths = saved(lengths, "lengths")
    counts = {r["left"]: r["n"] for r in lengths.where("left > 0").groupBy("left").agg(F.sum("n").alias("n")).collect()}
    places, sequences = plan(counts, capacity)
    before = Window.partitionBy("left").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lengths_before = lengths.select("bucket", "left", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
    totals = lengths.groupBy("bucket").agg(F.sum("full").alias("full"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("bucket", F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("filled_before"))

    ranked = rows.join(lengths_before, ["bucket", "left"]).join(totals, "bucket")
    ranked = ranked.select("uid", "left", "full", (F.col("rank") + F.col("rank_before")).alias("rank"), (F.col("filled") + F.col("filled_before") + sequences).alias("first_full"))
    kind = "left int, low long, high long, cut int, length int, first long, each int, before long, offset int"
    table = spark.createDataFrame([tuple(vars(x).values()) for x in places], kind).withColumnRenamed("left", "of")
    met = ranked.join(F.broadcast(table), (F.col("left") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    k = F.col("before") + F.col("rank") - F.col("low")
    sequence = F.col("first") + F.floor(k / F.col("each"))
    offset = F.col("offset") + (k % F.col("each")) * F.col("length")
    piece = F.when(F.col("of").isNotNull(), F.struct((F.col("full") * capacity + F.col("cut")).alias("start"), F.col("length").cast("long").alias("length"), sequence.cast("long").alias("sequence"), offset.cast("long").alias("offset")))
    of_doc = met.groupBy("uid", "full", "first_full").agg(F.collect_list(piece).alias("pieces"))
    whole = F.transform(F.sequence(F.lit(0), F.col("full") - 1), lambda n: F.struct((n * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.col("first_full") + n).alias("sequence"), F.lit(0).cast("long").alias("offset")))
    every = F.concat(F.when(F.col("full") > 0, whole).otherwise(F.array().cast("array<struct<start:long,length:long,sequence:long,offset:long>>")), "pieces")
    # Cut inside the array: exploding first would copy a long document's ids once for each of its pieces.
    cut = F.transform(every, lambda x: F.struct(x.start, x.length, F.col("ids").substr((x.start * F.col("size") + 1).cast("int"), (x.length * F.col("size")).cast("int")).alias("ids"), x.sequence.alias("sequence_id"), x.offset))
    parts = known.join(of_doc, "uid").select("id", "n", "size", F.inline(cut))
    return parts.select("id", "start", "length", "ids", F.col("n").alias("doc_tokens"), "sequence_id", "offset", "size")


def wide(ids: str, size: str) -> Column:
    """The ids as little-endian unsigned 32-bit numbers. In SQL: it follows a sort of whole documents, beside which Python
    workers would need room for further batches."""
    return F.expr(f"if({size} = 4, {ids}, unhex(regexp_replace(hex({ids}), '(.{{4}})', '$10000')))")
