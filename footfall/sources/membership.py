"""Which ids a stored day may hold: a Bloom filter per day, in pieces that merge, asked before any event is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.latest import latest_versions
from footfall.session import fresh_folder
from footfall.sources.tables import Tables

PIECES = "piece bigint, bits binary, event_date date, batch_id string"
BY_DAY = ["event_date", "batch_id"]

#: Bits of one piece, as the built-in bitmap aggregates have them.
PIECE_BITS = 32768
HASHES = 4


class StoredIds:
    """A filter of ``pieces`` times 32,768 bits for each stored day and batch; pieces that no id falls into are not stored.

    An id falls into one piece of its day and sets four bits there, so asking is one join on (day, piece) and filters of
    batches merge by OR. ``pieces`` is fixed for a root: with one piece for 2,048 ids that a day gets, one new id in
    400 is taken for one that may be there. Too few pieces cost reading, never a wrong answer.
    """

    def __init__(self, spark: SparkSession, source: Tables, root: str, pieces: int = 1 << 15):
        self.spark, self.source, self.root, self.pieces = spark, source, root.rstrip("/"), pieces

    def create(self) -> StoredIds:
        path, files = self.source._files(self.root)
        files.mkdirs(path)
        return self

    def _piece(self) -> Column:
        return F.pmod(F.xxhash64("event_id"), F.lit(self.pieces))

    def read(self) -> DataFrame:
        return self.spark.read.schema(PIECES).parquet(self.root)

    def add(self, batch_id: str) -> None:
        """Take in a stored batch; adding it again replaces its filters."""
        ids = self.source.events().where(F.col("batch_id") == batch_id)
        found = ids.select("event_date", self._piece().alias("piece"), F.explode(F.array(*_places())).alias("place"))
        bits = found.groupBy("event_date", "piece").agg(F.bitmap_construct_agg("place").alias("bits"))
        rows = bits.withColumn("batch_id", F.lit(batch_id)).hint("rebalance", "event_date")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BY_DAY).parquet(self.root)

    def merge_into(self, target: StoredIds, name: str) -> None:
        """Write one filter per day to another root; batches stored there under other names are not covered by it."""
        if target.pieces != self.pieces:
            raise ValueError("filters merge with filters of as many pieces")
        merged = self.read().groupBy("event_date", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
        rows = merged.withColumn("batch_id", F.lit(name)).hint("rebalance", "event_date")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BY_DAY).parquet(target.root)

    def unread(self) -> DataFrame:
        """(event_date, batch_id) of the stored batches without filters: their days may hold any id."""
        return self.source.events().select(*BY_DAY).distinct().join(self.read().select(*BY_DAY).distinct(), BY_DAY, "left_anti")

    def maybe_stored(self, events: DataFrame) -> DataFrame:
        """``events`` with ``maybe``: false if its day holds its id for certain not."""
        merged = self.read().groupBy("event_date", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
        merged = merged.select(F.col("event_date").alias("_day"), F.col("piece").alias("_piece"), F.col("bits").alias("_bits"))
        asked = events.withColumn("_asked", self._piece())
        same = (F.col("event_date") == F.col("_day")) & (F.col("_asked") == F.col("_piece"))
        unread = self.unread().select(F.col("event_date").alias("_open")).distinct()
        held = F.forall(F.array(*_places()), lambda place: _bit(F.col("_bits"), place))
        maybe = F.col("_open").isNotNull() | F.coalesce(held, F.lit(False))
        joined = asked.join(merged, same, "left").join(unread, F.col("event_date") == F.col("_open"), "left")
        return joined.withColumn("maybe", maybe).drop("_asked", "_day", "_piece", "_bits", "_open")

    def unseen(self, events: DataFrame) -> DataFrame:
        """Strict intake, as ``latest.unseen``: only the days that may hold an id are read, and decide.

        Of two versions in ``events`` the latest counts. What passes the filters is written down, as it is read twice.
        """
        folder = fresh_folder(self.spark, "asked")
        asked = self.maybe_stored(latest_versions(events))
        asked.write.partitionBy("maybe").parquet(folder)
        asked = self.spark.read.schema(asked.schema).parquet(folder)
        doubtful = asked.where("maybe")
        known = self.days(doubtful).select("event_date", "event_id")
        new = doubtful.join(known, ["event_date", "event_id"], "left_anti").select(*asked.columns)
        return asked.where("NOT maybe").unionByName(new).drop("maybe")

    def days(self, doubtful: DataFrame) -> DataFrame:
        """The stored events of the days of some rows; other days are not listed among the files to read."""
        dates = [r[0] for r in doubtful.select("event_date").distinct().collect()]  # one value per day
        return self.source.events().where(F.col("event_date").isin([F.lit(d) for d in dates]))


def _places() -> list[Column]:
    """Four places within the piece, fifteen bits each of one hash apart from that of the piece."""
    hashed = F.xxhash64(F.lit(1), F.col("event_id"))
    return [F.shiftrightunsigned(hashed, 15 * i).bitwiseAND(F.lit(PIECE_BITS - 1)) for i in range(HASHES)]


def _bit(bits: Column, place: Column) -> Column:
    """Whether a bit is set; places count from the lowest bit of each byte."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1
