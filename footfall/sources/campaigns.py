"""Campaigns by hour without their events: exact distinct counts from bitmaps, the busiest from short lists.

Both are kept for each stored batch and merge with those of other batches, so a panel over a day reads a few kilobytes
an hour. Events are read only for the hour that a day cuts, for batches without states, and for the candidates of a top list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.functions.clock import Moment, as_timestamp, hour_of
from footfall.plans.dashboard import last_day, top_campaigns
from footfall.session import fresh_folder
from footfall.sources.tables import Tables

NAMES = "campaign_id string, number bigint"
BITS = "hour timestamp, bucket bigint, bits binary, event_date date, batch_id string"
LISTS = "hour timestamp, campaign_id string, event_count bigint, rest bigint, event_date date, batch_id string"
BY_DAY = ["event_date", "batch_id"]


class CampaignStates:
    """``names`` numbers the campaigns from 1 on; ``bits`` holds which of them an hour saw; ``lists`` the ``length`` busiest.

    Every row of a list carries ``rest``, the largest count the list left out (0 if none), from which follows how much
    any campaign can have at most. The empty campaign is one like others. Rows without a campaign have no number, but
    they are counted in lists, as the panels do. One job at a time may add batches.
    """

    def __init__(self, spark: SparkSession, source: Tables, root: str, length: int = 1000):
        self.spark, self.source, self.root, self.length = spark, source, root.rstrip("/"), length

    def create(self) -> CampaignStates:
        for name in ("names", "bits", "lists"):
            path, files = self.source._files(f"{self.root}/{name}")
            files.mkdirs(path)
        return self

    def _read(self, name: str, shape: str) -> DataFrame:
        return self.spark.read.schema(shape).parquet(f"{self.root}/{name}")

    def names(self) -> DataFrame:
        return self._read("names", NAMES)

    # Adding -----------------------------------------------------------------------------------------------

    def add(self, batch_id: str) -> None:
        """Take in a stored batch. Adding it again replaces its states and gives no name a second number."""
        rows = self.source.events().where(F.col("batch_id") == batch_id)
        counted = rows.groupBy(hour_of(F.col("ts")).alias("hour"), "campaign_id").agg(F.count("*").alias("event_count"))
        folder = fresh_folder(self.spark, "campaigns")
        counted.write.parquet(f"{folder}/counts")
        counted = self.spark.read.schema(counted.schema).parquet(f"{folder}/counts")
        self._number(counted, folder)
        self._write(_bits(counted.join(self.names(), "campaign_id"), "hour"), "bits", batch_id)

        busiest = Window.partitionBy("hour").orderBy(F.col("event_count").desc(), "campaign_id")
        ranked = counted.withColumn("rank", F.row_number().over(busiest)).where(F.col("rank") <= self.length + 1)
        left_out = F.when(F.col("rank") > self.length, F.col("event_count"))
        rest = F.coalesce(F.max(left_out).over(Window.partitionBy("hour")), F.lit(0))
        lists = ranked.withColumn("rest", rest).where(F.col("rank") <= self.length).drop("rank")
        # Written last: a batch counts as taken in once its lists are there.
        self._write(lists, "lists", batch_id)

    def _number(self, counted: DataFrame, folder: str) -> None:
        """Numbers for names that have none: each partition counts on from where the ones before it end."""
        new = counted.where("campaign_id IS NOT NULL").select("campaign_id").distinct().join(self.names(), "campaign_id", "left_anti")
        new.withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/new")
        new = self.spark.read.schema("campaign_id string, part int").parquet(f"{folder}/new")
        first = self.names().agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        starts = []
        for part, n in sorted(tuple(r) for r in new.groupBy("part").count().collect()):  # one row per task
            starts.append((part, first))
            first += n
        if starts:
            place = F.row_number().over(Window.partitionBy("part").orderBy("campaign_id"))
            placed = new.join(self.spark.createDataFrame(starts, "part int, start bigint"), "part")
            placed.select("campaign_id", (F.col("start") + place).alias("number")).write.mode("append").parquet(f"{self.root}/names")

    def _write(self, rows: DataFrame, name: str, batch_id: str) -> None:
        rows = rows.withColumns({"event_date": F.to_date("hour"), "batch_id": F.lit(batch_id)}).hint("rebalance", "event_date")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BY_DAY).parquet(f"{self.root}/{name}")

    # Reading ----------------------------------------------------------------------------------------------

    def _day(self, as_of: Moment) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(bits of the whole hours of the day, lists of these, events that no state covers)."""
        events = last_day(self.source.events(), "ts", as_of)
        since = as_timestamp(as_of) - F.expr("INTERVAL 24 HOURS")
        lists = self._read("lists", LISTS)
        taken = lists.where(F.col("event_date") >= F.to_date(since)).select(*BY_DAY).distinct()
        cut_hour = events.where(F.col("ts") < F.date_trunc("hour", since) + F.expr("INTERVAL 1 HOUR")).where(hour_of(F.col("ts")) < since)
        rest = events.join(taken, BY_DAY, "left_anti").where(hour_of(F.col("ts")) >= since)
        bits = last_day(self._read("bits", BITS), "hour", as_of).join(taken, BY_DAY, "left_semi")
        return bits, last_day(lists, "hour", as_of), cut_hour.unionByName(rest)

    def active_campaigns(self, as_of: Moment) -> DataFrame:
        """The panel of the same name, exact, from the bitmaps."""
        bits, _, rest = self._day(as_of)
        named = rest.where("campaign_id IS NOT NULL").select("campaign_id").distinct().join(self.names(), "campaign_id", "left")
        seen = bits.select("bucket", "bits").unionByName(_bits(named.where("number IS NOT NULL")).select("bucket", "bits"))
        known = seen.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).agg(F.sum("n").alias("n"))
        unknown = named.where("number IS NULL").agg(F.count("*").alias("n"))
        return known.unionByName(unknown).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("active_campaigns"))

    def candidates(self, as_of: Moment, k: int = 10) -> DataFrame | None:
        """The campaigns that can be among the k busiest, or None if one that no list names might be.

        A campaign has at least the counts its lists give, and at most these plus the ``rest`` of every list that leaves
        it out. The k-th highest least count is a bound: who cannot reach it is not among the k. A campaign in no list can
        have the sum of all rests at most; if that reaches the bound the lists do not settle the matter.
        """
        _, lists, rest = self._day(as_of)
        folder = fresh_folder(self.spark, "candidates")
        lists.groupBy("hour", "batch_id").agg(F.max("rest").alias("rest")).agg(F.coalesce(F.sum("rest"), F.lit(0)).alias("rest")).write.parquet(f"{folder}/rest")
        unnamed = self.spark.read.parquet(f"{folder}/rest").first()[0]
        counted = rest.groupBy("campaign_id").agg(F.count("*").alias("event_count")).withColumn("rest", F.lit(0).cast("bigint"))
        listed = lists.select("campaign_id", "event_count", "rest").unionByName(counted)
        least = listed.groupBy("campaign_id").agg(F.sum("event_count").alias("least"), F.sum("rest").alias("named"))
        least.write.parquet(f"{folder}/least")
        least = self.spark.read.schema(least.schema).parquet(f"{folder}/least")
        best = least.orderBy(F.col("least").desc()).select("least").limit(k).agg(F.count("*").alias("n"), F.min("least").alias("bound")).first()
        bound = best["bound"] if best["n"] == k else 0
        if unnamed and unnamed >= bound:
            return None
        return least.where(F.col("least") + unnamed - F.col("named") >= bound).select("campaign_id")

    def top_campaigns(self, as_of: Moment, k: int = 10) -> DataFrame:
        """The panel of the same name: lists say who can be in it, events settle the order and count users."""
        events, found = self.source.events(), self.candidates(as_of, k)
        if found is not None:
            found = found.withColumnRenamed("campaign_id", "candidate")
            events = events.join(found, F.col("campaign_id").eqNullSafe(F.col("candidate")), "left_semi")
        return top_campaigns(events, as_of, k)


def _bits(numbered: DataFrame, *keys: str) -> DataFrame:
    """The numbers as bits, 32,768 to a bucket."""
    bucket, position = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    return numbered.groupBy(*keys, bucket.alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bits"))
