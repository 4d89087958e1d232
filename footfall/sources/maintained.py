"""The latest version of each event, kept up to date as batches come: a merged base, and what is not merged yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.schema import EVENTS
from footfall.operators.latest import latest_versions
from footfall.sources.tables import Tables

#: Which batches of a day a merge has taken in; written last, so a merge counts once this names it.
TAKEN = T.StructType([T.StructField("event_date", T.DateType()), T.StructField("batch_id", T.StringType()), T.StructField("merge", T.LongType())])

SMALL = 64 << 20
COLUMNS = [c for c in EVENTS.fieldNames() if c != "batch_id"]


class LatestEvents:
    """``source`` holds the events as they were stored; ``root`` the merged base and the batches it has taken in.

    A merge writes the days it touches once more, under a number of its own, and leaves all other days alone. Reading
    takes the last merge of each day and adds the batches that no merge has seen: only days with such batches are sorted
    by version, and of those only the base and the new batches, not what was merged before.
    """

    def __init__(self, spark: SparkSession, source: Tables, root: str):
        self.spark, self.source = spark, source
        self.base = Tables(spark, root)

    def create(self) -> LatestEvents:
        self.base.create()
        path, files = self.base._files(self.base.path("taken"))
        files.mkdirs(path)
        return self

    def _taken(self) -> DataFrame:
        return self.spark.read.schema(TAKEN).parquet(self.base.path("taken"))

    def files(self) -> DataFrame:
        """(event_date, batch_id, file, size) of the stored files that no merge has seen, from their metadata alone."""
        found = self.source.events().select("event_date", "batch_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        taken = self._taken().select("event_date", "batch_id").distinct()
        return found.distinct().join(taken, ["event_date", "batch_id"], "left_anti")

    def plan(self, small: int = SMALL) -> DataFrame:
        """(event_date, files, small_files, bytes) of each day with batches that are not merged yet."""
        is_small = F.when(F.col("size") < small, 1)
        return self.files().groupBy("event_date").agg(F.count("*").alias("files"), F.count(is_small).alias("small_files"), F.sum("size").alias("bytes"))

    def _last(self) -> DataFrame:
        """The rows of the last merge of each day."""
        last = self._taken().groupBy("event_date").agg(F.max("merge").alias("merge"))
        last = last.select("event_date", F.concat(F.lit("merge-"), F.col("merge").cast("string")).alias("batch_id"))
        return self.base.events().join(last, ["event_date", "batch_id"], "left_semi")

    def read(self) -> DataFrame:
        """The latest version of every event stored so far, merged or not; without batch ids.

        Ties of ``created_at`` are settled by ``metadata``, ``campaign_id`` and ``tags``, as a merged row has no batch.
        """
        taken = self._taken().select("event_date", "batch_id").distinct()
        new = self.source.events().join(taken, ["event_date", "batch_id"], "left_anti")
        touched, base = self.files().select("event_date").distinct(), self._last().drop("batch_id")
        rest = base.join(touched, "event_date", "left_anti").select(*COLUMNS)
        return rest.unionByName(_newest(base.join(touched, "event_date", "left_semi").unionByName(new.drop("batch_id"))))

    def merge(self, least_small: int = 1, small: int = SMALL) -> int:
        """Merge the days with at least ``least_small`` small files, or as many bytes in larger ones, that are not merged yet.

        Returns the number of days. A merge that ends midway counts for nothing; the next one has its number and
        replaces what it left.
        """
        due = self.plan(small).where((F.col("small_files") >= least_small) | (F.col("bytes") >= least_small * small))
        dates = [r["event_date"] for r in due.select("event_date").collect()]  # one value per day
        if not dates:
            return 0
        number = (self._taken().agg(F.max("merge")).first()[0] or 0) + 1
        days = self.spark.createDataFrame([(d,) for d in dates], "event_date date")
        batches = self.files().join(days, "event_date", "left_semi").select("event_date", "batch_id").distinct()
        # What is taken in is written down before it is read: a batch that comes meanwhile is left to the next merge.
        planned = f"{self.base.path('planned')}/{number}"
        batches.withColumn("merge", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").parquet(planned)
        batches = self.spark.read.schema(TAKEN).parquet(planned)
        new = self.source.events().join(batches.select("event_date", "batch_id"), ["event_date", "batch_id"], "left_semi")
        old = self._last().join(days, "event_date", "left_semi")
        self.base.write_events(_newest(old.drop("batch_id").unionByName(new.drop("batch_id"))), f"merge-{number}")
        batches.write.mode("append").parquet(self.base.path("taken"))
        return len(dates)


def _newest(events: DataFrame) -> DataFrame:
    return latest_versions(events.select(*COLUMNS))
