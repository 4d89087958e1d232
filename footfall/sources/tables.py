"""The stored tables: plain Parquet folders, partitioned so that writing a batch again replaces it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.fixed import MAX_ROWS_PER_FILE
from footfall.functions.schema import DEAD_LETTER, EVENTS, HOURLY, RETRY
from footfall.operators.latest import latest_versions
from footfall.operators.rollup import merge_hourly

SCHEMAS = {"events": EVENTS, "hourly": HOURLY, "retry": RETRY, "dead_letters": DEAD_LETTER}

# The folders of each table.
PARTS = {"events": ["event_date", "batch_id"], "hourly": ["event_date", "batch_id"], "retry": ["due", "batch_id"], "dead_letters": ["batch_id"]}

# Rows of a day lie in this order within each file, so that a filter on the leading columns skips row groups.
ORDER = {"events": ["event_name", "timestamp", "event_id"], "hourly": ["event_name", "channel", "hour"]}

# Columns with a Bloom filter in the events files, for lookups the order does not help.
BLOOMED = ["event_name", "channel", "user_id", "event_id"]


class Tables:
    """``events`` and ``hourly`` by (event_date, batch_id), ``retry`` by (due, batch_id), ``dead_letters`` by batch_id.

    ``due`` is the second from which a message may be tried again: a message waits in a folder that no one touches or
    reads before, and that goes as a whole once it has been tried.

    Every write replaces the partitions of its own batch id, so a micro-batch that runs again leaves the tables as
    if it had run once. Batch ids of a stream hold its name and the id of its checkpoint, so streams never replace each other's batches.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def create(self) -> Tables:
        """Make the folders of tables that are not there yet."""
        for table in SCHEMAS:
            path, files = self._files(self.path(table))
            files.mkdirs(path)
        return self

    # Reading ----------------------------------------------------------------------------------------------

    def stored(self, table: str) -> DataFrame:
        """All rows as appended."""
        return self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))

    def events(self) -> DataFrame:
        return self.stored("events")

    def hourly(self) -> DataFrame:
        return self.stored("hourly")

    def due(self, second: int) -> list[str]:
        """The folders of the retry table whose messages may be tried by then, each as due=.../batch_id=..."""
        first = [x for x in self._names(self.path("retry")) if x.startswith("due=") and int(x[4:]) <= second]
        return sorted(f"{x}/{y}" for x in first for y in self._names(f"{self.path('retry')}/{x}") if y.startswith("batch_id="))

    def waiting(self, folders: list[str]) -> DataFrame:
        """The messages in some folders of the retry table; no other is listed or read."""
        if not folders:
            return self.stored("retry").where(F.lit(False))
        root = self.path("retry")
        return self.spark.read.schema(SCHEMAS["retry"]).option("basePath", root).parquet(*(f"{root}/{x}" for x in folders))

    def forget_tried(self, folders: list[str]) -> None:
        """Take folders out of the retry table whose messages have gone elsewhere."""
        for x in folders:
            self._delete(f"{self.path('retry')}/{x}")
            above = f"{self.path('retry')}/{x.split('/')[0]}"
            path, files = self._files(above)
            if files.exists(path) and not self._names(above):
                files.delete(path, False)

    # Writing ----------------------------------------------------------------------------------------------

    def write_events(self, rows: DataFrame, batch_id: str) -> None:
        self._write_by_day("events", rows, batch_id, {f"parquet.bloom.filter.enabled#{c}": "true" for c in BLOOMED})

    def write_hourly(self, rows: DataFrame, batch_id: str) -> None:
        self._write_by_day("hourly", rows, batch_id, {})

    def write_retry(self, rows: DataFrame, batch_id: str) -> None:
        """A batch has as many folders as it has different waits, of which there are seven."""
        rows = rows.withColumn("due", F.unix_seconds("next_attempt_at"))
        self._write_batch("retry", rows, batch_id)

    def write_dead_letters(self, rows: DataFrame, batch_id: str) -> None:
        self._write_batch("dead_letters", rows, batch_id)

    def _write_by_day(self, table: str, rows: DataFrame, batch_id: str, options: dict[str, str]) -> None:
        """Rebalancing by day gives few files per day and splits a day that holds most of the rows."""
        columns = [c for c in SCHEMAS[table].fieldNames() if c != "batch_id"]
        spread = rows.select(*columns).hint("rebalance", "event_date")
        ordered = spread.withColumn("batch_id", F.lit(batch_id)).sortWithinPartitions(
            "event_date", "batch_id", *ORDER[table]
        )
        self._overwrite(ordered, PARTS[table], options, table)

    def _write_batch(self, table: str, rows: DataFrame, batch_id: str) -> None:
        columns = [c for c in SCHEMAS[table].fieldNames() if c != "batch_id"]
        self._overwrite(rows.select(*columns).withColumn("batch_id", F.lit(batch_id)), PARTS[table], {}, table)

    def _overwrite(self, rows: DataFrame, by: list[str], options: dict[str, str], table: str) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
            .options(**options)
            .partitionBy(*by)
            .parquet(self.path(table))
        )

    def drop_batch(self, batch_id: str) -> None:
        """Take back whatever a batch wrote to any table."""
        for table in SCHEMAS:
            above = "".join(f"{x}=*/" for x in PARTS[table][:-1])
            self._delete(f"{self.path(table)}/{above}batch_id={batch_id}")

    # Merging ----------------------------------------------------------------------------------------------

    def merge_hourly_into(self, target: Tables, name: str, dates: list[str] | None = None) -> None:
        """Write the rollup of the given days (all by default) to another root, one row per key."""
        self._other(target).write_hourly(merge_hourly(self._days("hourly", dates)), name)

    def merge_events_into(self, target: Tables, name: str, dates: list[str] | None = None) -> None:
        """Write the latest version of each event of the given days (all by default) to another root."""
        self._other(target).write_events(latest_versions(self._days("events", dates)), name)

    def _other(self, target: Tables) -> Tables:
        """Merging reads these tables and leaves them as they are; whoever runs it moves the readers over."""
        if target.root == self.root:
            raise ValueError("merge into tables of another root")
        return target.create()

    def _days(self, table: str, dates: list[str] | None) -> DataFrame:
        rows = self.stored(table)
        return rows if dates is None else rows.where(F.col("event_date").isin([F.lit(d).cast("date") for d in dates]))

    # Folders ----------------------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        path, files = self._files(folder)
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def _glob(self, pattern: str) -> list:
        path, files = self._files(pattern)
        return list(files.globStatus(path) or [])

    def _delete(self, pattern: str) -> None:
        _, files = self._files(pattern)
        for status in self._glob(pattern):
            files.delete(status.getPath(), True)

    def _files(self, pattern: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())
