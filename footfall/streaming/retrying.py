"""The retry job: messages whose batch could not be inserted get further tries, then are given up.

The retry table is a queue by due time. A run takes the folders that are due, tries their messages, and lets the folders
go; messages that still wait lie in other folders, which it neither reads nor writes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.functions import fixed as fx
from footfall.functions.clock import as_timestamp
from footfall.operators import failures
from footfall.operators.messages import well_formed
from footfall.sources.tables import Tables
from footfall.streaming.landing import Clock, Insert, batch_name, first_line, held, insert, utc_now


def retry_batch(batch: DataFrame, tables: Tables, at, batch_id: str, max_retries: int = fx.MAX_RETRIES, store: Insert = insert) -> None:
    """Try messages that are due. Malformed ones become dead letters; when the insert fails again each message either
    goes back with a higher count, to wait by its own count, or is given up."""
    decoded = held(batch)
    try:
        bad = decoded.where("problem IS NOT NULL")
        dead = failures.dead_letter(bad, fx.UNMARSHAL_ERROR, F.col("problem"), at)
        try:
            store(tables, well_formed(decoded, at), batch_id)
        except Exception as reason:
            tables.drop_batch(batch_id)
            good, said = decoded.where("problem IS NULL"), first_line(reason)
            spent = failures.is_exhausted(max_retries)
            again = failures.requeue(good.where(~spent), said, at)
            tables.write_retry(failures.queued(again, at), batch_id)
            dead = dead.unionByName(failures.dead_letter(good.where(spent), fx.RETRIES_EXHAUSTED, said, at))
        tables.write_dead_letters(dead, batch_id)
    finally:
        decoded.unpersist()


class Plan:
    """What a run has set out to do, in one small file under its checkpoint.

    It is written before anything else. A run that ends midway is done again over the same folders under the same
    batch id and time, whatever has become due since, so it replaces what it left.
    """

    def __init__(self, spark: SparkSession, checkpoint: str):
        self._spark, self._folder = spark, f"{checkpoint.rstrip('/')}/plans"

    def _file(self, number: int):
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{number:012d}")
        return path, path.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def last(self) -> dict | None:
        path, files = self._file(0)
        if not files.exists(path.getParent()):
            return None
        names = [x.getPath().getName() for x in files.listStatus(path.getParent())]
        numbers = [int(x) for x in names if x.isdigit()]
        if not numbers:
            return None
        text = self._spark.read.text(f"{self._folder}/{max(numbers):012d}", wholetext=True).first()["value"]
        return json.loads(text)

    def write(self, plan: dict) -> dict:
        """Renamed into place, so that a plan is there as a whole or not at all; the plan before it goes."""
        path, files = self._file(plan["number"])
        part = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/.writing")
        out = files.create(part, True)
        out.write(bytearray(json.dumps(plan).encode()))
        out.close()
        files.delete(path, False)
        files.rename(part, path)
        files.delete(self._file(plan["number"] - 1)[0], False)
        return plan


def retry_due(
    spark: SparkSession,
    tables: Tables,
    checkpoint: str,
    stream: str = "retry",
    max_retries: int = fx.MAX_RETRIES,
    clock: Clock = utc_now,
    store: Insert = insert,
) -> int:
    """Try what is due now, and first what an earlier run left undone. Returns how many folders that were."""
    tables.create()
    plans = Plan(spark, checkpoint)
    last = plans.last()
    done = 0
    if last and not last["done"]:
        done += _follow(tables, plans, last, stream, max_retries, store)
    at = clock()
    folders = tables.due(int(at.timestamp()))
    if folders:
        number = last["number"] + 1 if last else 0
        plan = plans.write({"number": number, "at": int(at.timestamp()), "folders": folders, "done": False})
        done += _follow(tables, plans, plan, stream, max_retries, store)
    return done


def _follow(tables: Tables, plans: Plan, plan: dict, stream: str, max_retries: int, store: Insert) -> int:
    """Folders of the plan that are gone already were tried by the run before; then all it wrote is there."""
    left = [x for x in plan["folders"] if x in set(tables.due(plan["at"]))]
    if left == plan["folders"]:
        batch_id = batch_name(stream, plan["number"])
        tables.drop_batch(batch_id)
        retry_batch(tables.waiting(left), tables, plan["at"], batch_id, max_retries, store)
    tables.forget_tried(left)
    plans.write(plan | {"done": True})
    return len(left)


def start_retrying(spark: SparkSession, tables: Tables, checkpoint: str, every: str = "5 seconds", **how) -> StreamingQuery:
    """Run ``retry_due`` again and again, until the query is stopped."""
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = beat.writeStream.foreachBatch(lambda _, number: retry_due(spark, tables, f"{checkpoint}/queue", **how))
    return writer.option("checkpointLocation", f"{checkpoint}/beat").trigger(processingTime=every).start()
