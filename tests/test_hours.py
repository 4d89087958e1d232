"""The rollup with state: running counts over several batches, hours that close, late rows aside."""

import tempfile

from pyspark.sql import functions as F

from footfall.streaming.hours import read_hours, read_late, start_hours
from tests.test_rollup_and_metrics import T0, events

HOUR = 3600


def run(spark, folder, batches, **how):
    for n, rows in enumerate(batches, len(list(folder["done"]))):
        made = events(spark, [("v", "web", u, s) for u, s in rows]).coalesce(1)
        made.write.mode("append").parquet(f"{folder['root']}/in/n={n}")
        folder["done"].append(n)
        stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder['root']}/in/*")
        job = start_hours(stream, f"{folder['root']}/out", f"{folder['root']}/checkpoint", blocks=4, **how)
        job.awaitTermination()
        folder["states"] = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress if p["stateOperators"]]
    shown = read_hours(spark, f"{folder['root']}/out").select(((F.unix_seconds("hour") - T0) / HOUR).cast("int").alias("h"), "event_count", "unique_users")
    late = read_late(spark, f"{folder['root']}/out").groupBy(((F.col("hour") - T0) / HOUR).cast("int").alias("h"), "user_id").agg(F.sum("event_count"))
    return {r[0]: (r[1], r[2]) for r in shown.collect()}, sorted(tuple(r) for r in late.collect())


def test_hours_run_and_close(spark):
    folder = {"root": tempfile.mkdtemp(prefix="footfall-"), "done": []}
    users = [(f"u{i}", i) for i in range(50)]
    counts, late = run(spark, folder, [users + users, [("u1", 10), ("new", 20), ("u1", HOUR + 5)]], lateness=HOUR)
    assert counts == {0: (102, 51), 1: (1, 1)} and late == []
    # Within the lateness of an hour: the batch that brings the new time still counts, the next one finds the hour closed.
    counts, late = run(spark, folder, [[("z", 3 * HOUR), ("u2", 30)]], lateness=HOUR)
    assert counts == {0: (103, 51), 1: (1, 1), 3: (1, 1)} and late == []
    counts, late = run(spark, folder, [[("u2", 30), ("u2", 31), ("w", 32), ("z", 3 * HOUR + 1), ("u5", HOUR + 9), ("old", -90 * 24 * HOUR)]], lateness=HOUR)
    assert counts == {0: (103, 51), 1: (1, 1), 3: (2, 1)}
    assert late == [(-2160, "old", 1), (0, "u2", 2), (0, "w", 1), (1, "u5", 1)]
    assert folder["states"][-1] == 1  # of the four blocks of four hours one is open still
