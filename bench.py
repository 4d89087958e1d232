"""Times the headline queries and the streaming ingest; prints one JSON line.

BENCH_SF_DIR names the folder of the given tables, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from footfall.catalog import inputs  # noqa: E402
from footfall.catalog import queries as catalog  # noqa: E402
from footfall.functions.schema import MESSAGE  # noqa: E402
from footfall.operators.commands import to_events  # noqa: E402
from footfall.operators.messages import to_messages  # noqa: E402
from footfall.operators.rollup import hourly_partials  # noqa: E402
from footfall.plans import dashboard, metrics  # noqa: E402
from footfall.session import fresh_folder, prepare  # noqa: E402
from footfall.sources.synthetic import synthetic_commands  # noqa: E402
from footfall.sources.tables import Tables  # noqa: E402
from footfall.sources.topic import publish_files, stream_files  # noqa: E402
from footfall.streaming.landing import start_landing  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LOAD = int(os.environ.get("BENCH_LOAD_EVENTS", "1000000"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("footfall-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def run(make) -> float:
    """Seconds to build a query and produce all its rows."""
    started = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def best(make, times: int = 2) -> float:
    return round(min(run(make) for _ in range(times)), 3)


def stored_queries(tables: Tables, as_of: int) -> dict:
    """Metrics and panels over the stored tables: the rollup where counts and users suffice, else the events."""
    ask = (inputs.ASK_NAME, inputs.ASK_FROM, inputs.ASK_TO)
    over_rollup = {
        "total": lambda h: metrics.metric_total(h, *ask),
        "by_channel": lambda h: metrics.metric_groups(h, *ask, group_by="channel"),
        "by_hour": lambda h: metrics.metric_groups(h, *ask, group_by="hour"),
        "by_day": lambda h: metrics.metric_groups(h, *ask, group_by="day"),
        "b01": lambda h: dashboard.total_events(h, as_of),
        "b02": lambda h: dashboard.unique_users(h, as_of),
        "b03": lambda h: dashboard.purchases(h, as_of),
        "b08": lambda h: dashboard.events_over_time(h, as_of),
        "b09": lambda h: dashboard.unique_users_over_time(h, as_of),
        "b10": lambda h: dashboard.events_by_channel(h, as_of),
        "b11": lambda h: dashboard.events_by_type(h, as_of),
        "b12": lambda h: dashboard.events_by_type_and_channel(h, as_of),
    }
    over_events = {
        "b04": lambda e: dashboard.active_campaigns(e, as_of),
        "b05": lambda e: dashboard.total_revenue(e, as_of),
        "b06": lambda e: dashboard.avg_order_value(e, as_of),
        "b07": lambda e: dashboard.revenue_over_time(e, as_of),
        "b13": lambda e: dashboard.top_campaigns(e, as_of),
    }
    made = {f"stored_{n}": (lambda q=q: q(tables.hourly())) for n, q in over_rollup.items()}
    made.update({f"stored_{n}": (lambda q=q: q(tables.events())) for n, q in over_events.items()})
    made["stored_panels_refresh"] = lambda: dashboard.refresh(tables.hourly(), tables.events(), as_of)
    return made


def store(spark: SparkSession) -> Tables:
    tables = Tables(spark, fresh_folder(spark, "bench")).create()
    rows = inputs.events(spark, FOLDER)
    tables.write_events(rows, "load-1")
    tables.write_hourly(hourly_partials(rows), "load-1")
    return tables


def ingest_rate(spark: SparkSession) -> dict:
    """Events per second through the landing job, from topic files to both tables."""
    root = fresh_folder(spark, "load")
    now = 1704067200
    events = to_events(synthetic_commands(spark, LOAD, now), now)
    publish_files(to_messages(events), f"{root}/topic", "events", "timestamp")
    tables = Tables(spark, f"{root}/tables")
    started = time.perf_counter()
    start_landing(stream_files(spark, f"{root}/topic"), tables, f"{root}/checkpoint").awaitTermination()
    took = time.perf_counter() - started
    landed = tables.hourly().agg(F.sum("event_count")).first()[0]
    assert landed == LOAD, f"{landed} of {LOAD} events landed"
    return {"events": LOAD, "sec": round(took, 3), "events_per_sec": round(LOAD / took)}


BATCHES = 20


def ingest_batches(spark: SparkSession) -> dict:
    """Events per second over ``BATCHES`` micro-batches of the given events, ten times over, every batch with late days."""
    root = fresh_folder(spark, "batches")
    rows = inputs.events(spark, FOLDER).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    rows = rows.withColumn("user_id", F.concat("user_id", F.lit("-"), F.col("copy").cast("string"))).drop("copy")
    sent = inputs.placed(to_messages(rows)).select(*MESSAGE.fieldNames())
    sent.repartition(2 * BATCHES).write.parquet(f"{root}/topic")
    tables = Tables(spark, f"{root}/tables")
    events = rows.count()
    started = time.perf_counter()
    query = start_landing(stream_files(spark, f"{root}/topic", files_per_trigger=2), tables, f"{root}/checkpoint")
    query.awaitTermination()
    took = time.perf_counter() - started
    stored = tables.hourly()
    landed, batches = stored.agg(F.sum("event_count"), F.count_distinct("batch_id")).first()
    assert (landed, batches) == (events, BATCHES), f"{landed} of {events} events landed in {batches} batches"
    days = stored.groupBy("batch_id").agg(F.count_distinct("event_date").alias("n")).agg(F.min("n")).first()[0]
    return {"events": events, "batches": batches, "days_per_batch": days, "sec": round(took, 3), "events_per_sec": round(events / took)}


HEADLINE = [
    "canonical_events",
    "validate_errors",
    "bulk_outcome",
    "single_outcome",
    "hourly_rollup",
    "latest_events",
    "metrics_total",
    "metrics_by_channel",
    "metrics_by_hour",
    "metrics_by_day",
    "metrics_requests_batch",
    *catalog.PANELS,
    "publish_messages",
    "decode_split",
    "insert_failed_to_retry",
    "retry_outcome",
    "failure_counts",
]


def main() -> None:
    spark = session()
    ready = inputs.table(spark, FOLDER)
    as_of = ready.agg(F.unix_seconds(F.max(F.col("ts").cast("timestamp")))).first()[0]
    times = {name: best(lambda: catalog.ALL[name](spark, FOLDER)) for name in HEADLINE}
    started = time.perf_counter()
    tables = store(spark)
    times["store_tables"] = round(time.perf_counter() - started, 3)
    times.update({name: best(make) for name, make in stored_queries(tables, as_of).items()})
    ingest = ingest_rate(spark)
    times["stream_ingest"] = ingest["sec"]
    result = {
        "metric": "total seconds of all headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "ingest": ingest,
        "ingest_batches": ingest_batches(spark),
        "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
