"""Message decoding, retry and dead letters, and the streaming jobs."""

import tempfile
import time
from pathlib import Path
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from footfall.functions.schema import MESSAGE
from footfall.functions.sketches import distinct_count
from footfall.operators import failures
from footfall.operators.latest import first_seen
from footfall.operators.messages import decode, to_messages, well_formed
from footfall.operators.rollup import hourly_by_window, merge_hourly
from footfall.plans.metrics import metric_total
from footfall.sources.topic import publish_files, stream_files
from footfall.sources.tables import Tables
from footfall.streaming.landing import insert, land, start_landing
from footfall.streaming.retrying import Plan, retry_due, start_retrying
from tests.test_rollup_and_metrics import T0, events

NOON = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def messages(spark, *values, headers=None):
    rows = [(b"k", v.encode(), headers, "events", 1, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, MESSAGE)


def problem(spark, text):
    return decode(messages(spark, text)).first().problem


@pytest.mark.parametrize(
    "text",
    [
        "{bad",
        "",
        "[1]",
        "5",
        '"x"',
        '{"channel":"web"} x',
        '{"channel":"web"}],[1',
        '{"channel":"web"},{"channel":"api"}',
        '{"event_name":5}',
        '{"user_id":["a"]}',
        '{"timestamp":"5"}',
        '{"timestamp":1.0}',
        '{"timestamp":1e3}',
        '{"timestamp":9223372036854775808}',
        '{"timestamp":-1}',
        '{"timestamp":4294967296}',
        '{"tags":"a"}',
        '{"tags":["a",1]}',
        '{"metadata":[1]}',
        '{"metadata":"x"}',
        '{"created_at":"yesterday"}',
        '{"created_at":"2024-02-30T00:00:00Z"}',
        '{"created_at":5}',
    ],
)
def test_malformed(spark, text):
    assert problem(spark, text)


@pytest.mark.parametrize(
    "text",
    [
        "{}",
        "null",
        ' {"channel":"web"} ',
        '{"channel":null,"timestamp":null,"tags":null,"metadata":null,"created_at":null}',
        '{"unknown":{"a":[1,"b"]}}',
        '{"tags":[]}',
        '{"tags":["a",null]}',
        '{"created_at":"2024-01-01T00:00:00.123456789+03:00"}',
        '{"timestamp":4294967295}',
        '{"metadata":{"a":1,"a":2}}',
    ],
)
def test_readable(spark, text):
    assert problem(spark, text) is None


def test_decoded_values(spark):
    text = '{"CHANNEL":"api","Timestamp":7,"tags":["a",null],"metadata":{"b":1,"a":{"y":2,"x":1}},"event_id":"id"}'
    row = well_formed(decode(messages(spark, text)), T0).first()
    assert (row.channel, row.timestamp, row.tags, row.event_id, row.event_name) == ("api", 7, ["a", ""], "id", "")
    assert row.metadata == '{"a":{"x":1,"y":2},"b":1}'


def test_last_of_doubled_keys_counts(spark):
    assert decode(messages(spark, '{"channel":"a","channel":"b"}')).first().event.channel == "b"


def test_round_trip(spark):
    given = events(spark, [("v", "web", "a", 5, '{"price":1.5}')]).withColumn("tags", F.array(F.lit("x"), F.lit('"y"')))
    back = well_formed(decode(to_messages(given).withColumn("headers", F.lit(None))), T0)
    names = ["event_id", "event_name", "channel", "campaign_id", "user_id", "timestamp", "tags", "metadata", "event_date"]
    assert back.select(*names).collect() == given.select(*names).collect()


def head(**values):
    return [(k, v.encode()) for k, v in values.items()]


@pytest.mark.parametrize(
    "text, count",
    [(None, 1), ("invalid", 1), ("", 1), ("0", 0), ("-1", -1), ("+3", 3), (" 3", 1), ("100", 100), ("99999999999999999999", 1)],
)
def test_retry_count(spark, text, count):
    given = head(other="x") if text is None else head(other="x", retry_count=text)
    row = messages(spark, "{}", headers=given).select(failures.retry_count(F.col("headers")))
    assert row.first()[0] == count


def test_first_retry_count_header_counts(spark):
    row = messages(spark, "{}", headers=head(retry_count="4") + head(retry_count="9"))
    assert row.select(failures.retry_count(F.col("headers"))).first()[0] == 4


@pytest.mark.parametrize("n, delay", [(-1, 0), (0, 0), (1, 2), (2, 4), (3, 8), (4, 16), (5, 32), (6, 60), (10, 60), (99, 60)])
def test_backoff(spark, n, delay):
    assert spark.range(1).select(failures.backoff_seconds(F.lit(n))).first()[0] == delay


def texts(rows):
    return [r[0] for r in rows.select(failures.headers_text(F.col("headers"))).collect()]


def test_headers_along_the_way(spark):
    first = failures.first_failure(messages(spark, "{}"), "events", "down", NOON)
    origin = "original_topic=events; original_partition=1; original_offset=0"
    assert texts(first) == [f"retry_count=1; error_type=insert_failed; error_message=down; {origin}; failed_at=2024-01-01T12:00:00Z"]
    again = failures.requeue(failures.requeue(first, "still", NOON), "more", NOON + timedelta(hours=1))
    kept = f"{origin}; failed_at=2024-01-01T12:00:00Z"
    assert texts(again) == [
        f"retry_count=3; error_type=insert_failed; error_message=more; last_retry_at=2024-01-01T13:00:00Z; {kept}"
    ]
    dead = failures.dead_letter(again, "max_retries_exhausted", "gone", NOON)
    assert texts(dead) == [
        "final_retry_count=3; error_type=max_retries_exhausted; error_message=gone; "
        f"sent_to_dlq_at=2024-01-01T12:00:00Z; last_retry_at=2024-01-01T13:00:00Z; {kept}"
    ]


def test_batch_delay(spark):
    rows = messages(spark, "{}", headers=head(retry_count="2")).unionByName(messages(spark, "{}", headers=head(retry_count="4")))
    assert tuple(failures.batch_delay(rows).first()) == (4, 16)
    assert failures.batch_delay(rows.where("false")).first().delay_seconds == 0


def test_exhausted_at_five(spark):
    for n, spent in (("4", False), ("5", True)):
        row = messages(spark, "{}", headers=head(retry_count=n)).select(failures.is_exhausted())
        assert row.first()[0] is spent


# Streams ---------------------------------------------------------------------------------------------------


class Run:
    """A topic folder, tables and checkpoints of one test."""

    def __init__(self, spark):
        self.spark = spark
        self.root = tempfile.mkdtemp(prefix="footfall-")
        self.tables = Tables(spark, f"{self.root}/tables")

    def send(self, rows):
        publish_files(to_messages(rows), f"{self.root}/topic", "events", "timestamp")

    def send_raw(self, *texts):
        messages(self.spark, *texts).coalesce(1).write.mode("append").parquet(f"{self.root}/topic")

    def land(self, checkpoint="checkpoint", store=insert, at=NOON):
        stream = stream_files(self.spark, f"{self.root}/topic")
        start_landing(stream, self.tables, f"{self.root}/{checkpoint}", clock=lambda: at, store=store).awaitTermination()

    def retry(self, at, store=insert):
        return retry_due(self.spark, self.tables, f"{self.root}/retry", clock=lambda: at, store=store)

    def dead(self):
        return self.tables.stored("dead_letters")


def refuse(tables, rows, batch_id):
    raise RuntimeError("no room")


ROWS = [("v", "web", f"u{i % 5}", i * 600) for i in range(30)]


def test_a_batch_is_held_in_more_partitions_the_more_it_is(spark):
    """A task kept what it read, or a share by the number of cores, however much that was."""
    run, parts = Run(spark), []
    run.send_raw(*(f'{{"event_name":"v","user_id":"u{i}","timestamp":{T0 + i}}}' for i in range(200)))
    count = lambda tables, rows, batch_id: parts.append(rows.rdd.getNumPartitions())
    run.land(store=count)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.sha2((F.col("id") * 100 + k).cast("string"), 256)), "")
    body = F.to_json(F.struct(F.lit("v").alias("event_name"), text.alias("user_id"), F.lit(T0).alias("timestamp"))).cast("binary")
    large = spark.range(0, 60_000, 1, 8).select(F.lit(b"k").alias("key"), body.alias("value"), F.lit(None).cast(MESSAGE["headers"].dataType).alias("headers"), F.lit("events").alias("topic"), F.lit(1).alias("partition"), F.col("id").alias("offset"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        land(large, 0, run.tables, "main-two", "events", NOON, store=count)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert parts[0] == 1 and parts[1] > 2
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "67108864b"


def test_landing(spark):
    run = Run(spark)
    run.send(events(spark, ROWS))
    run.send_raw("{bad", '{"timestamp":"5"}')
    run.land()
    assert run.tables.events().count() == 30
    assert metric_total(run.tables.hourly(), "v", T0, T0 + 86400).first() == (30, 5)
    kinds = {r.error_type: r.messages for r in failures.failure_counts(run.dead()).collect()}
    assert kinds == {"unmarshal_error": 2}
    run.send(events(spark, ROWS))
    run.land()
    assert metric_total(run.tables.hourly(), "v", T0, T0 + 86400).first() == (60, 5)


def test_two_topics_under_two_checkpoints_are_both_stored(spark):
    run, other = Run(spark), Run(spark)
    run.send(events(spark, ROWS))
    other.send(events(spark, [(n, c, f"other-{u}", s) for n, c, u, s in ROWS]))
    run.land()
    other.tables = run.tables
    other.land(checkpoint="other")
    assert run.tables.events().count() == run.tables.events().select("event_id").distinct().count() == 60
    assert metric_total(run.tables.hourly(), "v", T0, T0 + 86400).first() == (60, 10)


def test_landing_the_same_batch_again_changes_nothing(spark):
    run = Run(spark)
    run.tables.create()
    run.send(events(spark, ROWS))
    for _ in range(2):
        land(spark.read.schema(MESSAGE).parquet(f"{run.root}/topic"), 0, run.tables, "main-one", "events", NOON)
    assert run.tables.events().count() == 30
    assert metric_total(run.tables.hourly(), "v", T0, T0 + 86400).first() == (30, 5)


def test_failed_insert_is_taken_back_and_retried(spark):
    run = Run(spark)
    run.send(events(spark, ROWS))
    run.send_raw("{bad")

    def half(tables, rows, batch_id):
        tables.write_events(rows, batch_id)
        raise RuntimeError("no room for the rollup")

    run.land(store=half)
    assert (run.tables.events().count(), run.dead().count()) == (0, 1)
    queued = run.tables.stored("retry")
    assert queued.count() == 30
    assert queued.first().next_attempt_at == queued.first().queued_at + timedelta(seconds=2)
    run.retry(NOON + timedelta(seconds=1))
    assert run.tables.events().count() == 0
    run.retry(NOON + timedelta(seconds=2))
    assert run.tables.events().count() == 30
    assert metric_total(run.tables.hourly(), "v", T0, T0 + 86400).first() == (30, 5)


def test_retries_run_out(spark):
    run = Run(spark)
    run.send(events(spark, ROWS[:3]))
    run.land(store=refuse)
    at = NOON
    for attempt in range(1, 6):
        assert run.dead().count() == 0
        at += timedelta(seconds=60)
        run.retry(at, store=refuse)
    assert run.dead().count() == 3
    assert "final_retry_count=5" in texts(run.dead())[0]
    run.retry(at + timedelta(hours=1))
    assert (run.tables.events().count(), run.dead().count()) == (0, 3)


def files_in(folder):
    return {str(x.relative_to(folder)): x.stat().st_mtime_ns for x in Path(folder).rglob("*.parquet")}


def test_what_waits_is_neither_read_nor_rewritten(spark):
    run = Run(spark)
    run.send(events(spark, ROWS))
    run.land(store=refuse)
    run.tables.write_retry(failures.queued(messages(spark, '{"timestamp":5}', headers=head(retry_count="6")), NOON), "other-0")
    before = files_in(run.tables.path("retry"))
    assert [x for x in run.tables.due(int(NOON.timestamp()) + 2) if "other" in x] == []
    assert run.retry(NOON + timedelta(seconds=1)) == 0
    assert files_in(run.tables.path("retry")) == before
    waiting = {k: v for k, v in before.items() if "batch_id=other-0" in k}
    for x in waiting:  # it could not be read
        Path(run.tables.path("retry"), x).chmod(0)
    assert run.retry(NOON + timedelta(seconds=2)) == 1
    assert files_in(run.tables.path("retry")) == waiting and waiting
    assert run.tables.events().count() == 30


def test_a_run_of_retries_that_ended_midway_is_done_again(spark):
    run = Run(spark)
    run.send(events(spark, ROWS))
    run.land(store=refuse)

    def breaks(tables, rows, batch_id):
        tables.write_events(rows, batch_id)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        run.retry(NOON + timedelta(seconds=2), store=breaks)
    run.tables.write_retry(failures.queued(messages(spark, '{"timestamp":5}', headers=head(retry_count="1")), NOON), "other-0")
    assert run.retry(NOON + timedelta(seconds=3)) == 2
    assert run.tables.events().count() == 31 and run.tables.due(1 << 40) == []
    assert metric_total(run.tables.hourly(), "v", T0, T0 + 86400).first() == (30, 5)

    plans = Plan(spark, f"{run.root}/retry")
    assert plans.last()["done"] and plans.last()["number"] == 1


def test_retrying_goes_on(spark):
    run = Run(spark)
    run.send(events(spark, ROWS[:3]))
    run.land(store=refuse)
    query = start_retrying(spark, run.tables, f"{run.root}/retry", every="1 second", clock=lambda: NOON + timedelta(hours=1))
    try:
        for _ in range(60):
            if run.tables.due(1 << 40) == []:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert run.tables.events().count() == 3


def test_malformed_in_retry(spark):
    run = Run(spark)
    run.tables.create()
    bad = messages(spark, "{bad", headers=head(retry_count="2", failed_at="x"))
    run.tables.write_retry(failures.queued(bad, NOON), "main-0")
    run.retry(NOON + timedelta(seconds=60))
    assert texts(run.dead())[0].startswith("final_retry_count=2; error_type=unmarshal_error; error_message=not JSON")


def test_stateful_windows_and_first_seen(spark):
    root = tempfile.mkdtemp(prefix="footfall-")
    shape = events(spark, ROWS).schema
    events(spark, ROWS + ROWS).write.parquet(f"{root}/in")

    def drain(rows, name, mode):
        query = rows.writeStream.format("memory").queryName(name).outputMode(mode)
        query.option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    source = spark.readStream.schema(shape).parquet(f"{root}/in")
    windows = drain(hourly_by_window(source), "windows", "update")
    seen = windows.agg(F.sum("event_count"), F.max(distinct_count(F.col("unique_users_state")))).first()
    assert tuple(seen) == (60, 5)
    assert drain(first_seen(source), "once", "append").count() == 30
