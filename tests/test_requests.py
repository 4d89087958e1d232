"""Request bodies, their outcome, and the intake stream."""

import json
import os
import tempfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from footfall.operators.requests import accepted, bulk_events, bulk_outcome, single_outcome
from footfall.sources.request_bodies import decode_bulk, decode_single, read_bodies, stream_bodies
from footfall.sources.topic import as_topic
from footfall.operators.messages import decode, to_messages
from footfall.streaming import intake as intake_job
from footfall.streaming.intake import SINGLE, start_intake, to_folder

NOW = 1_700_000_000
GOOD = {"event_name": "e", "channel": "web", "user_id": "u", "timestamp": NOW - 1}


def bodies(spark, *texts):
    rows = [(str(i), t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "request_id string, body string")


def outcome(spark, text, published=None):
    return bulk_outcome(decode_bulk(bodies(spark, text)), NOW, published).first()


def test_bulk_some_invalid(spark):
    events = [GOOD, {**GOOD, "event_name": ""}, GOOD, {**GOOD, "channel": "tv"}, GOOD]
    row = outcome(spark, {"events": events})
    assert (row.status, row.success_count, row.failed_count) == (207, 3, 2)
    assert [e["index"] for e in row.errors] == [1, 3]
    assert row.errors[0].error == "event_name: event_name is required"


def test_bulk_all_valid_and_none_valid(spark):
    assert outcome(spark, {"events": [GOOD]}).status == 202
    row = outcome(spark, {"events": [{}]})
    assert (row.status, row.success_count, row.failed_count) == (400, 0, 1)


def test_bulk_publish_failure_lists_the_rest_last(spark):
    row = outcome(spark, {"events": [GOOD, {}, GOOD]}, F.lit(False))
    assert (row.status, row.success_count, row.failed_count) == (400, 0, 3)
    assert [e["index"] for e in row.errors] == [1, 0, 2]
    assert row.errors[1].error == "failed to publish event"


@pytest.mark.parametrize("n, said", [(0, "events array cannot be empty"), (1000, None), (1001, "events array cannot exceed 1000 items")])
def test_bulk_size(spark, n, said):
    row = outcome(spark, {"events": [GOOD] * n})
    assert row.request_error == said
    assert row.success_count == (n if said is None else 0)


@pytest.mark.parametrize(
    "text, said",
    [
        ("{}", "events array cannot be empty"),
        ("null", "events array cannot be empty"),
        ('{"events":null}', "events array cannot be empty"),
        ('{"events":{}}', "invalid request body"),
        ('{"events":[1]}', "invalid request body"),
        ('{"events":[{"timestamp":"5"}]}', "invalid request body"),
        ('{"events":[{"timestamp":1.5}]}', "invalid request body"),
        ('{"events":[{"tags":"a"}]}', "invalid request body"),
        ('{"events":[]} {"events":[]}', "invalid request body"),
        ("[]", "invalid request body"),
        ("", "invalid request body"),
        ("{", "invalid request body"),
    ],
)
def test_bulk_bodies_that_are_turned_down(spark, text, said):
    row = outcome(spark, text)
    assert (row.request_error, row.status, row.success_count, row.failed_count) == (said, 400, 0, 0)


def test_bulk_events_keep_order_and_duplicates(spark):
    decoded = decode_bulk(bodies(spark, {"events": [GOOD, GOOD, {"Event_Name": "x"}, None]}))
    rows = bulk_events(decoded, NOW).orderBy("index").collect()
    assert [r.event_name for r in rows] == ["e", "e", "x", ""]
    assert rows[0].event_id == rows[1].event_id
    assert accepted(bulk_events(decoded, NOW), NOW).count() == 2


@pytest.mark.parametrize(
    "text, status, error",
    [
        (GOOD, 202, None),
        ({**GOOD, "extra": [1, {"a": None}]}, 202, None),
        ({**GOOD, "channel": None}, 202, None),
        ({**GOOD, "event_name": ""}, 400, "validation failed"),
        ({**GOOD, "event_name": 5}, 400, "invalid request body"),
        ({**GOOD, "metadata": []}, 400, "invalid request body"),
        ("nonsense", 400, "invalid request body"),
    ],
)
def test_single(spark, text, status, error):
    row = single_outcome(decode_single(bodies(spark, text)), NOW).first()
    assert (row.status, row.error, row.event_id is not None) == (status, error, status == 202)


def test_single_publish_failure(spark):
    row = single_outcome(decode_single(bodies(spark, GOOD)), NOW, F.lit(False)).first()
    assert (row.status, row.error, row.event_id) == (500, "failed to process event", None)


def test_bodies_of_a_folder(spark):
    folder = tempfile.mkdtemp(prefix="footfall-")
    with open(os.path.join(folder, "a.txt"), "w") as out:
        out.write(json.dumps({"events": [GOOD]}) + "\n" + "bad\n")
    rows = decode_bulk(read_bodies(spark, folder)).collect()
    assert len({r.request_id for r in rows}) == 2
    assert sorted(r.request_error or "" for r in rows) == ["", "invalid request body"]


def test_topic_order_within_user(spark):
    rows = [{**GOOD, "user_id": f"u{i % 3}", "timestamp": NOW - i} for i in range(60)]
    events = bulk_events(decode_bulk(bodies(spark, {"events": rows})), NOW)
    placed = as_topic(to_messages(events), "events", "timestamp")
    got = decode(placed).select("event.user_id", "event.timestamp", "partition", "offset").collect()
    for user in ("u0", "u1", "u2"):
        mine = sorted((r for r in got if r.user_id == user), key=lambda r: r.offset)
        assert len({r.partition for r in mine}) == 1
        assert [r.timestamp for r in mine] == sorted(r.timestamp for r in mine)
        assert len(mine) == 20


def intake(spark, publish_to=None, publish=None):
    root = tempfile.mkdtemp(prefix="footfall-")
    os.makedirs(f"{root}/in")
    with open(f"{root}/in/a.txt", "w") as out:
        out.write(json.dumps({"events": [GOOD, {}]}) + "\n" + "bad\n")
    bodies = stream_bodies(spark, f"{root}/in")
    at = datetime.fromtimestamp(NOW, timezone.utc)
    publish = publish or to_folder(f"{root}/topic")
    start_intake(bodies, root, publish, f"{root}/checkpoint", clock=lambda: at).awaitTermination()
    return root


def test_intake_stream(spark):
    root = intake(spark)
    answers = spark.read.parquet(f"{root}/answers").collect()
    assert sorted(a.status for a in answers) == [207, 400]
    refused = spark.read.parquet(f"{root}/refused").orderBy("reason").collect()
    assert [r.reason.split(":")[0] for r in refused] == ["event_name", "invalid request body"]
    assert spark.read.parquet(f"{root}/topic").count() == 1


def test_intake_tells_when_publishing_fails(spark):
    def publish(messages, batch_id):
        raise RuntimeError("topic is gone")

    answers = spark.read.parquet(f"{intake(spark, publish=publish)}/answers").collect()
    assert [(a.status, a.success_count, a.failed_count) for a in answers if a.request_error is None] == [(400, 0, 2)]


def single_intake(spark, publish=None):
    root = tempfile.mkdtemp(prefix="footfall-")
    os.makedirs(f"{root}/in")
    with open(f"{root}/in/a.txt", "w") as out:
        out.write("\n".join([json.dumps(GOOD), "{}", "bad"]) + "\n")
    at = datetime.fromtimestamp(NOW, timezone.utc)
    publish = publish or to_folder(f"{root}/topic")
    start_intake(stream_bodies(spark, f"{root}/in"), root, publish, f"{root}/checkpoint", clock=lambda: at, kind=SINGLE).awaitTermination()
    return root


def test_single_event_stream(spark):
    root = single_intake(spark)
    answers = spark.read.parquet(f"{root}/answers").collect()
    assert sorted((a.status, a.event_id is None, a.error) for a in answers if a.status == 400) == [(400, True, "invalid request body"), (400, True, "validation failed")]
    assert [a.event_id for a in answers if a.status == 202] == [json.loads(r.value)["event_id"] for r in spark.read.parquet(f"{root}/topic").collect()]
    refused = spark.read.parquet(f"{root}/refused").orderBy("reason").collect()
    assert [r.reason.split(":")[0] for r in refused] == ["event_name", "invalid request body"]


def test_single_event_stream_tells_when_publishing_fails(spark):
    def publish(messages, batch_id):
        raise RuntimeError("topic is gone")

    root = single_intake(spark, publish)
    assert sorted(a.status for a in spark.read.parquet(f"{root}/answers").collect()) == [400, 400, 500]
    whys = [r.reason for r in spark.read.parquet(f"{root}/refused").collect() if r.request_id is None]
    assert len(whys) == 1 and "topic is gone" in whys[0]


def test_the_broker_publisher_fits_the_intake(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(intake_job, "publish_kafka", lambda messages, servers, topic: sent.append((messages, servers, topic)))
    intake_job.to_kafka("here:9092", "topic")("messages", "batch-1")
    assert sent == [("messages", "here:9092", "topic")]
