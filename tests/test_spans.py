"""The tree of spans: what covers a range, and what the tree's states say."""

import random

from pyspark.sql import functions as F

from footfall.functions.sketches import distinct_count, merged_state, total
from footfall.operators.rollup import hourly_partials
from footfall.plans import spans
from tests.test_rollup_and_metrics import events

ROWS = [("vw"[i % 2 :][:1], ["web", "api", "mobile_app"][i % 3], f"u{i % 7}", i * 4321) for i in range(150)]


def test_cover_is_the_range_in_few_spans(spark):
    draw = random.Random(1)
    ranges = [sorted(draw.sample(range(9000), 2)) for _ in range(200)] + [[5, 5], [0, 24 * 200], [3, 4], [24, 48], [0, 24 * 64]]
    for days, top in ((64, None), (64, spans.DAY), (1, None), (4, 0)):
        sizes = spans.lengths(days) if top is None else spans.lengths(days)[: top + 1]
        rows = spark.createDataFrame(ranges, "a long, b long").withColumn("found", F.expr(spans.cover("a", "b", days, top)))
        for r in rows.collect():
            hours = sorted(h for x in r["found"] for h in range(x["start"], x["start"] + sizes[x["level"]]))
            assert hours == list(range(r["a"], r["b"]))
            assert all(x["start"] % sizes[x["level"]] == 0 for x in r["found"])
            assert len(r["found"]) <= 2 * sum(b // a for a, b in zip(sizes, sizes[1:])) + (r["b"] - r["a"]) // sizes[-1]


def test_tree_holds_every_span(spark, tmp_path):
    hourly = hourly_partials(events(spark, ROWS + ROWS))
    spans.write_tree(hourly, str(tmp_path / "tree"), days=2)
    found = {(r["level"], r["start"], r["event_name"], r["channel"]): (r["event_count"], r["unique_users"]) for r in spans.read_tree(spark, str(tmp_path / "tree")).collect()}
    sizes = spans.lengths(2)
    assert sizes == [1, 2, 4, 8, 24, 48]
    for level, size in enumerate(sizes):
        start = spans.hour_number(F.col("hour"))
        every = hourly.withColumn("start", start - start % size)
        counts = [total("event_count").alias("n"), distinct_count(merged_state("unique_users_state")).alias("users")]
        apart = every.groupBy("event_name", "channel", "start").agg(*counts)
        joined = every.groupBy("event_name", "start").agg(*counts).withColumn("channel", F.lit(None).cast("string"))
        want = {(level, r["start"], r["event_name"], r["channel"]): (r["n"], r["users"]) for r in apart.unionByName(joined).collect()}
        assert {k: v for k, v in found.items() if k[0] == level} == want
