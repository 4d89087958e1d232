"""Users of ranges counted by when they were last seen, and the hashes that are read from states."""

import random
from datetime import datetime, timezone
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footfall.functions.fixed import SKETCH_LOG_ENTRIES
from footfall.functions.sketch_bytes import ALL, hashes
from footfall.operators.rollup import hourly_partials
from footfall.plans import first_seen, spans
from footfall.plans.metrics import answer_requests, metric_total, shaped
from tests.test_rollup_and_metrics import T0, events

SHAPE = "request_id bigint, event_name string, `from` bigint, `to` bigint, channel string, group_by string"


def answered(spark, asked, hourly, **kept):
    found = {}
    for r in answer_requests(spark.createDataFrame(asked, SHAPE), hourly, **kept).collect():
        found.setdefault(r.request_id, set()).add((r.scope, r.key, r.total_count, r.unique_users))
    return found


def text(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def by_hand(rows, asked):
    """Rows are (name, channel, user, seconds after T0)."""
    found = {}
    for i, name, start, end, channel, group_by in asked:
        met = [(c, u, (T0 + s) // 3600 * 3600) for n, c, u, s in rows if n == name and channel in ("", c)]
        met = [m for m in met if start <= m[2] <= end]
        found[i] = {("total", "", len(met), len({m[1] for m in met}))}
        key = {"channel": lambda m: m[0], "hour": lambda m: text(m[2]), "day": lambda m: text(m[2] // 86400 * 86400)}.get(group_by, lambda m: None)
        for k in {key(m) for m in met} - {None}:
            mine = [m for m in met if key(m) == k]
            found[i].add(("group", k, len(mine), len({m[1] for m in mine})))
    return found


def some_rows_and_requests():
    draw = random.Random(5)
    rows = [(draw.choice("pv"), draw.choice(["web", "api", "mobile_app"]), f"u{draw.randrange(60)}", draw.randrange(12 * 86400)) for _ in range(900)]
    rows += [("seldom", "web", "u1", 0), ("seldom", "web", "u1", 11 * 86400), ("seldom", "api", "u1", 11 * 86400)]
    asked = []
    for i in range(60):
        start = T0 + draw.randrange(-86400, 11 * 86400)
        asked.append((i, draw.choice(["p", "v", "seldom", "none"]), start, start + draw.randrange(1, 9 * 86400), draw.choice(["", "web", "api"]), ["", "channel", "hour", "day"][i % 4]))
    rows += [("seldom", "web", "u2", -9000 * 86400), ("seldom", "api", "u1", -9000 * 86400)]
    wide = product((1, T0 - 7200), ["", "channel", "hour", "day"])
    asked += [(i, "seldom", start, T0 + 20 * 86400, "", g) for i, (start, g) in enumerate(wide, 60)]
    return rows, asked


@pytest.mark.parametrize("part", [first_seen.PART, 25])
def test_ranges_by_hand_in_one_part_and_in_many(spark, monkeypatch, part):
    monkeypatch.setattr(first_seen, "PART", part)
    monkeypatch.setattr(first_seen, "SHARE", 0)
    rows, asked = some_rows_and_requests()
    hourly = hourly_partials(events(spark, rows[::2])).unionByName(hourly_partials(events(spark, rows[1::2]))).persist()
    assert answered(spark, asked, hourly) == by_hand(rows, asked)


def test_a_kept_tree_answers_alike(spark, tmp_path):
    rows, asked = some_rows_and_requests()
    hourly = hourly_partials(events(spark, rows)).persist()
    spans.write_tree(hourly, str(tmp_path / "tree"))
    assert answered(spark, asked, hourly, tree=spans.read_tree(spark, str(tmp_path / "tree"))) == by_hand(rows, asked)


def crowds(spark, *crowds):
    """Users (from, to) who are there at seconds after T0, as (from, to, seconds)."""
    rows = None
    for low, high, at in crowds:
        more = spark.range(low, high).select(
            F.lit("p").alias("event_name"),
            F.element_at(F.array(F.lit("web"), F.lit("api")), (F.col("id") % 2 + 1).cast("int")).alias("channel"),
            F.concat(F.lit("u"), F.col("id").cast("string")).alias("user_id"),
            F.timestamp_seconds(F.lit(T0 + at)).alias("ts"),
        )
        rows = more if rows is None else rows.unionByName(more)
    return hourly_partials(rows)


def test_ranges_of_more_users_than_a_state_holds_are_exact(spark):
    """Merged states told 90,000 users of three hours as an estimate."""
    hourly = crowds(spark, (0, 40000, 0), (30000, 70000, 3600), (50000, 90000, 86400)).persist()
    found = answered(spark, [(1, "p", T0 - 1800, T0 + 2 * 86400, "", "day"), (2, "p", T0 - 1800, T0 + 2 * 86400, "", "channel")], hourly)
    assert {x[2:] for x in found[1]} == {(120000, 90000), (80000, 70000), (40000, 40000)}
    assert sorted(found[2]) == [("group", "api", 60000, 45000), ("group", "web", 60000, 45000), ("total", "", 120000, 90000)]


def test_shaped_answers_have_them_too(spark):
    hourly = crowds(spark, (0, 40000, 0), (30000, 70000, 3600), (50000, 90000, 86400))
    asked = [(1, "p", T0 - 1800, T0 + 2 * 86400, "", "hour"), (2, "none", T0, T0 + 7200, "", "hour")]
    answer = shaped(answer_requests(spark.createDataFrame(asked, SHAPE), hourly))
    assert "theta_union(" not in answer._jdf.queryExecution().optimizedPlan().toString()
    one, none = answer.orderBy("request_id").collect()
    assert (one.total_count, one.unique_users) == (120000, 90000) and (none.total_count, none.unique_users, none.grouped_data) == (0, 0, [])
    assert [tuple(g) for g in one.grouped_data] == [(text((T0 + s) // 3600 * 3600), 40000, 40000) for s in (0, 3600, 86400)]


def test_hours_of_more_users_than_a_state_holds_are_estimated(spark):
    hourly = crowds(spark, (0, 300000, 0), (299000, 299500, 3600), (200000, 350000, 7200), (0, 50, 86400)).persist()
    asked = [(1, "p", T0 - 1800, T0 + 7200, "", "hour"), (2, "p", T0 + 3600, T0 + 5400, "", ""), (3, "p", T0 - 1800, T0 + 2 * 86400, "web", "day")]
    found = answered(spark, asked, hourly)
    users = sorted(x[3] for x in found[1])
    assert users[0] == 500 and [round(x / 5000) for x in users[1:]] == pytest.approx([30, 60, 70], abs=1)
    assert found[2] == {("total", "", 500, 500)}
    assert [round(x[3] / 2500) for x in sorted(found[3])][0] == pytest.approx(70, abs=1) and sorted(found[3])[1][2:] == (25, 25)
    whole = metric_total(hourly, "p", T0 - 1800, T0 + 7200).first()
    total = next(x for x in found[1] if x[0] == "total")
    assert total[2] == whole.total_count == 450500 and abs(total[3] / whole.unique_users - 1) < 0.02


def test_no_union_or_window_for_a_range(spark):
    """One union of two states for each range: 900,000 requests over 6,000,000 events had not ended after 420 s."""
    rows, asked = some_rows_and_requests()
    answer = answer_requests(spark.createDataFrame(asked, SHAPE), hourly_partials(events(spark, rows)))
    plan = answer._jdf.queryExecution().optimizedPlan().toString()
    assert "theta_union(" not in plan and "theta_sketch_estimate" not in plan and "Window [" not in plan


def test_hashes_of_states(spark):
    state = F.theta_sketch_agg(F.concat(F.lit("u"), F.col("id").cast("string")), SKETCH_LOG_ENTRIES).alias("state")
    single = [bytes(r.state) for r in spark.range(100).groupBy("id").agg(state).orderBy("id").collect()]
    ids = [int(x.tolist()[0]) for _, _, _, _, x in hashes(pa.array(single, pa.binary()), most=1)]
    assert len(set(ids)) == 100
    sizes = [0, 1, 2, 7, 8, 9, 64, 100]
    states = [bytes(spark.range(n).select(state).first().state) for n in sizes]
    for most in (1, 70, 1000):
        got = []
        for begin, end, bounds, n, found in hashes(pa.array([*states, None], pa.binary()), most):
            assert (bounds == ALL).all() and len(n) == end - begin
            ends = n.cumsum()
            got += [found[e - k : e].tolist() for e, k in zip(ends, n)]
        assert got == [*[sorted(ids[:n]) for n in sizes], []]
    part = bytes(spark.range(200000).select(state).first().state)
    [(_, _, bounds, n, found)] = hashes(pa.array([part], pa.binary()))
    assert len(found) == n[0] and found.max() < bounds[0] and abs(n[0] * 2.0**63 / bounds[0] / 200000 - 1) < 0.02
    with pytest.raises(ValueError):
        list(hashes(pa.array([b"\x01\x01\x03\0\0\0\0\0"], pa.binary())))
