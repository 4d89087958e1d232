"""Rollup, versions, metrics, panels and the stored tables."""

import random
import tempfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from footfall.functions.sketches import distinct_count
from footfall.operators.commands import to_events, to_rows
from footfall.operators.latest import latest_versions, unseen
from footfall.operators.rollup import hourly_by_window, hourly_partials, merge_hourly
from footfall.plans import dashboard
from footfall.plans.metrics import answer_requests, metric_groups, metric_total, metrics, shaped
from footfall.sources.synthetic import synthetic_commands
from footfall.sources.tables import Tables

T0 = 1704103200  # 2024-01-01 10:00:00


def events(spark, rows, at=T0):
    """rows: (event_name, channel, user_id, seconds after T0 [, metadata])"""
    full = [(r[0], r[1], "c", r[2], T0 + r[3], [], r[4] if len(r) > 4 else "{}") for r in rows]
    shape = "event_name string, channel string, campaign_id string, user_id string, timestamp bigint, tags array<string>, metadata string"
    return to_rows(to_events(spark.createDataFrame(full, shape), at))


def counted(hourly):
    rows = merge_hourly(hourly).select(
        "event_name", "channel", F.unix_seconds("hour").alias("h"), "event_count", distinct_count(F.col("unique_users_state"))
    )
    return {tuple(r) for r in rows.collect()}


THREE = [("view", "web", "a", 0), ("view", "web", "b", 60), ("view", "web", "a", 120)]


def test_rollup_counts_rows_and_users(spark):
    assert counted(hourly_partials(events(spark, THREE))) == {("view", "web", T0, 3, 2)}


def test_partials_merge_to_the_same_as_one_pass(spark):
    rng = random.Random(7)
    rows = [(rng.choice("xyz"), rng.choice(["web", "api"]), f"u{rng.randrange(40)}", rng.randrange(20000)) for _ in range(600)]
    whole = hourly_partials(events(spark, rows))
    parts = hourly_partials(events(spark, rows[:200])).unionByName(hourly_partials(events(spark, rows[200:])))
    brute = {}
    for name, channel, user, after in rows:
        brute.setdefault((name, channel, T0 + after // 3600 * 3600), []).append(user)
    expected = {(*k, len(v), len(set(v))) for k, v in brute.items()}
    assert counted(whole) == counted(parts) == counted(hourly_by_window(events(spark, rows))) == expected


def test_empty_user_counts_as_one(spark):
    assert counted(hourly_partials(events(spark, [("view", "web", "", 0), ("view", "web", "", 1)]))) == {("view", "web", T0, 2, 1)}


def test_users_beyond_the_exact_range_are_estimated(spark):
    def found(n):
        shape = ["'view' AS event_name", "'web' AS channel", "timestamp_seconds(1704103200 + id % 3000) AS ts", f"concat('u', id % {n}) AS user_id"]
        parts = spark.range(2 * n).repartition(7).selectExpr(*shape)
        row = merge_hourly(hourly_partials(parts).unionByName(hourly_partials(parts.limit(100)))).select("event_count", distinct_count(F.col("unique_users_state"))).first()
        return tuple(row)

    assert found(60_000) == (120_100, 60_000)
    events_, users = found(300_000)
    assert events_ == 600_100 and users != 0 and abs(users - 300_000) < 0.02 * 300_000  # five times the standard error


def test_resent_event_counts_again_its_user_does_not(spark):
    assert counted(hourly_partials(events(spark, THREE + THREE))) == {("view", "web", T0, 6, 2)}
    newest = latest_versions(events(spark, THREE + THREE))
    assert counted(hourly_partials(newest)) == {("view", "web", T0, 3, 2)}


def test_latest_version_wins(spark):
    old, new = events(spark, [("view", "web", "a", 0, '{"v":1}')], T0), events(spark, [("view", "web", "a", 0, '{"v":2}')], T0 + 5)
    rows = latest_versions(old.unionByName(new).unionByName(old)).collect()
    assert [r.metadata for r in rows] == ['{"v":2}']


def test_unseen(spark):
    stored = events(spark, THREE[:2])
    got = unseen(events(spark, THREE + THREE), stored).select("user_id", F.col("timestamp") - T0).collect()
    assert [tuple(r) for r in got] == [("a", 120)]


SALES = [
    ("purchase", "web", "a", 0),
    ("purchase", "web", "b", 1800),
    ("purchase", "mobile_app", "a", 3600),
    ("purchase", "web", "a", 86400),
    ("view", "web", "c", 0),
]


def total(spark, start, end, channel=""):
    row = metric_total(hourly_partials(events(spark, SALES)), "purchase", T0 + start, T0 + end, channel).first()
    return tuple(row)


def test_total_and_channel(spark):
    assert total(spark, 0, 90000) == (4, 2)
    assert total(spark, 0, 90000, "web") == (3, 2)
    assert total(spark, 0, 90000, "api") == (0, 0)


def test_range_is_over_hour_starts(spark):
    assert total(spark, 1, 3600) == (1, 1)
    assert total(spark, 0, 1) == (2, 2)
    assert total(spark, -3600, -1) == (0, 0)


def test_groups(spark):
    hourly = hourly_partials(events(spark, SALES))

    def by(group_by):
        return [tuple(r) for r in metric_groups(hourly, "purchase", T0, T0 + 90000, group_by=group_by).collect()]

    assert by("channel") == [("mobile_app", 1, 1), ("web", 3, 2)]
    assert by("hour") == [("2024-01-01 10:00:00", 2, 2), ("2024-01-01 11:00:00", 1, 1), ("2024-01-02 10:00:00", 1, 1)]
    assert by("day") == [("2024-01-01 00:00:00", 3, 2), ("2024-01-02 00:00:00", 1, 1)]
    assert by("week") == []


def test_whole_answer(spark):
    hourly = hourly_partials(events(spark, SALES))
    rows = [tuple(r) for r in metrics(hourly, "purchase", T0, T0 + 90000, group_by="channel").collect()]
    assert rows == [("total", "", 4, 2), ("group", "mobile_app", 1, 1), ("group", "web", 3, 2)]
    with pytest.raises(ValueError):
        metrics(hourly, "", T0, T0 + 1)


def test_many_requests_equal_single_ones(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["p", "v"]), rng.choice(["web", "api"]), f"u{rng.randrange(30)}", rng.randrange(4 * 86400)) for _ in range(500)]
    hourly = hourly_partials(events(spark, rows)).persist()
    asked = []
    for i in range(24):
        start = T0 + rng.randrange(-7200, 3 * 86400)
        asked.append((i, rng.choice(["p", "v", "none"]), start, start + rng.randrange(1, 3 * 86400), rng.choice(["", "web"]), ["", "channel", "hour", "day"][i % 4]))
    asked.append((98, "p", 1, 9 * 10**17, "", "day"))
    asked.append((99, "p", 5, 5, "", ""))
    requests = spark.createDataFrame(asked, "request_id bigint, event_name string, from bigint, to bigint, channel string, group_by string")
    got = {}
    for r in answer_requests(requests, hourly).collect():
        got.setdefault(r.request_id, set()).add((r.scope, r.key, r.total_count, r.unique_users))
    assert 99 not in got
    brute = {}
    for i, name, start, end, channel, group_by in asked[:-1]:
        met = [(c, u, (T0 + s) // 3600 * 3600) for n, c, u, s in rows if n == name and channel in ("", c)]
        met = [m for m in met if start <= m[2] <= end]
        brute[i] = {("total", "", len(met), len({m[1] for m in met}))}

        def text(seconds):
            return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")

        key = {"channel": lambda m: m[0], "hour": lambda m: text(m[2]), "day": lambda m: text(m[2] // 86400 * 86400)}.get(group_by)
        if key:
            for k in {key(m) for m in met}:
                mine = [m for m in met if key(m) == k]
                brute[i].add(("group", k, len(mine), len({m[1] for m in mine})))
    assert got == brute
    shown = {r.request_id: r for r in shaped(answer_requests(requests, hourly)).collect()}
    assert [(g.key, g.total_count, g.unique_users) for g in shown[98].grouped_data] == sorted(x[1:] for x in brute[98] if x[0] == "group")


def test_no_state_is_merged_for_one_question(spark):
    """Merged by question, the states of 150,000 questions took 12 GB on their way."""
    hourly = hourly_partials(events(spark, SALES))
    shape = "request_id bigint, event_name string, `from` bigint, `to` bigint, channel string, group_by string"
    asked = [(i, "purchase", T0 - 7200, T0 + h * 3600, c, g) for i, (h, c, g) in enumerate([(1, "", ""), (30, "", "channel"), (30, "web", "day"), (40, "", "")])]
    answer = answer_requests(spark.createDataFrame(asked, shape), hourly)
    plan = answer._jdf.queryExecution().optimizedPlan().toString()
    merges = [x for x in plan.splitlines() if "Aggregate [" in x and "theta_union_agg" in x]
    assert merges and not any("group_by" in x.split("Aggregate [")[1] for x in merges)
    got = {}
    for r in answer.collect():
        got.setdefault(r.request_id, []).append((r.scope, r.key, r.total_count, r.unique_users))
    assert sorted(got[0]) == [("total", "", 3, 2)]
    assert sorted(got[1]) == [("group", "mobile_app", 1, 1), ("group", "web", 3, 2), ("total", "", 4, 2)]
    assert sorted(got[2])[:1] == [("group", "2024-01-01 00:00:00", 2, 2)] and sorted(got[2])[-1] == ("total", "", 3, 2)
    assert sorted(got[3]) == [("total", "", 4, 2)]


AS_OF = T0 + 1800


def test_panels_over_nothing(spark):
    none = events(spark, THREE).where("false")
    hourly = hourly_partials(none)
    assert tuple(dashboard.total_events(hourly, AS_OF).first()) == (0,)
    assert tuple(dashboard.unique_users(hourly, AS_OF).first()) == (0,)
    assert tuple(dashboard.total_revenue(none, AS_OF).first()) == (0.0,)
    assert tuple(dashboard.avg_order_value(none, AS_OF).first()) == (0.0,)
    assert dashboard.top_campaigns(none, AS_OF).count() == 0


def test_average_counts_orders_without_price(spark):
    rows = [("purchase", "web", "a", 0, '{"price":30}'), ("purchase", "web", "b", 0, '{"total":99}'), ("view", "web", "b", 0, '{"price":5}')]
    assert dashboard.avg_order_value(events(spark, rows), AS_OF).first()[0] == 15.0
    assert dashboard.total_revenue(events(spark, rows), AS_OF).first()[0] == 30.0


def test_oldest_hour_is_in_event_panels_only(spark):
    rows = events(spark, [("purchase", "web", "a", 1800 - 86400, '{"price":1}'), ("purchase", "web", "a", 0, '{"price":1}')])
    assert dashboard.total_revenue(rows, AS_OF).first()[0] == 2.0
    assert dashboard.purchases(hourly_partials(rows), AS_OF).first()[0] == 1


def test_top_campaigns_ties_by_name(spark):
    rows = events(spark, [("v", "web", f"u{i}", i) for i in range(24)])
    rows = rows.withColumn("campaign_id", F.concat(F.lit("c"), F.lpad((F.col("timestamp") % 12).cast("string"), 2, "0")))
    top = dashboard.top_campaigns(rows, AS_OF).collect()
    assert [(r.campaign_id, r.event_count, r.unique_users) for r in top] == [(f"c{i:02d}", 2, 2) for i in range(10)]


def test_tables_replace_a_batch_and_prune_days(spark):
    tables = Tables(spark, tempfile.mkdtemp(prefix="footfall-")).create()
    for _ in range(2):
        tables.write_events(events(spark, SALES), "main-1")
        tables.write_hourly(hourly_partials(events(spark, SALES)), "main-1")
    assert tables.events().count() == 5
    assert metric_total(tables.hourly(), "purchase", T0, T0 + 90000).first()[0] == 4
    plan = metric_total(tables.hourly(), "purchase", T0, T0 + 3600)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    tables.drop_batch("main-1")
    assert tables.events().count() == tables.hourly().count() == 0


def test_merging_changes_no_answer_and_leaves_the_old_tables(spark):
    tables, merged = (Tables(spark, tempfile.mkdtemp(prefix="footfall-")).create() for _ in range(2))
    tables.write_hourly(hourly_partials(events(spark, SALES)), "main-1")
    tables.write_hourly(hourly_partials(events(spark, THREE)), "main-2")
    before, rows = counted(tables.hourly()), tables.hourly().count()
    tables.merge_hourly_into(merged, "1")
    tables.merge_hourly_into(merged, "1")
    assert counted(merged.hourly()) == before and merged.hourly().count() == len(before) < rows
    assert tables.hourly().count() == rows
    with pytest.raises(ValueError):
        tables.merge_hourly_into(Tables(spark, tables.root), "2")


def test_days_merged_one_after_the_other_all_stay(spark):
    tables, merged = (Tables(spark, tempfile.mkdtemp(prefix="footfall-")).create() for _ in range(2))
    tables.write_hourly(hourly_partials(events(spark, SALES)), "main-1")
    days = [str(r[0]) for r in tables.hourly().select("event_date").distinct().collect()]
    assert len(days) > 1
    for day in days:
        tables.merge_hourly_into(merged, "1", [day])
    assert counted(merged.hourly()) == counted(tables.hourly())


def test_merged_events_keep_the_latest(spark):
    tables, merged = (Tables(spark, tempfile.mkdtemp(prefix="footfall-")).create() for _ in range(2))
    tables.write_events(events(spark, [("v", "web", "a", 0, '{"v":1}')], T0), "main-1")
    tables.write_events(events(spark, [("v", "web", "a", 0, '{"v":2}')], T0 + 9), "main-2")
    assert tables.events().count() == 2
    tables.merge_events_into(merged, "1")
    assert [r.metadata for r in merged.events().collect()] == ['{"v":2}']


def test_synthetic_load(spark):
    rows = synthetic_commands(spark, 1000, T0).collect()
    assert rows[7].event_name == "purchase" and rows[7].channel == "mobile_app" and rows[7].timestamp == T0 - 7
    assert rows[207].tags == ["test", "loadtest", "worker_1"] and rows[207].campaign_id == "cmp_7"
    assert rows[3].metadata == '{"currency":"TRY","price":102.99,"product_id":"prod_3","worker_id":0}'


def test_requests_read_only_the_days_they_ask_for(spark):
    tables = Tables(spark, tempfile.mkdtemp(prefix="footfall-")).create()
    tables.write_hourly(hourly_partials(events(spark, [("v", "web", f"u{d}", d * 86400) for d in range(10)])), "load")
    shape = "request_id bigint, event_name string, `from` bigint, `to` bigint, channel string, group_by string"
    ask = spark.createDataFrame([(1, "v", T0 + 2 * 86400, T0 + 4 * 86400, "", "")], shape)
    answer = answer_requests(ask, tables.hourly())
    assert [tuple(r)[1:] for r in answer.collect()] == [("total", "", 3, 3)]
    plan = answer._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    far = spark.createDataFrame([(2, "v", 1, 2**62, "", "")], shape)
    assert [tuple(r)[1:] for r in answer_requests(far, tables.hourly()).collect()] == [("total", "", 10, 10)]
