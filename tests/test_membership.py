"""Strict intake by filters: the same answer as by reading, and days without a doubt are not read."""

import re
import tempfile

from footfall.operators.latest import unseen
from footfall.sources.membership import StoredIds
from footfall.sources.tables import Tables
from tests.test_rollup_and_metrics import T0, events

DAY = 86400


def at(spark, seconds, created=T0):
    return events(spark, [("v", "web", f"u{s}", s) for s in seconds], created)


def made(spark, pieces=64):
    root = tempfile.mkdtemp(prefix="footfall-")
    tables = Tables(spark, f"{root}/tables").create()
    return tables, StoredIds(spark, tables, f"{root}/ids", pieces).create()


def ids(rows):
    return sorted(tuple(r) for r in rows.select("event_id", "timestamp", "metadata").collect())


def test_unseen_is_the_same_as_by_reading(spark):
    tables, kept = made(spark, pieces=1)  # crowded: many false alarms
    new = at(spark, range(0, 4 * DAY, 500)).unionByName(at(spark, range(0, DAY, 5000), T0 + 9))
    assert ids(kept.unseen(new)) == ids(unseen(new, tables.events()))
    for n, seconds in enumerate([range(0, 2 * DAY, 700), range(DAY, 3 * DAY, 1500)]):
        tables.write_events(at(spark, seconds), f"load-{n}")
        assert ids(kept.unseen(new)) == ids(unseen(new, tables.events()))  # a batch without filters is read
        kept.add(f"load-{n}")
        kept.add(f"load-{n}")
        assert kept.unread().count() == 0
        assert ids(kept.unseen(new)) == ids(unseen(new, tables.events()))
    assert kept.unseen(new.limit(0)).count() == 0


def test_only_doubtful_days_are_read(spark):
    tables, kept = made(spark)
    tables.write_events(at(spark, range(0, 5 * DAY, 1000)), "load-0")
    kept.add("load-0")
    asked = kept.maybe_stored(at(spark, [7, 173000, 3 * DAY + 11])).collect()
    assert sorted(r["maybe"] for r in asked) == [False, False, True]
    doubtful = kept.maybe_stored(at(spark, [7, 173000, 3 * DAY + 11])).where("maybe")
    plan = kept.days(doubtful)._jdf.queryExecution().toString()
    pruned = re.search(r"PartitionFilters: \[[^\]]*\]", plan)[0]
    assert re.findall(r"\d{4}-\d\d-\d\d", pruned) == ["2024-01-03"], pruned


def test_filters_merge(spark):
    tables, kept = made(spark)
    for n in range(3):
        tables.write_events(at(spark, range(n, DAY, 900)), f"load-{n}")
        kept.add(f"load-{n}")
    _, other = made(spark)
    merged = StoredIds(spark, other.source, other.root, 64)
    kept.merge_into(merged, "merge-1")
    assert merged.read().count() == merged.read().select("event_date", "piece").distinct().count()
    new = at(spark, range(DAY))
    held = lambda x: {r["event_id"] for r in x.maybe_stored(new).where("maybe").select("event_id").collect()}
    assert held(merged) == held(kept) >= {r["event_id"] for r in tables.events().select("event_id").collect()}
    assert len(held(kept)) < 288 + 0.05 * DAY
