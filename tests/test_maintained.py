"""The maintained latest versions: only days that new batches touch are merged, and reading needs no merge."""

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from footfall.operators.latest import latest_versions
from footfall.sources.maintained import LatestEvents
from footfall.sources.tables import Tables
from tests.test_rollup_and_metrics import T0, events

DAY = 86400


def day_files(kept, day=""):
    return {x: x.stat().st_mtime_ns for x in Path(kept.base.path("events")).rglob("*.parquet") if day in str(x)}


def versions(rows):
    return sorted((r["event_id"], r["metadata"], r["created_at"]) for r in rows.select("event_id", "metadata", "created_at").collect())


def test_latest_events_as_batches_come(spark):
    root = tempfile.mkdtemp(prefix="footfall-")
    tables = Tables(spark, f"{root}/tables").create()
    kept = LatestEvents(spark, tables, f"{root}/latest").create()
    assert kept.read().count() == 0 and kept.merge() == 0

    def load(n, rows, at):
        tables.write_events(events(spark, [("v", "web", f"u{s}", s, f'{{"v":{n}}}') for s in rows], at), f"load-{n}")
        assert versions(kept.read()) == versions(latest_versions(tables.events().drop("batch_id")))

    load(0, range(0, 3 * DAY, 6000), T0)
    assert kept.merge() == 4
    before = day_files(kept)
    load(1, range(DAY, DAY + 20_000, 3000), T0 + 5)  # one day again, late
    assert [str(r["event_date"]) for r in kept.plan().collect()] == ["2024-01-02"]
    assert kept.merge() == 1 and kept.merge() == 0
    assert {k: v for k, v in day_files(kept).items() if k in before} == before
    assert {x.parts[-3] for x in day_files(kept).keys() - before.keys()} == {"event_date=2024-01-02"}
    load(2, range(0, 3 * DAY, 12_000), T0 - 5)  # older versions change nothing
    load(3, range(5 * DAY, 5 * DAY + 10), T0)
    merged = day_files(kept)
    assert kept.merge(least_small=100) == 0 and day_files(kept) == merged
    assert kept.merge(least_small=100, small=1) == 5  # as many bytes in larger files
    assert versions(kept.read()) == versions(latest_versions(tables.events().drop("batch_id")))


def test_a_merge_that_ends_midway_counts_for_nothing(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="footfall-")
    tables = Tables(spark, f"{root}/tables").create()
    kept = LatestEvents(spark, tables, f"{root}/latest").create()
    tables.write_events(events(spark, [("v", "web", f"u{s}", s) for s in range(20)]), "load-0")
    write = kept.base.write_events

    def breaks(rows, batch_id):
        write(rows, batch_id)
        raise RuntimeError("lost")

    monkeypatch.setattr(kept.base, "write_events", breaks)
    try:
        kept.merge()
    except RuntimeError:
        pass
    monkeypatch.undo()
    tables.write_events(events(spark, [("v", "web", "late", 50)]), "load-1")
    assert kept.read().count() == 21
    assert kept.merge() == 1 and kept.read().count() == 21 and kept.files().count() == 0
    assert kept.read().where(F.col("user_id") == "late").count() == 1
