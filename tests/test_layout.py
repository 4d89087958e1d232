"""Events along the curve: the same rows, and a filter on name or user skips most row groups."""

import tempfile
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from footfall.sources.layout import _range, curve, cut_points, merge_by_curve_into, write_by_curve
from footfall.sources.tables import Tables
from tests.test_rollup_and_metrics import events

NAMES = ["buy", "click", "view", "zoom"]


def groups(tables, column, value):
    """(row groups that may hold the value by their min and max, all row groups)"""
    hit = every = 0
    for path in Path(tables.path("events")).rglob("*.parquet"):
        data = pq.ParquetFile(path).metadata
        at = data.schema.names.index(column)
        for n in range(data.num_row_groups):
            kept = data.row_group(n).column(at).statistics
            hit, every = hit + (kept.min <= value <= kept.max), every + 1
    return hit, every


def test_both_keys_skip_row_groups(spark):
    root = tempfile.mkdtemp(prefix="footfall-")
    plain, merged = Tables(spark, f"{root}/plain").create(), Tables(spark, f"{root}/merged")
    rows = events(spark, [(NAMES[i * 7 % 4], "web", f"user_{i * 31 % 199}", i * 4) for i in range(20_000)])
    plain.write_events(rows, "load-1")
    merge_by_curve_into(plain, merged, "merge-1", rows_per_group=200)
    names = [c for c in rows.columns if c in plain.events().columns]
    assert merged.events().select(*names).exceptAll(plain.events().select(*names)).count() == 0
    assert merged.events().count() == 20_000
    for column, value, most in (("event_name", "click", 0.55), ("user_id", "user_77", 0.35)):
        hit, every = groups(merged, column, value)
        assert every > 50 and 0 < hit < most * every, (column, hit, every)
    by_name = Tables(spark, f"{root}/by_name").create()
    options = {"parquet.block.row.count.limit": "200"}
    by_name._write_by_day("events", rows, "load-1", options)
    hit, every = groups(by_name, "user_id", "user_77")
    assert hit > 0.9 * every  # the plain order skips nothing for a user


def test_ranges_and_curve(spark):
    rows = spark.createDataFrame([(f"{i:05d}",) for i in range(10_000)] + [(None,), ("",), ("~",)], "v string")
    cuts = cut_points(rows, "v")
    assert len(cuts) == 255
    got = rows.select("v", _range(F.col("v"), cuts).alias("at")).collect()
    assert all(r["at"] == sum(c <= r["v"] for c in cuts) for r in got if r["v"] is not None)
    assert [r["at"] for r in got if r["v"] is None] == [0]
    assert cut_points(rows.limit(0), "v") == [] and cut_points(rows.where("v = ''"), "v") == [""]
    parts = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 0, 1)], "a int, b int, c int")
    places = [r[0] for r in parts.select(curve([F.col(x) for x in "abc"])).collect()]
    assert places == [int("100" * 8, 2), int("010" * 8, 2), int("001" * 8, 2), 1 << 23 | 1]


def test_empty_and_one_place(spark):
    tables = Tables(spark, tempfile.mkdtemp(prefix="footfall-")).create()
    write_by_curve(tables, events(spark, [("v", "web", "u", 0)]).limit(0), "load-0")
    assert tables.events().count() == 0
    write_by_curve(tables, events(spark, [("v", "web", "u", 0)] * 500), "load-1")
    write_by_curve(tables, events(spark, [("v", "web", "u", 0)] * 400), "load-1")
    assert tables.events().count() == 400
