"""All panels in one job: the same values, and each table read once."""

import tempfile

from footfall.operators.rollup import hourly_partials
from footfall.plans import dashboard
from footfall.sources.tables import Tables
from tests.test_rollup_and_metrics import T0, events

ROWS = [(["purchase", "view"][i % 2], ["web", "api"][i % 3 % 2], f"u{i % 7}", i * 1111, '{"price":1.1}' if i % 4 else "{}") for i in range(200)]
AS_OF = T0 + 200 * 1111


def test_refresh_is_all_panels(spark):
    tables = Tables(spark, tempfile.mkdtemp(prefix="footfall-")).create()
    rows = events(spark, ROWS)
    tables.write_events(rows, "load-1")
    tables.write_hourly(hourly_partials(rows), "load-1")
    hourly, stored = tables.hourly(), tables.events()
    found = dashboard.refresh(hourly, stored, AS_OF)
    got = sorted(map(tuple, found.collect()))

    want = []
    for panel, of, rows_of, keys in [
        ("b01_total_events", dashboard.total_events, hourly, 0),
        ("b02_unique_users", dashboard.unique_users, hourly, 0),
        ("b03_purchases", dashboard.purchases, hourly, 0),
        ("b04_active_campaigns", dashboard.active_campaigns, stored, 0),
        ("b05_total_revenue", dashboard.total_revenue, stored, 0),
        ("b06_avg_order_value", dashboard.avg_order_value, stored, 0),
        ("b07_revenue_over_time", dashboard.revenue_over_time, stored, 1),
        ("b08_events_over_time", dashboard.events_over_time, hourly, 1),
        ("b09_unique_users_over_time", dashboard.unique_users_over_time, hourly, 1),
        ("b10_events_by_channel", dashboard.events_by_channel, hourly, 1),
        ("b11_events_by_type", dashboard.events_by_type, hourly, 1),
        ("b12_events_by_type_channel", dashboard.events_by_type_and_channel, hourly, 2),
    ]:
        for r in of(rows_of, AS_OF).collect():
            want.append((panel, *[*r[:keys], "", ""][:2], float(r[keys])))
    for r in dashboard.top_campaigns(stored, AS_OF).collect():
        want += [("b13_top_campaigns", r[0], name, float(r[name])) for name in ("event_count", "unique_users")]
    assert got == sorted(want)

    plan = found._jdf.queryExecution().toString()
    assert "FileScan parquet" in plan and tables.root not in plan  # the panels read the kept sums, not the tables
    empty = dashboard.refresh(hourly.limit(0), stored.limit(0), AS_OF).collect()
    assert sorted((r["panel"], r["value"]) for r in empty) == [("b03_purchases", 0.0), ("b04_active_campaigns", 0.0)]
