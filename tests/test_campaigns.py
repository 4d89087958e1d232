"""Panels from campaign states equal those from the events, and read the events only where they must."""

import random
import tempfile

from pyspark.sql import functions as F

from footfall.plans import dashboard
from footfall.sources.campaigns import CampaignStates
from footfall.sources.tables import Tables
from tests.test_rollup_and_metrics import T0, events

AS_OF = T0 + 30 * 3600 + 1234  # the day cuts an hour


def batch(spark, names, seed):
    draw = random.Random(seed)
    rows = events(spark, [("view", "web", f"u{i % 13}", draw.randrange(0, 31 * 3600)) for i in range(300)])
    picked = F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.xxhash64("timestamp", F.lit(seed)), F.lit(len(names))) + 1).cast("int"))
    return rows.withColumn("campaign_id", picked)


def made(spark, length, names=(None, "", "a", "b", "a", "a", "c")):
    root = tempfile.mkdtemp(prefix="footfall-")
    tables = Tables(spark, f"{root}/tables").create()
    states = CampaignStates(spark, tables, f"{root}/states", length).create()
    for n in range(3):
        tables.write_events(batch(spark, [*names, f"new{n}", *(f"{n}-{i}" for i in range(5 * n))], n), f"load-{n}")
    return tables, states


def same(tables, states, k=4):
    want = dashboard.active_campaigns(tables.events(), AS_OF).first()[0]
    assert states.active_campaigns(AS_OF).first()[0] == want
    assert states.top_campaigns(AS_OF, k).collect() == dashboard.top_campaigns(tables.events(), AS_OF, k).collect()


def test_states_give_the_panels_at_any_point(spark):
    tables, states = made(spark, length=3)
    same(tables, states)  # no batch has states yet
    for n in range(3):
        states.add(f"load-{n}")
        same(tables, states)
    numbers = states.names().collect()
    assert len({r["number"] for r in numbers}) == len({r["campaign_id"] for r in numbers}) == len(numbers) == max(r["number"] for r in numbers)
    states.add("load-1")  # again
    assert states.names().count() == len(numbers)
    same(tables, states)


def test_lists_settle_the_top_or_say_that_they_do_not(spark):
    tables, states = made(spark, length=100)
    for n in range(3):
        states.add(f"load-{n}")
    found = {r[0] for r in states.candidates(AS_OF, 2).collect()}
    assert {r[0] for r in dashboard.top_campaigns(tables.events(), AS_OF, 2).collect()} == found  # nothing is left out: no others
    short = CampaignStates(spark, tables, tempfile.mkdtemp(prefix="footfall-"), 1).create()
    for n in range(3):
        short.add(f"load-{n}")
    assert short.candidates(AS_OF, 10) is None
    same(tables, short, 10)


def test_only_the_hour_the_day_cuts_is_read(spark):
    tables, states = made(spark, length=100)
    for n in range(3):
        states.add(f"load-{n}")
    _, _, rest = states._day(AS_OF)
    assert {r[0] for r in rest.select(F.date_trunc("hour", "ts").cast("long")).distinct().collect()} == {(AS_OF - 86400) // 3600 * 3600}
    whole = T0 + 30 * 3600  # on the hour: nothing is cut
    assert states._day(whole)[2].count() == 0
    assert states.active_campaigns(whole).first()[0] == dashboard.active_campaigns(tables.events(), whole).first()[0]


def test_nothing_stored(spark):
    root = tempfile.mkdtemp(prefix="footfall-")
    tables = Tables(spark, f"{root}/tables").create()
    states = CampaignStates(spark, tables, f"{root}/states").create()
    assert states.active_campaigns(AS_OF).first()[0] == 0 and states.top_campaigns(AS_OF).count() == 0
