"""Unique users of any range of hours: a user counts in the first hour of the range they are in.

That hour is the one before which they were last seen before the range. So what a range needs of the users is how many of
an hour were last seen in which earlier hour, and these numbers add up over any split of the users. All is counted from the
hashes in the rollup's states, in steps that each hold a share of a fixed kind: a part of a name's users, a day, or the
questions that start on one day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.sketch_bytes import ALL, hashes

#: About so many hashes make a part of a name's users, and at least so many of a state go to one part.
PART, SHARE = 1 << 18, 16

#: So many rows, cells or groups are held or handed on at once.
AT_ONCE = 1 << 18

# Where a state does not hold all of its hashes, ranges with its hour count the hashes below a bound that all their hours
# hold, a power of 2^(1/STEPS), and scale up. These bounds are told by number; 0 is all hashes.
STEPS = 8


def _bound_number(bounds: np.ndarray) -> np.ndarray:
    return np.where(bounds == ALL, 0, np.ceil(-STEPS * np.log2(bounds / 2.0**63))).astype(np.int64)


def _scaled(n: np.ndarray, number: np.ndarray) -> np.ndarray:
    return np.rint(n * 2.0 ** (number / STEPS)).astype(np.int64)


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The values up to each end as one binary value."""
    offsets = np.concatenate([[0], ends]) * values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _runs(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _place(hour: np.ndarray, days: np.ndarray) -> np.ndarray:
    """How many hours of the days, which are in order, lie before the hour."""
    at = np.searchsorted(days, hour // 24)
    return at * 24 + np.where(days[np.minimum(at, len(days) - 1)] == hour // 24, hour % 24, 0)


_PARTS = "event_name string, part bigint, channel string, hour bigint, event_count bigint, bound bigint, hashes binary"


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each state, dealt out to the parts of its name."""
    for batch in batches:
        for begin, end, bounds, n, found in hashes(batch["unique_users_state"]):
            rows = batch.slice(begin, end - begin)
            parts = rows["parts"].to_numpy()
            first = np.cumsum(parts) - parts
            to = np.repeat(first, n) + found % np.repeat(parts, n)
            ends = np.cumsum(np.bincount(to, minlength=parts.sum()))
            of, part = np.repeat(np.arange(len(parts)), parts), _runs(parts)
            again = rows.take(pa.array(of))
            events = np.where(part == 0, again["event_count"].to_numpy(), 0)
            values = [again["event_name"], pa.array(part), again["channel"], again["hour"], pa.array(events), pa.array(bounds[of])]
            yield pa.RecordBatch.from_arrays([*values, _blobs(found[np.argsort(to, kind="stable")], ends)], ["event_name", "part", "channel", "hour", "event_count", "bound", "hashes"])


_CELLS = "event_name string, day bigint, of string, events binary, bounds binary, cells binary"


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a part of a name's users, by day: the cells (bound, hour of the day, hours since last seen or 0, users)."""
    rows = pa.Table.from_batches(list(batches))
    hour, events, bounds = (rows[x].to_numpy() for x in ("hour", "event_count", "bound"))
    codes = rows["channel"].combine_chunks().dictionary_encode()
    names, channel = codes.dictionary.to_pylist(), codes.indices.fill_null(-1).to_numpy()
    texts = [x.as_buffer() for x in rows["hashes"].combine_chunks()]
    row = np.repeat(np.arange(len(texts)), [len(x) // 8 for x in texts])
    every = np.frombuffer(b"".join(texts), "<i8")
    order = np.lexsort((hour[row], every))
    every, row = every[order], row[order]
    low = int(hour.min()) // 24
    days = int(hour.max()) // 24 - low + 1
    number = _bound_number(bounds)
    for code, of in enumerate([None, *names], -1):
        met = np.ones(len(hour), bool) if of is None else channel == code
        user, at = (every, hour[row]) if of is None else (every[met[row]], hour[row[met[row]]])
        same = user[1:] == user[:-1]
        other = np.concatenate([[True], ~(same & (at[1:] == at[:-1]))])[: len(user)]
        user, at = user[other], at[other]
        gap = np.zeros(len(user), np.int64)
        gap[1:] = np.where(user[1:] == user[:-1], at[1:] - at[:-1], 0)
        place = hour[met] - low * 24
        totals, numbers = np.zeros(days * 24, np.int64), np.zeros(days * 24, np.int64)
        np.add.at(totals, place, events[met])
        np.maximum.at(numbers, place, number[met])
        cells = []
        for k in np.unique(np.append(numbers, 0)):
            held = user < 2.0 ** (63 - k / STEPS) if k else slice(None)
            found, users = np.unique((at[held] - low * 24) * (days * 24) + gap[held], return_counts=True)
            cells.append(np.column_stack([np.full(len(found), k), found // (days * 24), found % (days * 24), users]))
        cells = np.concatenate(cells)
        cells = cells[np.argsort(cells[:, 1] // 24, kind="stable")]
        ends = np.searchsorted(cells[:, 1] // 24, np.arange(days), side="right")
        cells[:, 1] %= 24
        by_day = np.arange(1, days + 1) * 24
        on = np.unique(place // 24)
        values = [pa.repeat(rows["event_name"][0], len(on)), pa.array(on + low), pa.repeat("" if of is None else f"={of}", len(on))]
        blobs = [_blobs(totals, by_day), _blobs(numbers, by_day), _blobs(cells.astype(np.int32), ends)]
        yield pa.RecordBatch.from_arrays([*values, *(x.take(pa.array(on)) for x in blobs)], ["event_name", "day", "of", "events", "bounds", "cells"])


_BLOCKS = "event_name string, day bigint, of string, later bigint, block binary"


def _added(pieces: list[np.ndarray]) -> list[np.ndarray]:
    """The same cells in one piece, each once."""
    cells = np.concatenate(pieces)
    order = np.lexsort(cells[:, :3].T)
    cells = cells[order]
    first = np.concatenate([[True], (cells[1:, :3] != cells[:-1, :3]).any(axis=1)])[: len(cells)]
    users = np.add.reduceat(cells[:, 3], np.nonzero(first)[0]) if len(cells) else cells[:, 3]
    return [np.column_stack([cells[first][:, :3], users])]


def _day_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each day that questions start on, what they need of one day of a name: who is there that was not there since they start.

    A block holds 64-bit numbers: 24 of events, of bounds, of users of each hour, of users since the day began; and for each
    bound its number and, for the 24 hours of the start and the 24 of the day, the users not seen in between.
    """
    asked, of, held = set(), {}, 0
    for batch in batches:
        asked |= {int(x) for x in batch["start_day"].to_numpy(zero_copy_only=False)[batch["of"].is_null().to_numpy(zero_copy_only=False)]}
        for i in np.nonzero(batch["of"].is_valid().to_numpy(zero_copy_only=False))[0]:
            day, name, now = batch["day"][i].as_py(), batch["event_name"][i], of.setdefault(batch["of"][i].as_py(), [0, 0, []])
            now[0] = now[0] + np.frombuffer(batch["events"][i].as_buffer(), np.int64)
            now[1] = np.maximum(now[1], np.frombuffer(batch["bounds"][i].as_buffer(), np.int64))
            now[2].append(np.frombuffer(batch["cells"][i].as_py(), np.int32).reshape(-1, 4).astype(np.int64))
            held += len(now[2][-1])
            if held > 8 * AT_ONCE:
                for x in of.values():
                    x[2] = _added(x[2])
                held = 0
    if not asked or not of:
        return
    starts = np.array(sorted(asked))
    days = np.array(sorted({*asked, day}))
    wide = len(days) * 24
    for key, (events, bounds, pieces) in of.items():
        cells = np.concatenate(pieces)
        here, since = np.zeros(24, np.int64), np.zeros(24, np.int64)
        upto = np.maximum.accumulate(bounds)
        parts = []
        for k in np.unique(cells[:, 0]):
            _, hour, gap, users = cells[cells[:, 0] == k].T
            # In column j: users last seen before the j-th hour of these days, or never.
            column = np.where(gap > 0, _place(day * 24 + hour - gap + 1, days), 0)
            unseen = np.bincount(hour * wide + column, weights=users, minlength=24 * wide).reshape(24, wide).astype(np.int64).cumsum(axis=1)
            here[bounds == k] = unseen[np.arange(24), wide - 24 + np.arange(24)][bounds == k]
            since[upto == k] = unseen[:, wide - 24].cumsum()[upto == k]
            parts.append((int(k), unseen))
        head = np.concatenate([events, bounds, _scaled(here, bounds), _scaled(since, upto)])
        blocks = []
        for start in starts:
            at = int(np.searchsorted(days, start)) * 24
            found = [(k, unseen[:, at : at + 24].T) for k, unseen in parts]
            if start == day:
                found = [(k, np.triu(x)) for k, x in found]
            blocks.append(np.concatenate([head, *(np.concatenate([[k], x.ravel()]) for k, x in found)]))
        blocks = np.concatenate(blocks)
        ends = np.arange(1, len(starts) + 1) * (len(blocks) // len(starts))
        values = [pa.repeat(name, len(starts)), pa.array(starts), pa.repeat(key, len(starts)), pa.repeat(day, len(starts))]
        yield pa.RecordBatch.from_arrays([*values, _blobs(blocks, ends)], ["event_name", "day", "of", "later", "block"])


class _Span:
    """The numbers of one channel, or of all, for ranges that start on one day; over the days that hold events."""

    def __init__(self, day: int, blocks: dict[int, np.ndarray]):
        self.start, self.on = day * 24, np.array(sorted(blocks))
        size = len(blocks) * 24
        self.events, bounds, self.here, self.since = np.concatenate([blocks[x][:96].reshape(4, 24) for x in self.on], axis=1)
        unseen = {}
        for n, x in enumerate(self.on):
            for users in blocks[x][96:].reshape(-1, 577):
                unseen.setdefault(int(users[0]), np.zeros((24, size), np.int64))[:, n * 24 : n * 24 + 24] = users[1:].reshape(24, 24)
        hour = np.repeat(self.on * 24, 24) + np.tile(np.arange(24), len(self.on))
        self.keys = pa.array(np.char.replace(np.datetime_as_string((hour * 3600).astype("datetime64[s]")), "T", " "))
        self.before = np.concatenate([[0], self.events.cumsum()])
        self.present = np.nonzero(self.events)[0]
        most = np.maximum.accumulate(np.where(hour < self.start + np.arange(24)[:, None], 0, bounds), axis=1)
        self.unique = np.zeros((24, size), np.int64)
        for k, x in unseen.items():
            self.unique = np.where(most == k, _scaled(x.cumsum(axis=1), np.int64(k)), self.unique)

    def total(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.before[_place(high, self.on)] - self.before[_place(low, self.on)]

    def users(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of ranges that start on the first day, or with a later day and end on it; what it says of empty ones means nothing."""
        at, end = low - self.start, np.maximum(_place(high, self.on) - 1, 0)
        return np.where(at < 24, self.unique[np.minimum(at, 23), end], self.since[end])

    def hours(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        first = np.searchsorted(self.present, _place(low, self.on))
        n = np.searchsorted(self.present, _place(high, self.on)) - first
        at = self.present[np.repeat(first, n) + _runs(n)]
        return n, self.keys.take(pa.array(at)), self.events[at], self.here[at]

    def days(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        first = np.searchsorted(self.on, low // 24)
        n = np.searchsorted(self.on, (high - 1) // 24, side="right") - first
        of = np.repeat(np.arange(len(n)), n)
        at = first[of] + _runs(n)
        begin, end = np.maximum(low[of], self.on[at] * 24), np.minimum(high[of], self.on[at] * 24 + 24)
        total = self.total(begin, end)
        some = total > 0
        return np.bincount(of[some], minlength=len(n)), self.keys.take(pa.array(at[some] * 24)), total[some], self.users(begin, end)[some]


QUESTION = ["event_name", "channel", "first", "after", "group_by"]
_GROUPS = "array<struct<key:string,total_count:bigint,unique_users:bigint>>"
_ANSWERS = f"event_name string, channel string, first bigint, after bigint, group_by string, total_count bigint, unique_users bigint, grouped {_GROUPS}"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers to the questions about one name that start on one day."""
    blocks, questions = {}, []
    for batch in batches:
        is_block = batch["block"].is_valid()
        for row in batch.filter(is_block).select(["of", "later", "block"]).to_pylist():
            blocks.setdefault(row["of"], {})[row["later"]] = np.frombuffer(row["block"], np.int64)
        questions.append(batch.filter(pc.invert(is_block)).select(["day", *QUESTION]))
    asked = pa.Table.from_batches(questions)
    if not blocks or not len(asked):
        return
    day = asked["day"][0].as_py()
    spans = {of: _Span(day, x) for of, x in sorted(blocks.items())}
    for kind in asked.select(["channel", "group_by"]).group_by(["channel", "group_by"]).aggregate([]).to_pylist():
        of = f"={kind['channel']}" if kind["channel"] else ""
        if of not in spans:
            continue
        met = pc.and_(pc.equal(asked["channel"], kind["channel"]), pc.equal(asked["group_by"], kind["group_by"]))
        mine = asked.filter(met)
        low, high = mine["first"].to_numpy(), mine["after"].to_numpy()
        some = spans[of].total(low, high) > 0
        mine, low, high = mine.filter(pa.array(some)), low[some], high[some]
        most = len(spans) if kind["group_by"] == "channel" else high - low
        step = np.cumsum(np.broadcast_to(most, len(low))) // AT_ONCE
        for at in np.split(np.arange(len(low)), np.nonzero(np.diff(step))[0] + 1):
            if len(at):
                yield _answered(mine.take(pa.array(at)), low[at], high[at], of, kind["group_by"], spans)


def _answered(asked: pa.Table, low: np.ndarray, high: np.ndarray, of: str, group_by: str, spans: dict[str, _Span]) -> pa.RecordBatch:
    own = spans[of]
    if group_by == "hour":
        n, keys, total, users = own.hours(low, high)
    elif group_by == "day":
        n, keys, total, users = own.days(low, high)
    else:
        names = [x for x in spans if x and of in ("", x)] if group_by else []
        each = np.array([[spans[x].total(low, high), spans[x].users(low, high)] for x in names], np.int64).reshape(-1, 2, len(low))
        some = each[:, 0].T > 0
        n, (total, users) = some.sum(axis=1), each.transpose(1, 2, 0)[:, some]
        keys = pa.array([x[1:] for x in names], pa.string()).take(pa.array(np.nonzero(some)[1]))
    groups = pa.StructArray.from_arrays([keys, pa.array(total), pa.array(users)], ["key", "total_count", "unique_users"])
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    values = [pa.array(own.total(low, high)), pa.array(own.users(low, high)), pa.ListArray.from_arrays(pa.array(ends), groups)]
    found = asked.select(QUESTION).combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays([*found.columns, *values], [*QUESTION, "total_count", "unique_users", "grouped"])


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def answers(questions: DataFrame, hours: DataFrame, parts: Column) -> DataFrame:
    """(QUESTION, total_count, unique_users, grouped) for each distinct question that meets events.

    ``questions`` ask for the hours from ``first`` to before ``after``; '' as channel means any. ``hours`` has one row per
    (event_name, channel, hour) with event_count and unique_users_state, hours counted from 1970 on; ``parts`` says into how
    many parts the users of its name are split. Groups are told by their channel or the text of the hour they start with.
    """
    tasks = _tasks(questions)  # little is sent and much is counted: keep all tasks busy, however few bytes there are
    rows = hours.select("event_name", "channel", "hour", "event_count", "unique_users_state", parts.alias("parts"))
    dealt = rows.where("event_name IS NOT NULL").mapInArrow(_dealt, _PARTS).repartition(tasks, "event_name", "part")
    cells = dealt.groupBy("event_name", "part").applyInArrow(_last_seen, _CELLS)

    questions = questions.select(F.floor(F.col("first") / 24).alias("day"), *QUESTION).distinct()
    reach = questions.groupBy("event_name", F.col("day").alias("start_day")).agg(F.max(F.floor((F.col("after") - 1) / 24)).alias("last"))
    starts = reach.select("event_name", F.expr("explode(sequence(start_day, last))").alias("day"), "start_day")
    met = cells.unionByName(starts, allowMissingColumns=True).repartition(tasks, "event_name", "day")
    blocks = met.groupBy("event_name", "day").applyInArrow(_day_blocks, _BLOCKS)
    met = blocks.unionByName(questions, allowMissingColumns=True).repartition(tasks, "event_name", "day")
    return met.groupBy("event_name", "day").applyInArrow(_answers, _ANSWERS)
