"""Packing by minimum bin slack: each window takes the multiset of remaining lengths that fills it best."""

from __future__ import annotations

from pyspark.sql import DataFrame

from footfall.llm.packing import Placed, Stock, packed


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of all multisets of the lengths the one with the largest sum up to ``room``, as {length: how many}.

    Subset sums are the bits of one number. A count is split into parts of 1, 2, 4, ... and a rest, each part shifts
    the bits once, and the bits before every shift are kept to find the counts on the way back. Longer lengths come
    first, so short ones are used only where they are needed.
    """
    mask, reached, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        n, part = min(counts[length], room // length), 1
        while n > 0 and not reached >> room & 1:
            part = min(part, n)
            steps.append((length, part, reached))
            reached |= reached << (length * part) & mask
            n, part = n - part, part * 2
    total, chosen = reached.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            chosen[length] = chosen.get(length, 0) + part
    return chosen


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Placed], int]:
    """Where all pieces go, and how many sequences that makes.

    A window starts with the longest piece left and is completed by ``fullest``. The pattern is used for as many
    windows as the counts allow. If it leaves a gap, no remaining piece fits in it: the longest one is cut and fills
    it. When less than a window is left, windows of the largest power of two follow, which need no padding either.
    """
    stock, out, first = Stock(counts), [], 0
    while stock.count:
        total = sum(n * c for n, c in stock.count.items()) if sum(stock.count.values()) <= capacity else capacity
        room = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        longest = max(stock.count)
        if longest > room:
            out += stock.place(longest, 1, first, 1, 0, room)
            first += 1
            continue
        rest = dict(stock.count)
        rest[longest] -= 1
        chosen = fullest({n: c for n, c in rest.items() if c}, room - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        gap = room - sum(n * c for n, c in chosen.items())
        windows = min(stock.count[n] // c for n, c in chosen.items())
        cut = 0
        if gap:
            cut = max((n for n, c in stock.count.items() if c > chosen.get(n, 0)), default=0)
            if cut:
                windows = min(windows, stock.count[cut] // (chosen.get(cut, 0) + 1))
        if room < capacity:
            windows = 1
        offset = 0
        for n in sorted(chosen, reverse=True):
            out += stock.place(n, windows, first, chosen[n], offset)
            offset += n * chosen[n]
        if cut:
            out += stock.place(cut, windows, first, 1, offset, gap)
        first += windows
    return out, first


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, path: str | None = None, end: int = 0) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset, size): all documents in sequences of ``capacity`` ids.

    A document's ids are those of its text by the vocabulary file ``path`` (tokens.default_path) and ``end``. Each id
    is in exactly one piece; the pieces of a sequence follow each other from offset 0. Sequences are full, but for the
    last few, which hold a power of two of ids each.

    A null or empty text is the id ``end`` alone. Rows that repeat an id are packed each on their own, a row without id
    keeps its null. Of an empty table there are no sequences.
    """
    return packed(docs, id_col, text_col, capacity, plan, path, end)
