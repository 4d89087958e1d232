"""Best-fit-decreasing packing, and the packed sequences as matrices of token ids with what attention needs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.packing import Placed, Stock, packed


class Capacities:
    """How many open sequences have which room left, as a segment tree: each node holds the sum below it."""

    def __init__(self, most: int):
        self._leaves = 1 << most.bit_length()
        self._sum = [0] * (2 * self._leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self._leaves
        while at:
            self._sum[at] += n
            at //= 2

    def least(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that some sequence has."""
        at = length + self._leaves
        if self._sum[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self._sum[at + 1]:
                at += 1
                while at < self._leaves:
                    at = 2 * at if self._sum[2 * at] else 2 * at + 1
                return at - self._leaves
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Placed], int]:
    """Best-fit decreasing over all pieces, equal ones at once: where they go, and how many sequences that makes.

    One by one, a piece would go to the fullest sequence that has room, and further pieces of its length to the same
    one until they no longer fit, since it is then the fullest of all. So each sequence takes as many as fit, and
    sequences with equal room are dealt with together.
    """
    stock, out, opened = Stock(counts), [], 0
    tree, open_ = Capacities(capacity), {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = tree.least(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
            each = min(room // length, left)
            whole = min(n, left // each)
            out += stock.place(length, whole, first, each, capacity - room)
            left -= whole * each
            if whole < n and left and left < each:
                out += stock.place(length, 1, first + whole, left, capacity - room)
                rests = [(first, whole, room - each * length), (first + whole, 1, room - left * length), (first + whole + 1, n - whole - 1, room)]
                left = 0
            else:
                rests = [(first, whole, room - each * length), (first + whole, n - whole, room)]
            for start, many, rest in rests:
                if many and rest:
                    open_.setdefault(rest, []).append((start, many))
                    tree.add(rest, many)
    return out, opened


def _matrix(capacity: int, pad: int):
    @F.pandas_udf("struct<input_ids:binary,cu_seqlens:array<int>,position_ids:binary>")
    def rows(pieces: pd.Series, size: pd.Series) -> pd.DataFrame:
        out = []
        for parts, width in zip(pieces, size):
            ids = np.full(capacity, pad, f"<u{width}")
            positions = np.zeros(capacity, "<u2" if capacity <= 1 << 16 else "<u4")
            ends = [0]
            for x in parts:
                at, n = x["offset"], x["length"]
                ids[at : at + n] = np.frombuffer(x["ids"], ids.dtype)
                positions[at : at + n] = np.arange(n)
                ends.append(at + n)
            out.append((ids.tobytes(), ends, positions.tobytes()))
        return pd.DataFrame(out, columns=["input_ids", "cu_seqlens", "position_ids"])

    return rows


def token_matrices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, path: str | None = None, end: int = 0, pad: int = 0) -> DataFrame:
    """One row per packed sequence: (sequence_id, doc_ids, starts, n_tokens, input_ids, cu_seqlens, position_ids, size).

    ``input_ids`` is the sequence as ``capacity`` little-endian numbers of ``size`` bytes, filled up with ``pad``;
    rows in the order of ``sequence_id`` are a matrix in memory. ``cu_seqlens`` holds 0 and the end of each segment,
    ``position_ids`` counts from 0 again in every segment (two bytes each, four above 65,536). Segment k is the piece of
    document ``doc_ids[k]`` from its token ``starts[k]`` on, so every text is restored from the matrix without loss.

    Documents longer than a sequence fill whole sequences first. A null or empty text is the id ``end`` alone. Rows that
    repeat an id are packed each on their own, a row without id keeps its null; an empty table gives no sequence.
    """
    parts = packed(docs, id_col, text_col, capacity, plan, path, end)
    parts = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "id", "start", "length", "ids"))).alias("pieces"), F.max("size").alias("size"), F.sum("length").alias("n_tokens"))
    parts = parts.withColumn("x", _matrix(capacity, pad)("pieces", "size"))
    return parts.select("sequence_id", F.col("pieces.id").alias("doc_ids"), F.col("pieces.start").alias("starts"), "n_tokens", "x.*", "size")


def write_matrices(matrices: DataFrame, folder: str, rows_per_file: int = 100_000) -> None:
    """The sequences as Parquet files in the order of their ids."""
    rows = matrices.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id")
    rows.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
