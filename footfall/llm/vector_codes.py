"""Vector codes: product quantisation in whole numbers, with a trie over the distinct parts of all vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.tables import saved

PARTS = 8
SCALE = 4096
#: Whole numbers are held within this, so that a sum of squares over 2,000 components fits 64 bits.
HIGHEST = 1 << 25
_ROWS = 4096


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of each of the distinct ``parts``, sorted lexicographically: the nearest entry, the first of equals.

    The sorted parts are the leaves of a trie with one dimension to a level. A node is a range of rows that agree up to
    its level, with the distances of that prefix to all entries; a child adds one dimension to them, once for all leaves
    below it. Nodes are visited depth first from a stack, so what is held is the path and its open siblings. Where a
    single leaf is left below a child, its last dimensions are added together.
    """
    count, width = parts.shape
    chosen, least = np.zeros(count, np.int64), np.zeros(count, np.int64)
    stack = [(0, count, 0, np.zeros(len(entries), np.int64))] if count else []
    while stack:
        low, high, level, above = stack.pop()
        if level == width:  # rows that repeat a part
            chosen[low:high], least[low:high] = above.argmin(), above.min()
            continue
        values = parts[low:high, level]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        ends = np.append(starts[1:], high - low)
        single = ends - starts == 1
        leaves = low + starts[single]
        for at in range(0, len(leaves), _ROWS):
            rows = leaves[at : at + _ROWS]
            sums = np.repeat(above[None, :], len(rows), axis=0)
            for k in range(level, width):
                sums += (parts[rows, k][:, None] - entries[:, k]) ** 2
            chosen[rows] = sums.argmin(axis=1)
            least[rows] = sums[np.arange(len(rows)), chosen[rows]]
        for start, end in zip(starts[~single][::-1].tolist(), ends[~single][::-1].tolist()):
            stack.append((low + start, low + end, level + 1, above + (values[start] - entries[:, level]) ** 2))
    return chosen, least


def _whole(rows: DataFrame, vector_col: str) -> DataFrame:
    """``x``: the vector's components as whole numbers, rounded down; only rows whose components are all finite."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(HIGHEST))), F.lit(float(HIGHEST)))).cast("int"))
    return rows.where(finite).withColumn("x", held)


def _filled(width: int):
    """The vector continued by zeros up to ``width`` components."""
    return F.concat("x", F.array_repeat(F.lit(0), F.lit(width) - F.size("x")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def first_codebooks(kept: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """(part, entry, place): the parts of the vectors with the least ids, one for each id."""
    ids = [r["id"] for r in kept.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    of_first = F.col("id").isin([x for x in ids if x is not None]) | (F.col("id").isNull() & F.lit(None in ids))
    of_id = kept.where(of_first).groupBy("id").agg(F.min("x").alias("x")).orderBy(F.col("id").asc_nulls_last())
    found = np.array([r["x"] for r in of_id.collect()], np.int64).reshape(len(ids), width)
    return found.reshape(len(found), parts, width // parts).transpose(1, 0, 2)


def distinct_parts(kept: DataFrame, width: int, parts: int) -> DataFrame:
    """(part, x, n): the distinct parts at each position and how many vectors have them, sorted in ranges."""
    step = width // parts
    cut = F.expr(f"posexplode(transform(sequence(0, {parts - 1}), i -> slice(x, i * {step} + 1, {step})))")
    each = kept.select(cut).toDF("part", "x").groupBy("part", "x").agg(F.count("*").alias("n"))
    return saved(each.repartitionByRange("part", "x").sortWithinPartitions("part", "x"), "parts")


def _sums(found: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, total) per task and position: count and sum of the parts whose nearest entry it is."""
    step = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            position = batch.column("part").to_numpy()
            x, weight = _matrix(batch.column("x"), step), batch.column("n").to_numpy()
            for part in np.unique(position).tolist():
                rows = np.flatnonzero(position == part)
                entry, _ = nearest(x[rows], books[part])
                np.add.at(n[part], entry, weight[rows])
                np.add.at(total[part], entry, x[rows] * weight[rows, None])
        part, entry = np.nonzero(n)
        sums = pa.ListArray.from_arrays(np.arange(0, step * len(part) + 1, step, dtype=np.int32), total[part, entry].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), sums], ["part", "entry", "n", "total"])

    return found.mapInArrow(run, "part int, entry int, n long, total array<long>")


def _moved(found: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the mean of its parts, rounded down; an unused one stays."""
    each = _sums(found, books).select("part", "entry", "n", F.posexplode("total").alias("place", "total"))
    sums = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.copy()
    for r in sums.collect():  # no more rows than the codebooks have numbers
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def books_text(books: np.ndarray) -> str:
    """All numbers by part, entry and place, with commas between."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def train(kept: DataFrame, width: int, parts: int = PARTS, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """The codebooks (part, entry, place) after ``rounds`` rounds over all rows of ``kept`` (id, x)."""
    books = first_codebooks(kept, width, parts, entries)
    if books.size:
        found = distinct_parts(kept, width, parts)
        for _ in range(rounds):
            books = _moved(found, books)
    return books


def assigned(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows with ``code`` and ``error`` in place of ``x``; the distinct parts of each batch are looked up once."""
    parts, _, step = books.shape
    names = [c for c in kept.columns if c != "x"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(names).schema.fields) + ", code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), parts * step).reshape(batch.num_rows, parts, step)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for part in range(parts):
                found, at = np.unique(x[:, part], axis=0, return_inverse=True)
                entry, least = nearest(found, books[part])
                code[:, part], error = entry[at.reshape(-1)], error + least[at.reshape(-1)]
            text = code.tobytes().hex()
            codes = [text[2 * parts * n : 2 * parts * (n + 1)] for n in range(len(x))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(codes, pa.string()), pa.array(error)], [*names, "code", "error"])

    return kept.mapInArrow(run, kind)


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each row whose vector is whole.

    A component x counts as floor(4096 x). Vectors are cut into ``parts`` equal parts, and each position has a codebook
    of ``entries`` entries (256 at most): the parts of the vectors with the least ids, moved by ``rounds`` rounds of
    Lloyd's method in whole numbers over all rows. ``code`` names the nearest entry of each part, the first of equals,
    in two hexadecimal digits; ``error`` is the squared distance of the vector to its entries, ``label_error`` its sum
    over all rows with the label, and the hash is that of all entries.

    Each round reads the distinct parts, which stand sorted in ranges, once; a task sends one row per entry. The driver
    holds the codebooks, ``entries`` times as many numbers as a vector has components.

    Rows with a null vector, or null or non-finite components, are left out. Components beyond 2^13 either way count as
    that. A vector shorter than the longest, or one whose length ``parts`` does not divide, is continued by zeros. Of a
    repeated id the least vector stands for it among the first entries; rows without id come last there. Vectors
    without components have the code of zeros. With fewer ids than ``entries`` there are as many entries as ids; of
    an empty table there is nothing.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has two hexadecimal digits")
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kept = saved(_whole(named, "vector").select("id", "label", "x"), "vectors")
    width = kept.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0
    width = max(1, -(-width // parts)) * parts
    kept = kept.withColumn("x", _filled(width))
    books = train(kept, width, parts, entries, rounds)
    if not books.shape[1]:
        books = np.zeros((parts, 1, width // parts), np.int64)
    coded = saved(assigned(kept, books), "codes")
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    told = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return told.select("id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, width: int = 64, entries: int = 16, rounds: int = 6) -> str:
    """The same over a table ``embeddings`` whose vectors have ``width`` components, for DuckDB: one step per round."""
    step = width // parts
    near = """SELECT vec_id, part, p, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT v.*, b.entry, list_sum(list_transform(list_zip(v.p, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM parts v JOIN {book} b USING (part)) GROUP BY vec_id, part, p"""
    steps = [
        f"""kept AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS MATERIALIZED (
      SELECT vec_id, part, x[part * {step} + 1 : part * {step} + {step}] AS p FROM kept, (SELECT unnest(range({parts})) AS part)
    ), seeds AS (
      SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}
    ), book0 AS MATERIALIZED (
      SELECT part, entry, p AS e FROM parts JOIN seeds USING (vec_id)
    )"""
    ]
    for n in range(rounds):
        book = f"book{n}"
        steps.append(
            f"""near{n} AS MATERIALIZED ({near.format(book=book)}
    ), sums{n} AS (
      SELECT part, entry, place, sum(p[place + 1])::HUGEINT AS total, count(*) AS n
      FROM near{n}, (SELECT unnest(range({step})) AS place) GROUP BY ALL
    ), means{n} AS (
      SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY place) AS e FROM sums{n} GROUP BY part, entry
    ), book{n + 1} AS MATERIALIZED (
      SELECT part, entry, coalesce(m.e, b.e) AS e FROM {book} b LEFT JOIN means{n} m USING (part, entry)
    )"""
        )
    steps.append(
        f"""coded AS (
      SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
      FROM ({near.format(book=f"book{rounds}")}) GROUP BY vec_id
    ), digest AS (
      SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
    )"""
    )
    return "WITH " + ", ".join(steps) + """
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), digest"""
