"""Document fingerprints: every shingle hash below a fixed share of all hashes, so that sketches merge and compare.

Shingles are runs of ``WIDTH`` bytes of UTF-8, so texts without spaces have as many as others. A shingle is kept or not
by its own hash alone. What one document keeps another that holds the shingle keeps too, so shares of sketches estimate
shares of shingles whatever the sizes of the two documents, and the sketch of two texts' shingles together is the merged
sketch of both. Texts with few shingles keep their ``LEAST`` lowest hashes, which are all they have below that number:
short texts are compared exactly. ``reach`` tells from a sketch alone up to which hash it is complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from footfall.llm import words
from footfall.llm.tables import by_text, parts_of, saved

SCALE = 64
LEAST = 32
WIDTH = 12
_PIECE = 1 << 20
_END = np.uint64(0xFFFFFFFFFFFFFFFF)


def _below(scale: int) -> np.uint64:
    return np.uint64((1 << 64) // scale - 1)


def hashes(data: bytes, width: int) -> np.ndarray:
    """One hash per run of ``width`` bytes; of fewer bytes the whole is the only run, of none there is none."""
    each = words.byte_hashes(data)
    if 0 < len(each) < width:
        return words.runs(each, len(each)) + np.uint64(len(each))
    return words.runs(each, width)


def sketch(found: np.ndarray, scale: int = SCALE, least: int = LEAST) -> np.ndarray:
    """The distinct hashes below 1/scale of their range; if they are fewer than ``least``, the lowest ones instead."""
    low = np.unique(found[found <= _below(scale)])
    return low if len(low) >= least else np.unique(found)[:least]


def sketch_of(text: str, width: int, scale: int = SCALE, least: int = LEAST) -> np.ndarray:
    """The sketch of a whole text's UTF-8 bytes, MB by MB, so that a long text takes no more memory than a short one."""
    data = text.encode()
    kept = sketch(hashes(data[: _PIECE + width - 1], width), scale, least)
    for at in range(_PIECE, len(data) - width + 1, _PIECE):
        kept = merged(kept, hashes(data[at : at + _PIECE + width - 1], width), scale, least)
    return kept


def reach(kept: np.ndarray, scale: int = SCALE, least: int = LEAST) -> np.uint64:
    """The hash up to which the sketch holds all hashes of its document."""
    if len(kept) < least:
        return _END
    return max(kept[-1], _below(scale))


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE, least: int = LEAST) -> np.ndarray:
    """The sketch of the union of both documents' shingles."""
    return sketch(np.concatenate([a, b]), scale, least)


def _met(a: np.ndarray, b: np.ndarray, scale: int, least: int) -> tuple[int, int, int]:
    """How many hashes a, b and both have, where both are complete."""
    end = min(reach(a, scale, least), reach(b, scale, least))
    a, b = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    if not len(a) or not len(b):
        return len(a), len(b), 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return len(a), len(b), int((b[at] == a).sum())


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE, least: int = LEAST) -> float:
    """An estimate of the Jaccard similarity of the two documents' shingles; of two without any, 1."""
    n, m, both = _met(a, b, scale, least)
    return both / (n + m - both) if n + m else 1.0


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE, least: int = LEAST) -> float:
    """An estimate of the share of a's shingles that b has too; of a document without any, 1.

    A short document keeps hashes that a long one drops, so they are compared as far as both reach. Where that leaves
    none of a's, nothing of it is known in b and the estimate is 0.
    """
    n, _, both = _met(a, b, scale, least)
    return both / n if n else float(not len(a))


def packed(kept: np.ndarray) -> bytes:
    return kept.astype(">u8").tobytes()


def written(kept: np.ndarray) -> str:
    """Sixteen hexadecimal digits for each hash, in rising order."""
    return packed(kept).hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """(id, fingerprint) for each row: the sketch of its whole text, over shingles of ``width`` bytes.

    A null or empty text has an empty fingerprint. Rows that repeat an id, or have none, are read each on their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return by_text(rows, "fingerprint string", lambda: lambda text: (written(sketch_of(text or "", width, scale, least)),))


def merged_by(sketches: DataFrame, group: str, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """(group, fingerprint): the sketch of all shingles of each group's documents, by SQL functions alone.

    Hashes are made distinct before they meet, and only the ``least`` lowest of those above the share are collected.
    """
    hash_ = F.explode(F.expr("transform(sequence(1, length(fingerprint), 16), x -> substr(fingerprint, x, 16))"))
    held = sketches.where("fingerprint != ''").select(F.col(group).alias("group"), hash_.alias("hash")).distinct()
    low = F.col("hash") <= f"{int(_below(scale)):016x}"
    ranked = held.where(~low).withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("hash"))).where(F.col("place") <= least)
    every = held.where(low).select("group", "hash", F.lit(True).alias("low")).unionByName(ranked.select("group", "hash", F.lit(False).alias("low")))
    found = every.groupBy("group").agg(F.array_sort(F.collect_list(F.when(F.col("low"), F.col("hash")))).alias("low"), F.array_sort(F.collect_list("hash")).alias("all"))
    kept = F.when(F.size("low") >= least, F.col("low")).otherwise(F.slice("all", 1, least))
    groups = sketches.select(F.col(group).alias("group")).distinct()
    named = groups.join(found.select(F.col("group").alias("of"), F.array_join(kept, "").alias("fingerprint")), F.col("group").eqNullSafe(F.col("of")), "left")
    return named.select(F.col("group").alias(group), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


# Each text beside the next one ------------------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, given up for as many of the first characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, contained_next double"
_SENT = "range int, id long, digest long, copies long, packed binary"
_WRITTEN = f"range int, first boolean, id long, packed binary, copies long, {_RESULT}"
_LAST = (1 << 63) - 1


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def _ranges(keys: np.ndarray, digests: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each row by its key; rows of a key that fills several ranges are dealt to them by their digests."""
    low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    share = (digests.astype(np.float64) + 2.0**63) / 2.0**64
    return np.minimum(low + (share * (high - low + 1)).astype(np.int64), high).astype(np.int32)


def _sent(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """One row for equal rows of a batch, with how many they are, the range it goes to, and its text compressed."""
    fields = to_arrow_schema(StructType.fromDDL(_SENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            found: dict[tuple, int] = {}
            for x, text in zip(ids.to_pylist(), texts):
                key = (x, _digest((text.as_py() or "").encode()))
                found[key] = found.get(key, 0) + 1
            keys = np.array([_LAST if x is None else ~x for x, _ in found], np.int64)
            ranges = dict(zip(found, _ranges(keys, np.array([d for _, d in found], np.int64), bounds).tolist()))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for at, end in parts_of(sizes + 64):
                out = []
                for x, text in zip(ids.slice(at, end - at).to_pylist(), texts.slice(at, end - at)):
                    data = (text.as_py() or "").encode()
                    key = (x, _digest(data))
                    if copies := found.pop(key, 0):
                        out.append((ranges[key], *key, copies, pack.compress(data)))
                yield _batch(out, fields)

    return rows.mapInArrow(run, _SENT)


def _batch(out: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, fields)], schema=fields)


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_next) for each row.

    Rows stand in a ring by falling id; the next of the last is the first. The edited text of a row has its last
    floor(n_chars / 2) characters replaced by as many of the first of the next row's text, or by all of them if it has
    fewer. ``near_edited`` and ``near_next`` are the likeness of the row's fingerprint to that of its edited text and to
    the next row's; ``contained_next`` estimates which share of its shingles the next row's text holds.

    Rows go to ranges of ids of about as many rows each, compressed, and each task reads its range once, in order, with
    two texts in memory. Only the first and the last text of a range are kept, to meet those of the ranges beside it.
    The driver sees the bounds of the ranges, one number each.

    A null text is empty. Rows that repeat an id stand in the order of a digest of their texts, so equal rows are each
    other's next; they are counted where they are read and sent once, and an id that fills several ranges is dealt to
    them by that digest. Rows without id come last. A single row is its own next. Of an empty table there is nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [n / ranges for n in range(1, ranges)] or [0.5]
    key = F.coalesce(F.bitwise_not("id"), F.lit(_LAST))
    bounds = rows.agg(F.percentile_approx(key, shares, F.lit(10 * max(1000, ranges))).alias("x")).first()["x"]
    bounds = np.array(bounds if ranges > 1 and bounds else [], np.int64)
    sent = _sent(rows, bounds).repartitionById(ranges, F.col("range"))
    sent = sent.sortWithinPartitions("range", F.col("id").desc_nulls_last(), "digest").select("range", "id", "copies", "packed")
    fields = to_arrow_schema(StructType.fromDDL(_WRITTEN))

    def compared(own_text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
        changed = edited(own_text, following)
        other = own if changed == own_text else sketch_of(changed, width, scale, least)
        near = (likeness(own, x, scale, least) for x in (other, theirs))
        return len(own_text), hashlib.sha256(changed.encode()).hexdigest(), packed(own), packed(other), *near, containment(own, theirs, scale, least)

    none = (None,) * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        before = None
        for batch in batches:
            sizes = pc.binary_length(batch.column("packed")).to_numpy(zero_copy_only=False)
            for at, end in parts_of(4 * sizes + 64):
                out = []
                for number, x, copies, data in zip(*(c.slice(at, end - at).to_pylist() for c in batch.columns)):
                    text = unpack.decompress(data).decode()
                    own = sketch_of(text, width, scale, least)
                    if before is None:
                        out.append((number, True, None, data, None, *none))
                    else:
                        out.append((number, None, before[0], None, 1, *compared(before[1], before[2], text, own)))
                    if copies > 1:
                        out.append((number, None, x, None, copies - 1, *compared(text, own, text, own)))
                    before = (x, text, own, number, data)
                yield _batch(out, fields)
        if before is not None:
            yield _batch([(before[3], False, before[0], before[4], None, *none)], fields)

    found = saved(sent.mapInArrow(run, _WRITTEN), "beside", "zstd")
    names = [x.split()[0] for x in _RESULT.split(", ")]
    inside = found.where("copies IS NOT NULL").select("id", *names, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")

    # One first and one last text for each range with rows: a range's last row is followed by the next range's first.
    ends = found.where("first IS NOT NULL").select("range", "first", "id", "packed")
    numbers = ends.where("first").select("range")
    following = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.first("range").over(Window.orderBy("range")))
    numbers = numbers.select("range", following.alias("following"))  # no more rows than ranges, numbers alone
    first = ends.where("first").select(F.col("range").alias("following"), F.col("packed").alias("next_packed"))
    pairs = ends.where("NOT first").select("range", "id", "packed").join(numbers, "range").join(first, "following").select("id", "packed", "next_packed")
    last_fields = to_arrow_schema(StructType.fromDDL(f"id long, {_RESULT}"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for x, *both in zip(*(batch.column(c) for c in ("id", "packed", "next_packed"))):
                one, two = (unpack.decompress(data.as_py()).decode() for data in both)
                own, theirs = (sketch_of(t, width, scale, least) for t in (one, two))
                yield _batch([(x.as_py(), *compared(one, own, two, theirs))], last_fields)

    every = inside.unionByName(pairs.mapInArrow(met, f"id long, {_RESULT}"))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
