"""Passages that repeat across documents: winnowed anchors are the seeds, matches are extended both ways from them."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import words
from footfall.llm.tables import bucketed, buckets_for, by_row, by_text, saved

_SEED = 4
_PLACES = 1 << 24


def _joined(text: str | None) -> bytes:
    """The words with one space between them. bytes.split() parts at 0x20 and 0x09-0x0D, no other byte."""
    return b" ".join(text.encode().split()) if text else b""


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def winnowed(seeds: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words the place of its least seed, by its upper 40 bits, the first of equals.

    It depends on the window's words alone, so equal windows of any documents agree on it. Seeds carry their places in the
    lower bits, so least ones of two windows that overlap are the least of both, and a few doublings reach the length.
    """
    reach = length - _SEED + 1
    if reach < 1:
        raise ValueError(f"windows have at least {_SEED} words")
    if len(seeds) < reach:
        return np.zeros(0, np.int64)
    if len(seeds) > _PLACES:
        half = len(seeds) // 2
        return np.concatenate([winnowed(seeds[: half + reach - 1], length), half + winnowed(seeds[half:], length)])
    least = (seeds & ~np.uint64(_PLACES - 1)) | np.arange(len(seeds), dtype=np.uint64)
    width = 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least & np.uint64(_PLACES - 1)).astype(np.int64)


def _key(sequence: bytes) -> int:
    """What tells rows of one id apart: eight bytes of the digest."""
    return int.from_bytes(sequence[:8], "little", signed=True)


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """(id, n_words, sequence, key, sha256, anchors) of each text; without id it has no anchors."""

    def reader():
        def of(text: str | None) -> tuple:
            data = _joined(text)
            found = words.hashes(data)
            seeds = words.runs(found, _SEED)
            anchors = np.unique(seeds[np.unique(winnowed(seeds, length))])
            sequence = _digest(data)
            return len(found), len(data), sequence, _key(sequence), hashlib.sha256(data).hexdigest(), anchors.view(np.int64)

        return of

    return by_text(docs, "n_words long, size long, sequence binary, key long, sha256 string, anchors array<long>", reader)


def _small(docs: DataFrame) -> DataFrame:
    """(id, key, packed): the words of each text, compressed for the way."""

    def reader():
        pack = zstandard.ZstdCompressor(level=3)

        def of(text: str | None) -> tuple:
            data = _joined(text)
            return _key(_digest(data)), pack.compress(data)

        return of

    return by_text(docs.where("id IS NOT NULL"), "key long, packed binary", reader)


def _unpacker():
    return zstandard.ZstdDecompressor().decompress


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """Of each text the places of shared anchors, each with a 128-bit digest of all words its windows can reach."""
    before, after = length - _SEED, length

    def reader():
        unpack = _unpacker()

        def of(id_: int, key: int, packed: bytes, shared: np.ndarray) -> tuple | None:
            found = words.hashes(unpack(packed))
            seeds = words.runs(found, _SEED)
            places = np.unique(winnowed(seeds, length))
            places = places[np.isin(seeds[places], shared.view(np.uint64))]
            if not len(places):
                return None
            edge = np.zeros(before + after, np.uint64)
            padded = np.concatenate([edge[:before], found, edge[:after]])
            one, two = (words.runs_at(padded, places, before + after, salt).view(np.int64) for salt in (0, 1))
            return id_, key, packed, places, seeds[places].view(np.int64), one, two

        return of

    kind = "id long, key long, packed binary, place array<int>, anchor array<long>, one array<long>, two array<long>"
    return by_row(docs.select("id", "key", "packed", "shared"), kind, reader, "packed")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """(id, key, start, one, two): the windows whose seed is at one of the places ``open``."""

    def reader():
        unpack = _unpacker()

        def of(id_: int, key: int, packed: bytes, open_: np.ndarray) -> tuple:
            found = words.hashes(unpack(packed))
            starts = np.flatnonzero(np.isin(winnowed(words.runs(found, _SEED), length), open_))
            one, two = (words.runs_at(found, starts, length, salt).view(np.int64) for salt in (0, 1))
            return id_, key, starts, one, two

        return of

    found = by_row(docs.select("id", "key", "packed", "open"), "id long, key long, start array<int>, one array<long>, two array<long>", reader, "packed")
    return found.select("id", "key", F.explode(F.arrays_zip("start", "one", "two")).alias("x")).select("id", "key", "x.*")


def _removed(docs: DataFrame, length: int) -> DataFrame:
    """The repeats of each text, joined to spans of as many words as possible, and what is left."""

    def reader():
        unpack = _unpacker()

        def of(id_: int, key: int, packed: bytes, covered: np.ndarray | None, starts: np.ndarray | None) -> tuple | None:
            data = unpack(packed)
            found = data.split(b" ")
            hit = np.zeros(0, np.int64) if starts is None else starts.astype(np.int64)
            if covered is not None and len(covered):
                seeds = words.runs(words.hashes(data), _SEED)
                hit = np.concatenate([hit, np.flatnonzero(np.isin(winnowed(seeds, length), covered))])
            if not len(hit):
                return None
            edges = np.zeros(len(found) + 1, np.int64)
            np.add.at(edges, hit, 1)
            np.add.at(edges, hit + length, -1)
            gone = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
            begin, end = np.flatnonzero(~gone[:-1] & gone[1:]), np.flatnonzero(gone[:-1] & ~gone[1:])
            left = b" ".join(compress(found, ~gone[1:-1]))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(begin, end)]
            return id_, key, int(gone.sum()), hashlib.sha256(left).hexdigest(), spans, left.decode()

        return of

    kind = "id long, key long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string"
    return by_row(docs.select("id", "key", "packed", "covered", "starts"), kind, reader, "packed")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> tuple[DataFrame, DataFrame]:
    """Which words of each document belong to a passage that a document with a smaller id has too.

    A window is ``length`` consecutive words of one document (runs of bytes other than space and 0x09-0x0D, unchanged).
    A window is a repeat if its words also start somewhere in a document with a smaller id; runs of repeats are the
    maximal spans. Returns two tables: (id, n_words, n_removed, kept_sha256) for every row, and (id, spans,
    kept) for the rows that lose words but are no copies: the spans as word numbers, end excluded, and the words left. A
    copy of all words of a smaller id loses them all. The SHA-256 is that of the kept words joined by spaces.

    Seeds: of each window one run of four words, the least by hash, is the anchor; equal windows have equal anchors,
    and an anchor is of interest if two ids have it. Extension: around each such place the words that any window of
    this anchor can reach, to both sides, are digested (128 bits). Where a smaller id has the same surroundings, all
    these windows are repeats. Only where an anchor has several surroundings, at the ends of matches, single windows
    are compared. Nothing is paired: each step takes the smallest id of a digest, so a passage in a third of all
    documents costs one row for each. Of documents with the same words only the first takes part.

    A null or empty text has no words and keeps none. A text shorter than ``length`` loses nothing. Rows that share an
    id are one document and never remove each other's words; a row without id loses nothing and removes nothing.
    """
    if length < _SEED:
        raise ValueError(f"windows have at least {_SEED} words")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # One row per anchor, and one for a text without any; what repeats from row to row takes next to no room in Parquet.
    scan = _scan(docs, length).select("id", "key", "sequence", "n_words", "size", "sha256", F.posexplode_outer("anchors").alias("n", "anchor"))
    scan = saved(scan.withColumn("lead", F.coalesce("n", F.lit(0)) == 0).drop("n"), "scanned")
    scanned = scan.where("lead").drop("lead", "anchor")
    known = scanned.where("id IS NOT NULL")
    firsts = known.where(F.col("n_words") >= length).groupBy("sequence").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last")
    firsts = saved(firsts.drop("last"), "firsts")
    copies = saved(known.select("id", "key", "sequence").join(firsts, "sequence").where("id > first").select("id", "key").distinct(), "copies")

    anchors = scan.where("id IS NOT NULL AND anchor IS NOT NULL").select("id", "key", "anchor")
    common = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    common = saved(common, "common")  # read plainly, so that Spark can split an anchor that most documents have
    # Rows of one id are told apart by their texts from here on, so an id of very many rows is no key of its own.
    shared = anchors.join(common.select("anchor"), "anchor").groupBy("id", "key").agg(F.collect_set("anchor").alias("shared"))
    shared = shared.join(copies, ["id", "key"], "left_anti")
    buckets = buckets_for(spark, scanned.agg(F.sum("size")).first()[0] or 0)
    seeded = _contexts(_small(docs).join(shared, ["id", "key"]), length)
    with bucketed(seeded, "seeded", ["id", "key"], buckets) as seeded:
        changed = _changed(seeded, length)

    gone = copies.withColumn("copy", F.lit(True))
    result = scanned.select("id", "key", "n_words", "sha256").join(gone, ["id", "key"], "left")
    result = result.join(changed.select("id", "key", "n_removed", "kept_sha256"), ["id", "key"], "left")
    n_removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256"))
    result = result.select("id", "n_words", n_removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))
    return result, changed.select("id", "spans", "kept")


def _changed(seeded: DataFrame, length: int) -> DataFrame:
    """(id, key, n_removed, kept_sha256, spans, kept) of the rows that lose words, from the places of shared anchors."""
    places = seeded.select("id", "key", F.explode(F.arrays_zip("place", "anchor", "one", "two")).alias("x")).select("id", "key", "x.*")
    around = saved(places.groupBy("anchor", "one", "two").agg(F.min("id").alias("first"), F.max("id").alias("last")), "around")
    several = around.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("first").alias("low"), F.max("last").alias("high"))
    several = several.where("low != high").select("anchor", (F.col("contexts") > 1).alias("several"))
    known_around = saved(around.join(several, "anchor").drop("last"), "several")
    met = places.join(known_around, ["anchor", "one", "two"]).where("id > first OR several")
    of_doc = met.groupBy("id", "key").agg(
        F.collect_set(F.expr("CASE WHEN id > first THEN place END")).alias("covered"),
        F.collect_set(F.expr("CASE WHEN id = first THEN place END")).alias("open"),
    )
    of_doc = saved(of_doc, "marks")
    texts = seeded.select("id", "key", "packed")

    opened = of_doc.where("size(open) > 0").select("id", "key", "open")
    single = saved(_windows(texts.join(opened, ["id", "key"]), length), "windows")
    earliest = single.groupBy("one", "two").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last")
    earliest = saved(earliest.drop("last"), "earliest")
    late = single.join(earliest, ["one", "two"]).where("id > first")
    late = late.groupBy("id", "key").agg(F.collect_set("start").alias("starts"))
    marked = of_doc.select("id", "key", "covered").join(late, ["id", "key"], "left").where("size(covered) > 0 OR starts IS NOT NULL")
    return saved(_removed(texts.join(marked, ["id", "key"]), length).dropDuplicates(["id", "key"]), "changed")
