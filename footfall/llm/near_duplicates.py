"""Near duplicates by circulant MinHash: banded signatures find candidates, full sets confirm the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import circulant
from footfall.llm.components import components
from footfall.llm.tables import by_text, saved

_COLUMNS = 4096


def features(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, seed: int, row_col: str | None = None) -> DataFrame:
    """(id, row, n_shingles, set_key, bands): the set's size, a 128-bit digest that tells equal sets, and its band keys."""

    def reader():
        def of(text: str | None) -> tuple:
            grams = circulant.shingles(text, width)
            keys = circulant.band_keys(circulant.signature(grams, bands * rows, seed), bands, rows) if len(grams) else []
            return len(grams), circulant.set_key(grams), keys

        return of

    row = F.col(row_col) if row_col else F.lit(0)
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).alias("text"))
    return by_text(rows_in, "n_shingles long, set_key binary, bands array<long>", reader)


def _numbered(full: DataFrame) -> DataFrame:
    """(set_key, id, row, node) of each distinct set: its first id and row, and a number of its own in their order.

    Sets of one id differ in their nodes. They are sorted in ranges, and nodes rise from range to range.
    """
    sets = full.groupBy("set_key").agg(F.min(F.struct("id", "row")).alias("first")).select("set_key", "first.*")
    sets = sets.repartitionByRange("id", "row", "set_key").sortWithinPartitions("id", "row", "set_key")
    return saved(sets.withColumn("node", F.monotonically_increasing_id()), "sets")


def _grams(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, grams) of the wanted sets (set_key, id, row, node), read from their texts again; the id is the node."""

    def reader():
        def of(text: str | None) -> tuple:
            found = circulant.shingles(text, width)
            return np.sort(found.view(np.int64)), circulant.set_key(found)

        return of

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = by_text(rows.join(wanted.select("id").distinct(), "id", "left_semi"), "grams array<long>, set_key binary", reader)
    rows = rows.join(wanted, ["id", "set_key"]).dropDuplicates(["id", "set_key"])
    return rows.select(F.col("node").alias("id"), "grams")


def shared(left: np.ndarray, right: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(left) > len(right):
        left, right = right, left
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int((right[at] == left).sum())


def _confirmed(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for n, (x, y) in enumerate(zip(*(batch.column(c) for c in ("grams_a", "grams_b")))):
                x, y = (v.values.to_numpy() for v in (x, y))
                common = shared(x, y)
                kept[n] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    left = grams.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"))
    right = grams.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"))
    size_a, size_b = F.size("grams_a"), F.size("grams_b")
    met = pairs.join(right, "b").join(left, "a").where((100 * F.least(size_a, size_b)) >= percent * F.greatest(size_a, size_b))
    return met.mapInArrow(run, "a long, b long")


def _tile(percent: int):
    """Links between two blocks of sets by products of their 0/1 matrices over the shingles that both blocks hold."""

    def run(few: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        if few.empty or all_.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        left, right = few["few_grams"].tolist(), all_["grams"].tolist()
        n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
        common = np.zeros((len(left), len(right)), np.float32)
        places = [[np.searchsorted(vocabulary, x[np.isin(x, vocabulary)]) for x in side] for side in (left, right)]
        for at in range(0, len(vocabulary), _COLUMNS):
            sides = []
            for side in places:
                ones = np.zeros((len(side), _COLUMNS), np.float32)
                for row, x in enumerate(side):
                    ones[row, x[(x >= at) & (x < at + _COLUMNS)] - at] = 1
                sides.append(ones)
            common += sides[0] @ sides[1].T
        common = common.astype(np.int64)
        i, j = np.nonzero(100 * common >= percent * (n[:, None] + m[None, :] - common))
        a, b = few["few_id"].to_numpy()[i], all_["id"].to_numpy()[j]
        return forest(a[a != b], b[a != b])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links (a, b) reduced to one per node, which keep it connected to what it was connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(nodes):
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, low[i], least)
        np.minimum.at(new, low[j], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    own = low != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[own], "b": nodes[low[own]]}, columns=["a", "b"]).astype("int64")


def _rest(members: DataFrame, links: DataFrame, grams: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between documents that share a bucket and are not connected by ``links``.

    The buckets that still hold several components are joined to clusters. In a cluster every document outside its
    largest component is held against all of the cluster, in blocks. A document with too many shingles that no other
    document of its cluster has cannot link with any of them and needs no comparison, so far outliers of a large
    group of copies cost nothing.
    """
    roots = components(links)
    named = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "center", "id", F.coalesce("root", "id").alias("root"))
    named = saved(named, "members")
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    open_ = saved(named.join(mixed, "key").select("center", "id", "root").distinct(), "open")
    clusters = components(open_.select(F.col("center").alias("a"), F.col("id").alias("b")))
    clusters = clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    docs = open_.select("id", "root").distinct().join(clusters, "id", "left")
    docs = saved(docs.select("id", "root", F.coalesce("cluster", "id").alias("cluster")), "clusters")
    sizes = docs.groupBy("cluster", "root").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    docs = docs.join(sizes, "cluster")
    with_sets = saved(docs.join(grams, "id").select("cluster", "id", "root", "main", "grams"), "sets")
    # A block has ``block`` sets, or as few as hold ``block`` times 512 shingles together (or one larger set).
    parts = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum(F.size("grams")) / F.lit(512 * block))).cast("int")
    single = with_sets.select("cluster", "id", F.explode("grams").alias("gram"))
    single = single.groupBy("cluster", "gram").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    alone = single.groupBy("id").agg(F.count("*").alias("alone"))
    few = with_sets.where("root != main").join(alone, "id", "left")
    few = few.where(100 * (F.size("grams") - F.coalesce("alone", F.lit(0))) >= percent * F.size("grams"))
    few = few.select("cluster", "id", "grams")
    counts = few.groupBy("cluster").agg(parts.alias("rows")).join(with_sets.groupBy("cluster").agg(parts.alias("cols")), "cluster")
    counts = saved(counts, "blocks")
    few = few.join(counts, "cluster").withColumn("row", F.pmod(F.xxhash64("id"), "rows").cast("int"))
    few = few.select("cluster", "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), "id", "grams")
    all_ = with_sets.select("cluster", "id", "grams").join(counts, "cluster").withColumn("col", F.pmod(F.xxhash64("id"), "cols").cast("int"))
    all_ = all_.select("cluster", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "col", "id", "grams")
    few = few.select(*(F.col(x).alias(f"few_{x}") for x in few.columns))
    tiles = few.groupBy("few_cluster", "few_row", "few_col").cogroup(all_.groupBy("cluster", "row", "col"))
    return tiles.applyInPandas(_tile(percent), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 48,
    rows: int = 8,
    seed: int = 20240229,
    block: int = 512,
    row_col: str | None = None,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: which documents are near copies of each other.

    Words are runs of bytes other than space and 0x09-0x0D, after A-Z are lower-cased. Two documents link when the
    Jaccard similarity of their sets of ``width``-word shingles is at least ``percent`` in a hundred, decided on the
    full sets. A link is missed if no band meets: at the lowest similarity with 48 bands of 8 rows, 85 in a hundred,
    once in four million pairs. Documents with equal sets count as one from the start, so copies are never paired.
    ``component_id`` is the smallest id connected by links; the row that has it is kept.

    A null or empty text, or one without words, has an empty set and links with nothing. Of a text with fewer than
    ``width`` words the whole sequence is the only shingle. A row without id is compared with nothing, has no
    component and is kept. Rows that repeat an id are each marked by their own text; those that have their component's
    id are all kept. With ``row_col``, which tells the rows of an id apart, the first of them by it alone is kept, and the
    column ``row`` is added.
    """
    found = saved(features(docs, id_col, text_col, width, bands, rows, seed, row_col), "features")
    full = found.where("id IS NOT NULL AND n_shingles > 0")
    sets = _numbered(full)
    banded = full.groupBy("set_key").agg(F.any_value("bands").alias("bands")).join(sets, "set_key")
    posted = saved(banded.select(F.col("node").alias("id"), F.explode("bands").alias("key")), "bands")  # from here to the roots an id is a node
    buckets = posted.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1").select("key", "center")
    buckets = saved(buckets, "centers")  # read plainly, so that Spark can split a bucket that holds most rows
    members = saved(posted.join(buckets, "key").select("key", "center", "id"), "buckets")
    wanted = saved(sets.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select(sets.columns), "wanted")
    grams = saved(_grams(docs, wanted, id_col, text_col, width), "grams")
    stars = members.where("center != id").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    links = saved(_confirmed(stars, grams, percent), "confirmed")
    rest = saved(_rest(members, links, grams, percent, block), "rest")
    roots = components(links.union(rest))
    named = sets.join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    named = saved(named, "named")
    first = sets.select(F.col("node").alias("root"), F.col("id").alias("least"), F.col("row").alias("first"))
    named = saved(named.join(first, "root").select("set_key", "least", "first"), "least")
    result = found.select("id", "row", "n_shingles", "set_key").join(named, "set_key", "left")
    linked = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    component = F.when(linked, F.col("least")).when(F.col("n_shingles") == 0, F.col("id"))
    kept = F.when(linked, (F.col("id") == F.col("least")) & F.col("row").eqNullSafe(F.col("first"))).otherwise(True)
    columns = ["id", "n_shingles", component.alias("component_id"), kept.alias("kept")]
    return result.select(*columns, *(["row"] if row_col else []))
