"""Near-duplicate vectors: products of int8 tiles with error bounds, and full precision where the bounds leave doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.components import components
from footfall.llm.near_duplicates import forest
from footfall.llm.tables import saved

_STRIP = 512
_SLACK = 1e-5


def _unit(values: np.ndarray | None) -> np.ndarray | None:
    """The vector with length 1, or None if it has no direction."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if y is None else y for y in values], np.float64) if values.dtype == object else values.astype(np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error): rows of int8, and for each row the length of what scale * q leaves out."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1))


def linked(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of unit vectors a[i], b[j] with cosine >= least, strip by strip.

    With x = s q + e the product of two vectors differs from that of their int8 forms by at most
    |e_a| (1 + |e_b|) + |e_b|: pairs that the int8 product puts beyond this are settled, the rest is computed anew
    in double precision. Sums of int8 products stay far below 2^24, so float32 holds them exactly up to 1000
    components; ``_SLACK`` covers the rounding of the scaling and of longer sums.
    """
    qa, sa, ea = quantised(a)
    qb, sb, eb = quantised(b)
    right, sb32 = qb.astype(np.float32).T.copy(), sb.astype(np.float32)
    slack = _SLACK * max(1, a.shape[1] / 1000)
    for at in range(0, len(a), _STRIP):
        rows = slice(at, at + _STRIP)
        estimate = qa[rows].astype(np.float32) @ right
        estimate *= sb32
        estimate *= sa[rows].astype(np.float32)[:, None]
        widest = (ea[rows] * (1 + eb.max()) + eb.max() + slack).astype(np.float32)
        i, j = np.nonzero(estimate >= np.float32(least) - widest[:, None])
        about, i = estimate[i, j].astype(np.float64), i + at
        bound = ea[i] * (1 + eb[j]) + eb[j] + slack
        sure = about - bound >= least
        doubt = np.flatnonzero(~sure & (about + bound >= least))
        for part in np.array_split(doubt, len(doubt) // 65536 + 1):
            sure[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= least
        yield i[sure], j[sure]


def _packed(vectors: DataFrame) -> DataFrame:
    """One row per block: ids, sizes of the classes, and the vectors one after the other."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        data = np.concatenate(block["embedding"].tolist()).astype(np.float64)
        first = block.iloc[0]
        return pd.DataFrame({"dim": [first["dim"]], "blocks": [first["blocks"]], "block": [first["block"]], "ids": [block["id"].to_numpy().tobytes()], "sizes": [block["size"].to_numpy().tobytes()], "data": [data.tobytes()]})

    kind = "dim int, blocks int, block int, ids binary, sizes binary, data binary"
    return vectors.groupBy("dim", "block").applyInPandas(run, kind)


def _tile(least: float):
    def read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(row.data).reshape(-1, row.dim)
        raw = raw / np.abs(raw).max(axis=1)[:, None]
        unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
        return np.frombuffer(row.ids, np.int64), np.frombuffer(row.sizes, np.int64), unit

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        sides = [read(x) for x in pair.sort_values("block").itertuples()]
        same = len(sides) == 1
        (ids_a, size_a, a), (ids_b, size_b, b) = sides[0], sides[-1]
        links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        low = []
        for i, j in linked(a, b, least):
            if same:
                i, j = i[i != j], j[i != j]
            np.add.at(links_a, i, size_b[j])
            if not same:
                np.add.at(links_b, j, size_a[i])
            low.append(forest(ids_a[i], ids_b[j]))
        low = pd.concat(low)
        low = forest(low["a"].to_numpy(), low["b"].to_numpy())
        sums = pd.DataFrame({"a": np.concatenate([ids_a, ids_b]), "links": np.concatenate([links_a, links_b])})
        return pd.concat([low, sums[sums["links"] > 0]])[["a", "b", "links"]].astype("Int64")

    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, block: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept) for each vector: how many others have a cosine >= ``least``, and its group.

    All vectors of one length are compared with all others, in tiles of ``block`` by ``block`` vectors; vectors of
    different length never link. Work grows with the square of the number of different vectors, by the nature of an
    exact comparison, and is spread over one task group per pair of blocks. Equal vectors are one from the start and
    only counted. A tile returns one count per vector and one link per vector that keeps its groups connected, never
    its pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do rows without
    id. Their component is their own id. Rows that repeat an id with the same vector count as further copies.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.where("usable").groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    classes = saved(classes.withColumn("dim", F.size("embedding")), "classes")
    counts = classes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    placed = classes.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    packed = saved(_packed(placed), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = packed.withColumn("other", other).select("dim", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "block", "ids", "sizes", "data")
    met = saved(tiles.groupBy("dim", "row", "col").applyInPandas(_tile(least), "a long, b long, links long"), "tiles")
    roots = components(met.where("b IS NOT NULL").select("a", "b"))
    links = met.where("links IS NOT NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    named = classes.select("embedding", F.col("id").alias("class"), "size").join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("embedding", F.coalesce("root", "class").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    named = saved(named, "named")
    result = rows.join(named.withColumn("usable", F.lit(True)), ["embedding", "usable"], "left")
    return result.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
