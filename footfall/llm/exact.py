"""Exact duplicates: rows grouped by a 128-bit content hash, with the bytes compared inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.tables import saved

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as the empty text. Where all is ASCII the faster lower() does the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def first_half(sha256: Column) -> Column:
    return F.substring(sha256, 1, 32)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=first_half) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row: which rows hold the same text, and which one stays.

    Texts are equal when identical after A-Z are lower-cased; a null text counts as empty. Of equal texts the row with
    the largest id stays, one without id only if no other has one; of rows that repeat this id as well exactly one.

    ``key`` makes the 128-bit group hash of the text's SHA-256. What is counted per group is a hash and an id. Apart from
    that every group's least and greatest text are taken, combined in each task before anything is sent, so a text
    that a third of all rows hold travels once per task: where they differ, different texts share a hash, and those
    groups are counted again by the texts themselves.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).withColumn("key", key(F.col("text_sha256")))
    known = saved(rows.select("id", "text_sha256", "key", F.monotonically_increasing_id().alias("row")), "hashes")
    mixed = rows.groupBy("key").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low != high").select("key")
    mixed = saved(mixed, "collisions")

    groups = known.groupBy("key").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size"))
    groups = saved(groups, "groups")  # read plainly, so that Spark can split a group that holds most rows
    result = known.join(mixed, "key", "left_anti").join(groups, "key")
    if not mixed.isEmpty():
        apart = saved(rows.join(mixed, "key", "left_semi").withColumn("row", F.monotonically_increasing_id()), "collided")
        exact = apart.groupBy("key", "text").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size"))
        result = result.unionByName(apart.join(exact, ["key", "text"]).drop("text"))
    kept = F.col("row") == F.col("keep.row")
    return result.select("id", F.col("keep.id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_duplicates`` keeps, with their own columns."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept")
    kept = kept.select(F.coalesce(F.col("id"), F.lit(0)).alias("k0"), F.col("id").isNull().alias("k1"), F.col("text_sha256").alias("k2"))
    names = [f"c{n}" for n in range(len(docs.columns))]
    place = {x: F.col(y) for x, y in zip(docs.columns, names)}
    sha256 = F.sha2(normalised(place[text_col]).cast("binary"), 256)
    keyed = docs.toDF(*names).withColumns({"k0": F.coalesce(place[id_col], F.lit(0)), "k1": place[id_col].isNull(), "k2": sha256})
    return keyed.join(kept, ["k0", "k1", "k2"], "left_semi").dropDuplicates(["k0", "k1", "k2"]).select(*names).toDF(*docs.columns)
