"""A corpus from raw documents to packed sequences, one operator per stage.

Each stage reads all that its predecessor wrote. Only the first and the last change what a document is read as: the
language stage drops documents without a clear language, and packing returns pieces instead of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.ecoc import identify, train
from footfall.llm.exact import without_duplicates
from footfall.llm.mixing import mix, turns
from footfall.llm.near_duplicates import near_duplicates
from footfall.llm.packing import wide
from footfall.llm.slack_packing import pack
from footfall.llm.tables import documents, held_out, saved

#: SQL cannot learn a language model or pack; tests/llm compares run() with a plain version instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; without a letter, or between languages, they go.

    If no row trained on names a language, none can be told, and all documents with a letter stay.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.where("text RLIKE '\\\\p{L}'")
    return identify(docs, model).where("lang_pred != 'und' AND NOT ambiguous").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, by five-word shingles and a similarity of 0.8.

    Rows are told apart by id and text; those that agree in both have lost their copies in the stage before.
    """
    names = [f"c{n}" for n in range(len(docs.columns))]
    place = dict(zip(docs.columns, names))
    keyed = docs.toDF(*names).withColumn("row", F.unhex(F.sha2(F.coalesce(F.col(place["text"]), F.lit("")).cast("binary"), 256)))
    gone = near_duplicates(keyed, place["doc_id"], place["text"], width=5, percent=80, bands=64, row_col="row").where("NOT kept")
    gone = gone.select(F.col("id").alias(place["doc_id"]), "row").distinct()
    return keyed.join(gone, [place["doc_id"], "row"], "left_anti").select(*names).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mix(docs, turns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    parts = pack(docs, capacity=1024)
    return parts.select(F.col("id").alias("doc_id"), "start", "length", F.crc32(wide("ids", "size")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
