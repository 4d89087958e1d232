"""The registered queries over the tables of training data, each one operator with its parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.best_fit import token_matrices
from footfall.llm.byte_network import graded
from footfall.llm.byte_network import train as train_network
from footfall.llm.chain import judged
from footfall.llm.chain import train as train_chain
from footfall.llm.ecoc import identify, train
from footfall.llm.exact import exact_duplicates
from footfall.llm.mixing import mix_report, turns
from footfall.llm.near_duplicates import near_duplicates
from footfall.llm.packing import wide
from footfall.llm.repeats import remove_repeats
from footfall.llm.scaled_sketch import beside_next
from footfall.llm.slack_packing import pack
from footfall.llm.tables import documents, held_out
from footfall.llm.tiles import near_vectors
from footfall.llm.token_alignment import token_links
from footfall.llm.vector_codes import sql as vector_codes_sql
from footfall.llm.vector_codes import vector_codes

ALL = {}
SQL = {}


def query(f):
    ALL[f.__name__] = f
    return f


@query
def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), width=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")


@query
def op9_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = remove_repeats(documents(spark, sf_dir), length=13)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query
def op10_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)
    return found.withColumnRenamed("id", "vec_id")


@query
def op2_minimum_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pack(documents(spark, sf_dir), capacity=1024)
    ids_crc32 = F.crc32(wide("ids", "size"))
    return parts.select(F.col("id").alias("doc_id"), "start", "length", ids_crc32.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op8_best_fit_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrices(documents(spark, sf_dir), capacity=1024).drop("size")


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = mix_report(docs, turns(docs))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op5_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


SQL["op4_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, sum(3 * source_size) OVER w AS stopped, sum(weight) OVER w AS stopped_weight,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM sources
  WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), prices AS (
  SELECT *, (total - coalesce(stopped, 0))::DOUBLE / (weights - coalesce(stopped_weight, 0))::DOUBLE AS price FROM ordered
), price AS (
  SELECT arg_min(price, place) AS price FROM prices WHERE weight * price <= 3 * source_size
), targets AS (
  SELECT source, source_size, least(weight * price, (3 * source_size)::DOUBLE) AS target FROM sources, price
), rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('20240229:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

SQL["op5_exact_duplicates"] = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), groups AS (
  SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM texts JOIN groups USING (text)
"""


@query
def op1_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    apart = held_out(F.col("doc_id"))
    found = identify(docs.select("doc_id", "text"), train(docs.where(~apart)))
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op3_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    apart = held_out(F.col("doc_id"))
    found = graded(docs.select("doc_id", "text"), train_network(docs.where(~apart), labels.where(~apart)))
    return found.select("doc_id", apart.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    apart = held_out(F.col("doc_id"))
    labels = labels.where(~apart).select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    found = judged(docs.select("doc_id", "text"), train_chain(docs.where(~apart), labels, ["low_quality", "toxic"]))
    return found.select("doc_id", apart.alias("held_out"), "p_low_quality", F.col("p_toxic").alias("score"), F.col("toxic").cast("int").alias("predicted"))


@query
def op11_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


SQL["op11_trie_codes"] = vector_codes_sql()


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, found = token_links(documents(spark, sf_dir))
    return found.withColumnsRenamed({"id": "doc_id", "digest": "groups_sha256"})


@query
def op13_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_next(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
