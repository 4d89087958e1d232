"""The given ``events`` table read as activity commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.fixed import CHANNELS

RAW_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def stream_raw(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern, because the stream reader takes a folder or a pattern but not the name of a single file.
    return reader.parquet(f"{folder}/event[s].parquet")


def pick(key: Column, values: list[str]) -> Column:
    """One of a few fixed values, chosen by ``key`` modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def price_json(key: Column, value: Column) -> Column:
    """Every tenth row has no price and every tenth a price given as text, so both branches are met."""
    amount = F.round(value, 2).cast("decimal(18,2)").cast("string")
    return (
        F.when(key % 10 == 0, F.lit("{}"))
        .when(key % 10 == 5, F.concat(F.lit('{"price":"'), amount, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"price":'), amount, F.lit("}")))
    )


def as_commands(raw: DataFrame) -> DataFrame:
    """Raw rows in the shape of ingest commands; ``src`` is the raw row's own number."""
    src = F.col("event_id")
    return raw.select(
        src.alias("src"),
        F.col("event_type").alias("event_name"),
        pick(src, CHANNELS).alias("channel"),
        F.concat(F.lit("cmp_"), F.get_json_object("props", "$.k")).alias("campaign_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.array(F.concat(F.lit("t"), (src % 4).cast("string"))).alias("tags"),
        price_json(src, F.col("value")).alias("metadata"),
    )


def raw_between(raw: DataFrame, first: int, after: int) -> DataFrame:
    """Raw rows of the seconds [first, after), as a range on the stored column that reaches the Parquet scan."""
    bounds = [F.timestamp_seconds(F.lit(s)).cast("timestamp_ntz") for s in (first, after)]
    return raw.where((F.col("ts") >= bounds[0]) & (F.col("ts") < bounds[1]))


def raw_last_day(raw: DataFrame) -> DataFrame:
    """Raw rows of the 24 hours up to the newest second."""
    newest = raw.agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz")).scalar()
    return raw.where(F.col("ts") >= newest - F.expr("INTERVAL 24 HOURS"))


def newest_second(raw: DataFrame) -> Column:
    """The time of the newest row in epoch seconds, as a scalar subquery: "now" for queries over a fixed table."""
    return raw.agg(F.unix_seconds(F.max("ts").cast("timestamp"))).scalar()
