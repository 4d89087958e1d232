"""Generated load: commands whose every field follows from a running number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.clock import Moment, as_seconds
from footfall.functions.fixed import CHANNELS
from footfall.sources.raw_events import pick

# What the generated events look like.
NAMES = ["product_view", "add_to_cart", "purchase", "page_view", "signup"]
EVENTS_PER_BATCH = 200
CAMPAIGNS = 100
USERS = 10_000
PRODUCTS = 1000
SECONDS_BACK = 3600
LOWEST_PRICE = "99.99"
CURRENCY = "TRY"


def generate(numbers: DataFrame, now: Moment, per_batch: int = EVENTS_PER_BATCH) -> DataFrame:
    """One command for each row of ``numbers`` (a column ``n`` counting from 0).

    Numbers are taken ``per_batch`` at a time; a batch belongs to one sender.
    """
    n, i = F.col("n"), F.col("n") % per_batch
    sender = F.floor(n / per_batch)
    price = F.lit(LOWEST_PRICE).cast("decimal(18,2)") + (i % 100).cast("decimal(18,2)")
    metadata = F.to_json(
        F.struct(
            F.lit(CURRENCY).alias("currency"),
            price.cast("double").alias("price"),
            F.concat(F.lit("prod_"), (i % PRODUCTS).cast("string")).alias("product_id"),
            sender.alias("worker_id"),
        )
    )
    return numbers.select(
        pick(i, NAMES).alias("event_name"),
        pick(i, CHANNELS).alias("channel"),
        F.concat(F.lit("cmp_"), (n % CAMPAIGNS).cast("string")).alias("campaign_id"),
        F.concat(F.lit("user_"), (n % USERS).cast("string")).alias("user_id"),
        (as_seconds(now) - i % SECONDS_BACK).alias("timestamp"),
        F.array(F.lit("test"), F.lit("loadtest"), F.concat(F.lit("worker_"), sender.cast("string"))).alias("tags"),
        metadata.alias("metadata"),
    )


def synthetic_commands(spark: SparkSession, count: int, now: Moment) -> DataFrame:
    return generate(spark.range(count).toDF("n"), now)
