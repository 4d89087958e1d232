"""Row shapes shared by sources, tables and streams."""

from pyspark.sql import types as T

COMMAND_COLUMNS = ["event_name", "channel", "campaign_id", "user_id", "timestamp", "tags", "metadata"]

HEADERS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
)

MESSAGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", HEADERS),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("batch_id", T.StringType()),
    ]
)

HOURLY = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("hour", T.TimestampType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("unique_users_state", T.BinaryType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("batch_id", T.StringType()),
    ]
)

RETRY = T.StructType(
    MESSAGE.fields
    + [
        T.StructField("retry_count", T.LongType()),
        T.StructField("queued_at", T.TimestampType()),
        T.StructField("next_attempt_at", T.TimestampType()),
        T.StructField("due", T.LongType()),
        T.StructField("batch_id", T.StringType()),
    ]
)

DEAD_LETTER = T.StructType(MESSAGE.fields + [T.StructField("batch_id", T.StringType())])
