"""Limits, codes, messages and formats that callers of the service depend on."""

# Accepted words.
CHANNELS = ["web", "mobile_app", "api"]
GROUPINGS = ["channel", "hour", "day"]

# Limits. Text lengths are counted in bytes.
MAX_NAME_BYTES = 100
MAX_TAGS = 20
MAX_TAG_BYTES = 100
MAX_AGE_SECONDS = 30 * 24 * 60 * 60
MAX_BULK_EVENTS = 1000
MAX_ROWS_PER_FILE = 500_000
TOPIC_PARTITIONS = 20
MAX_RETRIES = 5
DEFAULT_RETRY_COUNT = 1
FIRST_DELAY_SECONDS = 2
LONGEST_DELAY_SECONDS = 60

# Error codes.
REQUIRED = "validation.required.error"
TOO_LONG = "validation.max-length.error"
IN_FUTURE = "validation.timestamp-future.error"
EXPIRED = "validation.timestamp-expired.error"
BAD_CHANNEL = "validation.invalid-channel.error"
TOO_MANY_TAGS = "validation.max-tags.error"
TAG_TOO_LONG = "validation.tag-too-long.error"
BAD_GROUPING = "validation.invalid-group-by.error"
BAD_RANGE = "validation.invalid-range.error"

# Messages.
SAY_NAME_REQUIRED = "event_name is required"
SAY_NAME_TOO_LONG = "event_name must be at most 100 characters"
SAY_USER_REQUIRED = "user_id is required"
SAY_USER_TOO_LONG = "user_id must be at most 100 characters"
SAY_TIME_REQUIRED = "timestamp is required"
SAY_TIME_FUTURE = "timestamp cannot be in the future"
SAY_TIME_EXPIRED = "timestamp cannot be older than 30 days"
SAY_CHANNEL = "channel must be one of: web, mobile_app, api"
SAY_TAGS = "tags must have at most 20 items"
SAY_TAG = "tag must be at most 100 characters"
SAY_FROM_REQUIRED = "from timestamp is required"
SAY_TO_REQUIRED = "to timestamp is required"
SAY_RANGE = "to timestamp must be greater than from timestamp"
SAY_QUERY_CHANNEL = "invalid channel value, must be one of: web, mobile_app, api"
SAY_GROUPING = "invalid group_by value, must be one of: channel, hour, day"
SAY_BULK_EMPTY = "events array cannot be empty"
SAY_BULK_TOO_LONG = "events array cannot exceed 1000 items"
SAY_BAD_BODY = "invalid request body"
SAY_NOT_PUBLISHED = "failed to publish event"
SAY_NO_DETAIL = "validation error"

# Failure kinds and message header names.
UNMARSHAL_ERROR = "unmarshal_error"
INSERT_FAILED = "insert_failed"
RETRIES_EXHAUSTED = "max_retries_exhausted"
H_RETRY_COUNT = "retry_count"
H_FINAL_COUNT = "final_retry_count"
H_ERROR_TYPE = "error_type"
H_ERROR_MESSAGE = "error_message"
H_TOPIC = "original_topic"
H_PARTITION = "original_partition"
H_OFFSET = "original_offset"
H_FAILED_AT = "failed_at"
H_LAST_RETRY_AT = "last_retry_at"
H_DEAD_AT = "sent_to_dlq_at"

# Text formats.
KEY_FORMAT = "yyyy-MM-dd HH:mm:ss"
RFC3339_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Fixed value: distinct counts are exact up to 2^16 values and estimated beyond.
SKETCH_LOG_ENTRIES = 16
