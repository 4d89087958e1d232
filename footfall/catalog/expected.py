"""ANSI SQL (DuckDB dialect) giving the expected result of each registered query, over the same tables."""

from __future__ import annotations

from footfall.catalog.inputs import ASK_FROM, ASK_NAME, ASK_TO

AT = 1704067200

# The given events as commands and events.
EV = """
ev AS (
  SELECT
    event_id AS src,
    event_type AS event_name,
    CASE event_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile_app' ELSE 'api' END AS channel,
    'cmp_' || json_extract_string(props, '$.k') AS campaign_id,
    'user_' || CAST(user_id AS VARCHAR) AS user_id,
    CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
    't' || CAST(event_id % 4 AS VARCHAR) AS tags,
    CAST(value AS DECIMAL(18,2)) AS amount,
    CASE WHEN event_id % 10 IN (0, 5) THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END AS price
  FROM events
),
now AS (SELECT max(timestamp) AS now FROM ev)
"""

# The amount as JSON writes it: without trailing zeros.
AMOUNT = "regexp_replace(regexp_replace(CAST(amount AS VARCHAR), '0+$', ''), '\\.$', '')"
METADATA = f"""CASE event_id_rest WHEN 0 THEN '{{}}' WHEN 5 THEN '{{"price":"' || CAST(amount AS VARCHAR) || '"}}'
  ELSE '{{"price":' || {AMOUNT} || '}}' END"""

EV_FULL = f"""{EV},
full_ev AS (
  SELECT *,
    sha256(event_name || '|' || user_id || '|' || CAST(timestamp AS VARCHAR) || '|' || channel) AS event_id,
    {METADATA} AS metadata,
    make_timestamp(timestamp * 1000000) AS ts
  FROM (SELECT *, src % 10 AS event_id_rest FROM ev)
)"""


def clock(seconds: str) -> str:
    return f"strftime(make_timestamp({seconds} * 1000000), '%Y-%m-%d %H:%M:%S')"


HOUR = "(timestamp // 3600 * 3600)"
DAY = "(timestamp // 86400 * 86400)"


def rollup(source: str, before: str = EV) -> str:
    return f"""WITH {before}
    SELECT event_name, channel, {clock(HOUR)} AS hour, count(*) AS event_count,
           count(DISTINCT user_id) AS unique_users
    FROM {source} GROUP BY event_name, channel, {HOUR}"""


SENT_AGAIN = f"""{EV_FULL},
again AS (
  SELECT event_id, event_name, channel, user_id, timestamp, metadata, timestamp AS created FROM full_ev
  UNION ALL
  SELECT event_id, event_name, channel, user_id, timestamp, '{{"price":1}}', timestamp + 3600
  FROM full_ev WHERE src % 10 = 0
),
newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY event_id, event_name, timestamp ORDER BY created DESC, metadata DESC) AS rn FROM again)
  WHERE rn = 1
)"""

VERSIONS = f"event_id, event_name, timestamp, metadata, {clock('created')} AS created_at"

# Validation ------------------------------------------------------------------------------------------------

NAME_SAYS = """CASE WHEN event_name = '' THEN 'event_name=validation.required.error'
  WHEN strlen(event_name) > 100 THEN 'event_name=validation.max-length.error' END"""
USER_SAYS = """CASE WHEN user_id = '' THEN 'user_id=validation.required.error'
  WHEN strlen(user_id) > 100 THEN 'user_id=validation.max-length.error' END"""
TIME_SAYS = """CASE WHEN timestamp = 0 THEN 'timestamp=validation.required.error'
  WHEN timestamp > now THEN 'timestamp=validation.timestamp-future.error'
  WHEN timestamp < now - 2592000 THEN 'timestamp=validation.timestamp-expired.error' END"""
CHANNEL_SAYS = """CASE WHEN channel NOT IN ('', 'web', 'mobile_app', 'api')
  THEN 'channel=validation.invalid-channel.error' END"""


def message_of(code: str) -> str:
    """The message that belongs to a ``field=code`` text."""
    return f"""CASE {code}
      WHEN 'event_name=validation.required.error' THEN 'event_name: event_name is required'
      WHEN 'event_name=validation.max-length.error' THEN 'event_name: event_name must be at most 100 characters'
      WHEN 'user_id=validation.required.error' THEN 'user_id: user_id is required'
      WHEN 'user_id=validation.max-length.error' THEN 'user_id: user_id must be at most 100 characters'
      WHEN 'timestamp=validation.required.error' THEN 'timestamp: timestamp is required'
      WHEN 'timestamp=validation.timestamp-future.error' THEN 'timestamp: timestamp cannot be in the future'
      WHEN 'timestamp=validation.timestamp-expired.error' THEN 'timestamp: timestamp cannot be older than 30 days'
      WHEN 'channel=validation.invalid-channel.error' THEN 'channel: channel must be one of: web, mobile_app, api'
      WHEN 'tags=validation.max-tags.error' THEN 'tags: tags must have at most 20 items'
      WHEN 'tags[1]=validation.tag-too-long.error' THEN 'tags[1]: tag must be at most 100 characters'
    END"""


FAULTY = f"""{EV},
faulty AS (
  SELECT src, now,
    CASE WHEN src % 7 = 0 THEN '' WHEN src % 11 = 0 THEN repeat('n', 101)
         WHEN src % 19 = 0 THEN repeat('€', 34) ELSE event_name END AS event_name,
    CASE WHEN src % 13 = 0 THEN repeat('u', 101) WHEN src % 17 = 0 THEN '' ELSE user_id END AS user_id,
    CASE WHEN src % 23 = 0 THEN 0 WHEN src % 29 = 0 THEN now + 3600 WHEN src % 31 = 0 THEN now - 2678400
         WHEN src % 37 = 0 THEN now - 2592000 ELSE timestamp END AS timestamp,
    CASE WHEN src % 41 = 0 THEN 'tv' WHEN src % 43 = 0 THEN '' ELSE channel END AS channel,
    CASE WHEN src % 47 = 0 THEN 'tags=validation.max-tags.error' WHEN src % 53 = 0 THEN NULL
         WHEN src % 59 = 0 THEN 'tags[1]=validation.tag-too-long.error' END AS tags_say
  FROM ev, now
),
judged AS (
  SELECT *, {NAME_SAYS} AS e1, {USER_SAYS} AS e2, {TIME_SAYS} AS e3, {CHANNEL_SAYS} AS e4, tags_say AS e5,
    sha256(event_name || '|' || user_id || '|' || CAST(timestamp AS VARCHAR) || '|' || channel) AS event_id
  FROM faulty
),
counted AS (
  SELECT *, CAST((e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT + (e3 IS NOT NULL)::INT + (e4 IS NOT NULL)::INT
    + (e5 IS NOT NULL)::INT AS INT) AS n FROM judged
)"""

# Requests --------------------------------------------------------------------------------------------------

BULK = f"""{EV},
sized AS (
  SELECT *, CASE WHEN src % 997 = 1 THEN 1001 WHEN src % 997 = 2 THEN 1000 ELSE src % 4 END AS size,
    CASE WHEN src % 53 = 0 OR src % 59 = 0 THEN 'invalid request body'
         WHEN src % 61 = 0 THEN 'events array cannot be empty'
         WHEN src % 67 = 0 THEN 'invalid request body' END AS unread
  FROM ev
),
asked AS (
  SELECT *, CASE WHEN unread IS NOT NULL THEN unread WHEN size = 0 THEN 'events array cannot be empty'
    WHEN size > 1000 THEN 'events array cannot exceed 1000 items' END AS request_error
  FROM sized
),
items AS (
  SELECT src, i AS index, now, CASE WHEN (src + i) % 5 = 0 THEN '' ELSE event_name END AS event_name,
    CASE WHEN (src + i) % 11 = 0 THEN 'tv' ELSE channel END AS channel, user_id, timestamp + i AS timestamp
  FROM (SELECT *, unnest(range(size)) AS i FROM asked WHERE request_error IS NULL), now
),
item_codes AS (
  SELECT *, {NAME_SAYS} AS e1, {TIME_SAYS} AS e3, {CHANNEL_SAYS} AS e4 FROM items
),
item_errors AS (
  SELECT *, nullif(concat_ws('; ', {message_of('e1')}, {message_of('e3')}, {message_of('e4')}), '') AS error
  FROM item_codes
)"""


def bulk_answer(published: str) -> str:
    return f"""WITH {BULK},
    told AS (
      SELECT src, count(*) AS n, count(error) AS bad,
        string_agg(CASE WHEN error IS NOT NULL THEN CAST(index AS VARCHAR) || ': ' || error END, ' | '
          ORDER BY index) AS failed,
        string_agg(CASE WHEN error IS NULL THEN CAST(index AS VARCHAR) || ': failed to publish event' END, ' | '
          ORDER BY index) AS unsent
      FROM item_errors GROUP BY src
    ),
    summed AS (
      SELECT a.src, a.request_error, {published} AS published, t.failed, t.unsent,
        coalesce(CASE WHEN {published} THEN n - bad ELSE 0 END, 0) AS taken,
        coalesce(CASE WHEN {published} THEN bad ELSE n END, 0) AS lost
      FROM asked a LEFT JOIN told t ON a.src = t.src
    )
    SELECT CAST(src AS VARCHAR) AS request_id,
      CAST(CASE WHEN request_error IS NOT NULL THEN 400 WHEN lost > 0 AND taken > 0 THEN 207 WHEN lost > 0 THEN 400
        ELSE 202 END AS INT) AS status,
      CAST(taken AS INT) AS success_count, CAST(lost AS INT) AS failed_count,
      coalesce(request_error, '') AS request_error,
      concat_ws(' | ', failed, CASE WHEN NOT published THEN unsent END) AS errors
    FROM summed"""


SINGLE = f"""{EV},
body AS (
  SELECT src, now, channel, user_id, timestamp, src % 67 = 0 AS is_null,
    src % 53 = 0 OR src % 59 = 0 OR src % 61 = 0 AS unread, event_name
  FROM ev, now
),
filled AS (
  SELECT src, now, unread, CASE WHEN is_null THEN '' ELSE channel END AS channel,
    CASE WHEN is_null THEN '' ELSE user_id END AS user_id, CASE WHEN is_null THEN '' ELSE event_name END AS event_name,
    CASE WHEN is_null THEN 0 ELSE timestamp END AS timestamp
  FROM body
),
coded AS (SELECT *, concat_ws(',', {NAME_SAYS}, {USER_SAYS}, {TIME_SAYS}, {CHANNEL_SAYS}) AS codes FROM filled)"""

# Metrics ---------------------------------------------------------------------------------------------------

RANGE = f"event_name = '{ASK_NAME}' AND {HOUR} BETWEEN {ASK_FROM} AND {ASK_TO}"
COUNTS = "count(*) AS total_count, count(DISTINCT user_id) AS unique_users"


def grouped(key: str) -> str:
    return f"WITH {EV} SELECT {key} AS key, {COUNTS} FROM ev WHERE {RANGE} GROUP BY 1"


REQUESTS = """
requests AS (
  SELECT c_custkey AS request_id,
    CASE WHEN c_custkey % 101 = 0 THEN '' ELSE
      ['click', 'error', 'purchase', 'signup', 'view', 'nothing'][c_custkey % 6 + 1] END AS event_name,
    CASE WHEN c_custkey % 103 = 0 THEN 0 ELSE 1704067200 + c_custkey * 7919 % (20 * 86400) END AS since,
    CASE WHEN c_custkey % 107 = 0 THEN 0 ELSE
      1704067200 + c_custkey * 7919 % (20 * 86400) + c_custkey * 104729 % (9 * 86400) END AS until,
    CASE WHEN c_custkey % 109 = 0 THEN 'tv' ELSE
      ['', 'web', 'mobile_app', 'api'][c_custkey // 6 % 4 + 1] END AS wanted,
    CASE WHEN c_custkey % 113 = 0 THEN 'week' ELSE
      ['', 'channel', 'hour', 'day'][c_custkey // 24 % 4 + 1] END AS group_by
  FROM customer
),
request_codes AS (
  SELECT *,
    CASE WHEN event_name = '' THEN 'event_name=validation.required.error' END AS e1,
    CASE WHEN since = 0 THEN 'from=validation.required.error' END AS e2,
    CASE WHEN until = 0 THEN 'to=validation.required.error' END AS e3,
    CASE WHEN since <> 0 AND until <> 0 AND until <= since THEN 'to=validation.invalid-range.error' END AS e4,
    CASE WHEN wanted = 'tv' THEN 'channel=validation.invalid-channel.error' END AS e5,
    CASE WHEN group_by = 'week' THEN 'group_by=validation.invalid-group-by.error' END AS e6
  FROM requests
)"""

ANSWERS = f"""WITH {EV}, {REQUESTS},
hours AS (
  SELECT event_name, channel, user_id, {HOUR} AS hour, count(*) AS n FROM ev GROUP BY 1, 2, 3, 4
),
good AS (
  SELECT * FROM request_codes WHERE coalesce(e1, e2, e3, e4, e5, e6) IS NULL
),
met AS (
  SELECT g.request_id, g.group_by, h.user_id, h.n,
    CASE g.group_by WHEN 'channel' THEN h.channel WHEN 'hour' THEN {clock('h.hour')}
      WHEN 'day' THEN {clock('(h.hour // 86400 * 86400)')} ELSE '' END AS key
  FROM good g JOIN hours h ON g.event_name = h.event_name AND h.hour BETWEEN g.since AND g.until
    AND (g.wanted = '' OR g.wanted = h.channel)
),
totals AS (
  SELECT request_id, CAST(sum(n) AS BIGINT) AS total_count, count(DISTINCT user_id) AS unique_users
  FROM met GROUP BY 1
)
SELECT g.request_id, 'total' AS scope, '' AS key, coalesce(total_count, 0) AS total_count,
  coalesce(unique_users, 0) AS unique_users
FROM good g LEFT JOIN totals t ON g.request_id = t.request_id
UNION ALL
SELECT request_id, 'group', key, CAST(sum(n) AS BIGINT), count(DISTINCT user_id)
FROM met WHERE group_by <> '' GROUP BY request_id, key"""

# Dashboard -------------------------------------------------------------------------------------------------

DAY_EVENTS = f"{EV}, recent AS (SELECT * FROM ev, now WHERE timestamp >= now - 86400)"
DAY_HOURS = f"{EV}, recent AS (SELECT * FROM ev, now WHERE {HOUR} >= now - 86400)"
MONEY = "coalesce(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE), 0.0)"
SOLD = "event_name = 'purchase'"

# Messages --------------------------------------------------------------------------------------------------

PROBLEM = """CASE
  WHEN src % 53 = 0 THEN 'not JSON'
  WHEN src % 59 = 0 THEN 'field timestamp must be a whole number'
  WHEN src % 61 = 0 THEN 'field event_name must be a string'
  WHEN src % 67 = 0 THEN 'field tags must be a list of strings'
  WHEN src % 71 = 0 THEN 'field metadata must be an object'
  WHEN src % 73 = 0 THEN 'field created_at must be an RFC 3339 time'
  WHEN src % 79 = 0 THEN 'not a JSON object'
  WHEN src % 83 = 0 THEN 'field timestamp must be a whole number'
  ELSE '' END"""
DECODED = f"""{EV_FULL},
sent AS (
  SELECT *, {PROBLEM} AS problem,
    CASE WHEN src % 89 = 0 THEN 'null' WHEN src % 97 = 0 THEN 'web' WHEN src % 101 = 0 THEN 'any' ELSE '' END AS odd
  FROM full_ev
),
decoded AS (
  SELECT src, problem,
    CASE WHEN odd = '' THEN event_id ELSE '' END AS event_id,
    CASE WHEN odd = '' THEN event_name ELSE '' END AS event_name,
    CASE odd WHEN '' THEN channel WHEN 'web' THEN 'web' WHEN 'any' THEN 'api' ELSE '' END AS channel,
    CASE WHEN odd = '' THEN campaign_id ELSE '' END AS campaign_id,
    CASE WHEN odd = '' THEN user_id ELSE '' END AS user_id,
    CASE WHEN odd = '' THEN tags ELSE '' END AS tags,
    CASE odd WHEN '' THEN timestamp WHEN 'any' THEN 8 ELSE 0 END AS timestamp,
    CASE WHEN odd = '' THEN metadata ELSE '{{}}' END AS metadata
  FROM sent
),
landed AS (SELECT * FROM decoded WHERE problem = '')"""

BAD_VALUE = """CASE
  WHEN src % 53 = 0 THEN '{bad'
  WHEN src % 59 = 0 THEN '{"timestamp":"5"}'
  WHEN src % 61 = 0 THEN '{"event_name":5}'
  WHEN src % 67 = 0 THEN '{"tags":["a",1]}'
  WHEN src % 71 = 0 THEN '{"metadata":[1]}'
  WHEN src % 73 = 0 THEN '{"created_at":"yesterday"}'
  WHEN src % 79 = 0 THEN '[1]'
  WHEN src % 83 = 0 THEN '{"timestamp":1.5}' END"""

ORIGIN = """'original_topic=events; original_partition=' || CAST(src % 20 AS VARCHAR)
  || '; original_offset=' || CAST(src AS VARCHAR)"""
STAMP = "2024-01-01T00:00:00Z"

COUNT = "CAST([1, 1, 1, 0, -1, 100, 1, 4, 5][src % 9 + 1] AS BIGINT)"
KEPT = """'original_topic=events; original_offset=' || CAST(src AS VARCHAR) || '; failed_at=2024-01-01T00:00:00Z'"""


def _backoff(n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN 0 ELSE least(60, CAST(2 * pow(2, least({n}, 6) - 1) AS BIGINT)) END"


ALL: dict[str, str] = {
    "event_id_stamp": f"WITH {EV_FULL} SELECT src, event_id FROM full_ev",
    "canonical_events": f"""WITH {EV_FULL}
        SELECT src, event_name, channel, campaign_id, user_id, timestamp, tags, metadata,
          {clock('timestamp')} AS created_at, {clock('timestamp')} AS ts, strftime(ts, '%Y-%m-%d') AS event_date,
          CAST(price AS DOUBLE) AS price
        FROM full_ev""",
    "synthetic_events": f"""
        SELECT
          ['product_view', 'add_to_cart', 'purchase', 'page_view', 'signup'][event_id % 200 % 5 + 1] AS event_name,
          ['web', 'mobile_app', 'api'][event_id % 200 % 3 + 1] AS channel,
          'cmp_' || CAST(event_id % 100 AS VARCHAR) AS campaign_id,
          'user_' || CAST(event_id % 10000 AS VARCHAR) AS user_id,
          {AT} - event_id % 200 AS timestamp,
          'test,loadtest,worker_' || CAST(event_id // 200 AS VARCHAR) AS tags,
          '{{"currency":"TRY","price":' || CAST(CAST(99.99 + event_id % 200 % 100 AS DOUBLE) AS VARCHAR)
            || ',"product_id":"prod_' || CAST(event_id % 200 AS VARCHAR)
            || '","worker_id":' || CAST(event_id // 200 AS VARCHAR) || '}}' AS metadata
        FROM events""",
    "validate_errors": f"""WITH {FAULTY}
        SELECT src, n, concat_ws(',', e1, e2, e3, e4, e5) AS codes,
          CASE WHEN n = 0 THEN 'validation error' ELSE concat_ws('; ', {message_of('e1')}, {message_of('e2')},
            {message_of('e3')}, {message_of('e4')}, {message_of('e5')}) END AS said
        FROM counted""",
    "valid_invalid_split": f"""WITH {FAULTY}
        SELECT src, event_id, CASE WHEN n = 0 THEN 'valid' ELSE 'invalid' END AS verdict FROM counted""",
    "bulk_outcome": bulk_answer("TRUE"),
    "bulk_publish_failure": bulk_answer("a.src % 3 <> 0"),
    "bulk_accepted_events": f"""WITH {BULK}
        SELECT CAST(src AS VARCHAR) AS request_id, CAST(index AS INT) AS index, timestamp,
          sha256(event_name || '|' || user_id || '|' || CAST(timestamp AS VARCHAR) || '|' || channel) AS event_id
        FROM item_errors WHERE error IS NULL""",
    "single_outcome": f"""WITH {SINGLE}
        SELECT CAST(src AS VARCHAR) AS request_id,
          CAST(CASE WHEN unread OR codes <> '' THEN 400 ELSE 202 END AS INT) AS status,
          CASE WHEN unread OR codes <> '' THEN '' ELSE
            sha256(event_name || '|' || user_id || '|' || CAST(timestamp AS VARCHAR) || '|' || channel) END AS event_id,
          CASE WHEN unread THEN 'invalid request body' WHEN codes <> '' THEN 'validation failed' ELSE '' END AS error,
          CASE WHEN unread THEN '' ELSE codes END AS codes
        FROM coded""",
    "single_accepted_messages": f"""WITH {SINGLE}
        SELECT CAST(src AS VARCHAR) AS request_id, coded.user_id AS key,
          '{{"event_id":"' || sha256(coded.event_name || '|' || coded.user_id || '|' || CAST(coded.timestamp AS VARCHAR) || '|' || coded.channel)
          || '","event_name":"' || coded.event_name || '","channel":"' || coded.channel || '","campaign_id":"' || campaign_id
          || '","user_id":"' || coded.user_id || '","timestamp":' || CAST(coded.timestamp AS VARCHAR) || ',"tags":["' || tags
          || '"],"metadata":{{}},"created_at":"' || strftime(make_timestamp(coded.now * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '"}}' AS value
        FROM coded JOIN ev USING (src) WHERE NOT unread AND codes = ''""",
    "single_refused": f"""WITH {SINGLE}
        SELECT CAST(src AS VARCHAR) AS request_id, CASE WHEN unread THEN 'invalid request body' ELSE
          concat_ws('; ', {', '.join(message_of(f"({x})") for x in (NAME_SAYS, USER_SAYS, TIME_SAYS, CHANNEL_SAYS))}) END AS reason
        FROM coded WHERE unread OR codes <> ''""",
    "metrics_request_errors": f"""WITH {REQUESTS}
        SELECT request_id, CAST((e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT + (e3 IS NOT NULL)::INT
          + (e4 IS NOT NULL)::INT + (e5 IS NOT NULL)::INT + (e6 IS NOT NULL)::INT AS INT) AS n,
          concat_ws(',', e1, e2, e3, e4, e5, e6) AS codes
        FROM request_codes""",
    "hourly_rollup": rollup("ev"),
    "hourly_window_rollup": rollup("ev"),
    "rollup_resend": rollup("again", SENT_AGAIN),
    "rollup_of_latest": rollup("newest", SENT_AGAIN),
    "rollup_compacted": rollup(
        "(SELECT event_name, channel, user_id, timestamp FROM ev "
        "UNION ALL SELECT event_name, channel, user_id, timestamp FROM again)",
        SENT_AGAIN,
    ),
    "latest_events": f"WITH {SENT_AGAIN} SELECT {VERSIONS} FROM newest",
    "stored_latest_events": f"WITH {SENT_AGAIN} SELECT {VERSIONS} FROM newest",
    "maintained_latest_events": f"WITH {SENT_AGAIN} SELECT {VERSIONS} FROM newest",
    "unseen_events": f"""WITH {SENT_AGAIN} SELECT {VERSIONS} FROM newest
        WHERE event_id NOT IN (SELECT event_id FROM full_ev WHERE timestamp <= {ASK_TO})""",
    "metrics_total": f"WITH {EV} SELECT {COUNTS} FROM ev WHERE {RANGE}",
    "metrics_total_channel": f"WITH {EV} SELECT {COUNTS} FROM ev WHERE {RANGE} AND channel = 'web'",
    "metrics_by_channel": grouped("channel"),
    "metrics_by_hour": grouped(clock(HOUR)),
    "metrics_by_day": grouped(clock(DAY)),
    "metrics_by_unknown": f"WITH {EV} SELECT 'total' AS key, {COUNTS} FROM ev WHERE {RANGE}",
    "metrics_shaped": f"""SELECT request_id, max(total_count) FILTER (WHERE scope = 'total') AS total_count,
        max(unique_users) FILTER (WHERE scope = 'total') AS unique_users,
        coalesce(string_agg(key || ':' || total_count || ':' || unique_users, ';' ORDER BY key)
                 FILTER (WHERE scope = 'group'), '') AS grouped_data
        FROM ({ANSWERS}) GROUP BY request_id""",
    "metrics_answer": f"""WITH {EV}
        SELECT 'total' AS scope, '' AS key, {COUNTS} FROM ev WHERE {RANGE} AND channel = 'api'
        UNION ALL
        SELECT 'group', {clock(DAY)}, {COUNTS} FROM ev WHERE {RANGE} AND channel = 'api' GROUP BY 2""",
    "metrics_requests_batch": ANSWERS,
    "b01_total_events": f"WITH {DAY_HOURS} SELECT count(*) AS total_events FROM recent",
    "b02_unique_users": f"WITH {DAY_HOURS} SELECT count(DISTINCT user_id) AS unique_users FROM recent",
    "b03_purchases": f"WITH {DAY_HOURS} SELECT count(*) AS purchases FROM recent WHERE {SOLD}",
    "b04_active_campaigns": f"WITH {DAY_EVENTS} SELECT count(DISTINCT campaign_id) AS active_campaigns FROM recent",
    "b05_total_revenue": f"WITH {DAY_EVENTS} SELECT {MONEY} AS total_revenue FROM recent WHERE {SOLD}",
    "b06_avg_order_value": f"""WITH {DAY_EVENTS} SELECT CASE WHEN count(*) > 0 THEN {MONEY} / count(*) ELSE 0.0 END
        AS avg_order_value FROM recent WHERE {SOLD}""",
    "b07_revenue_over_time": f"""WITH {DAY_EVENTS} SELECT {clock(HOUR)} AS time, {MONEY} AS revenue FROM recent
        WHERE {SOLD} GROUP BY 1""",
    "b08_events_over_time": f"WITH {DAY_HOURS} SELECT {clock(HOUR)} AS time, count(*) AS events FROM recent GROUP BY 1",
    "b09_unique_users_over_time": f"""WITH {DAY_HOURS} SELECT {clock(HOUR)} AS time,
        count(DISTINCT user_id) AS unique_users FROM recent GROUP BY 1""",
    "b10_events_by_channel": f"WITH {DAY_HOURS} SELECT channel, count(*) AS count FROM recent GROUP BY 1",
    "b11_events_by_type": f"WITH {DAY_HOURS} SELECT event_name, count(*) AS count FROM recent GROUP BY 1",
    "b12_events_by_type_channel": f"""WITH {DAY_HOURS}
        SELECT event_name, channel, count(*) AS count FROM recent GROUP BY 1, 2""",
    "b13_top_campaigns": f"""WITH {DAY_EVENTS}
        SELECT campaign_id, count(*) AS event_count, count(DISTINCT user_id) AS unique_users
        FROM recent GROUP BY campaign_id ORDER BY event_count DESC, campaign_id LIMIT 10""",
    "publish_messages": f"""WITH {EV_FULL}
        SELECT src, user_id AS key, '{{"event_id":"' || event_id || '","event_name":"' || event_name
          || '","channel":"' || channel || '","campaign_id":"' || campaign_id || '","user_id":"' || user_id
          || '","timestamp":' || CAST(timestamp AS VARCHAR) || ',"tags":["' || tags || '"],"metadata":' || metadata
          || ',"created_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}}' AS value
        FROM full_ev""",
    "decode_split": f"""WITH {DECODED}
        SELECT src, problem, CASE WHEN problem = '' THEN event_name END AS event_name,
          CASE WHEN problem = '' THEN channel END AS channel, CASE WHEN problem = '' THEN campaign_id END AS campaign_id,
          CASE WHEN problem = '' THEN user_id END AS user_id, CASE WHEN problem = '' THEN timestamp END AS timestamp,
          CASE WHEN problem = '' THEN tags END AS tags, CASE WHEN problem = '' THEN metadata END AS metadata
        FROM decoded""",
    "malformed_to_dead_letters": f"""WITH {DECODED}
        SELECT src, 'error_type=unmarshal_error; error_message=' || problem || '; ' || {ORIGIN}
          || '; failed_at={STAMP}' AS headers
        FROM decoded WHERE problem <> ''""",
    "insert_failed_to_retry": f"""WITH {DECODED}
        SELECT src, 'retry_count=1; error_type=insert_failed; error_message=no room; ' || {ORIGIN}
          || '; failed_at={STAMP}' AS headers, CAST(1 AS BIGINT) AS retry_count,
          '2024-01-01T00:00:02Z' AS next_attempt_at
        FROM landed""",
    "retry_count_decode": f"WITH {EV} SELECT src, {COUNT} AS retry_count FROM ev",
    "retry_backoff": f"""WITH {EV}
        SELECT CAST(src % 20 AS INT) AS partition, max({COUNT}) AS max_retry_count,
          {_backoff(f'max({COUNT})')} AS delay_seconds
        FROM ev GROUP BY 1""",
    "retry_outcome": f"""WITH {EV}
        SELECT src, CASE WHEN {COUNT} >= 5 THEN 'dead' ELSE 'retry' END AS route,
          CASE WHEN {COUNT} >= 5
            THEN 'final_retry_count=' || CAST({COUNT} AS VARCHAR) || '; error_type=max_retries_exhausted'
              || '; error_message=still no room; sent_to_dlq_at={STAMP}; ' || {KEPT}
              || '; last_retry_at=2024-01-01T00:01:00Z'
            ELSE 'retry_count=' || CAST({COUNT} + 1 AS VARCHAR) || '; error_type=insert_failed'
              || '; error_message=still no room; last_retry_at={STAMP}; ' || {KEPT} END AS headers
        FROM ev""",
    "dlq_envelope": f"""WITH {DECODED}
        SELECT src, 'final_retry_count=' || CAST({COUNT} AS VARCHAR) || '; error_type=unmarshal_error; error_message='
          || problem || '; sent_to_dlq_at={STAMP}; ' || {KEPT} || '; last_retry_at=2024-01-01T00:01:00Z' AS headers
        FROM decoded WHERE problem <> ''""",
    "failure_counts": f"""WITH {DECODED}
        SELECT CASE WHEN problem <> '' THEN 'unmarshal_error' ELSE 'insert_failed' END AS error_type,
          count(*) AS messages
        FROM decoded GROUP BY 1""",
    "stream_ingest_rollup": rollup("landed", DECODED),
    "stream_batches_rollup": rollup("landed", DECODED),
    "stream_ingest_events": f"""WITH {DECODED}
        SELECT event_id, event_name, channel, campaign_id, user_id, timestamp, tags, metadata FROM landed""",
    "stream_dead_letters": f"""WITH {DECODED}
        SELECT src, CAST(src % 20 AS INT) AS partition, {BAD_VALUE} AS value,
          'error_type=unmarshal_error; error_message=' || problem || '; ' || {ORIGIN} || '; failed_at={STAMP}' AS headers
        FROM decoded WHERE problem <> ''""",
    "stream_retry_recovers": rollup("landed", DECODED),
    "failure_counts_stored": f"""WITH {DECODED}
        SELECT CASE WHEN problem <> '' THEN 'unmarshal_error' ELSE 'insert_failed' END AS error_type,
          count(*) AS messages
        FROM decoded GROUP BY 1""",
}

# Each panel once more, as rows of one table.
_SHOWN = {
    "b01_total_events": ("''", "''", "total_events"),
    "b02_unique_users": ("''", "''", "unique_users"),
    "b03_purchases": ("''", "''", "purchases"),
    "b04_active_campaigns": ("''", "''", "active_campaigns"),
    "b05_total_revenue": ("''", "''", "total_revenue"),
    "b06_avg_order_value": ("''", "''", "avg_order_value"),
    "b07_revenue_over_time": ("time", "''", "revenue"),
    "b08_events_over_time": ("time", "''", "events"),
    "b09_unique_users_over_time": ("time", "''", "unique_users"),
    "b10_events_by_channel": ("channel", "''", "count"),
    "b11_events_by_type": ("event_name", "''", "count"),
    "b12_events_by_type_channel": ("event_name", "channel", "count"),
    "b13_top_campaigns": ("campaign_id", "'event_count'", "event_count"),
}


def _shown(panel: str, key: str, second: str, value: str) -> str:
    return f"SELECT '{panel}' AS panel, {key} AS key, {second} AS second_key, CAST({value} AS DOUBLE) AS value FROM ({ALL[panel]})"


ALL["stream_hours_rollup"] = ALL["hourly_rollup"]
ALL["latest_events_by_curve"] = ALL["stored_latest_events"]
ALL["b04_from_bitmaps"] = ALL["b04_active_campaigns"]
ALL["b13_from_lists"] = ALL["b13_top_campaigns"]
ALL["unseen_by_filters"] = ALL["unseen_events"]
ALL["panels_refresh"] = " UNION ALL ".join(
    [*(_shown(panel, *how) for panel, how in _SHOWN.items()), _shown("b13_top_campaigns", "campaign_id", "'unique_users'", "unique_users")]
)
