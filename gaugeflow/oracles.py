"""The result of every query as plain SQL over the same tables.

Written apart from the jobs: the SQL states the outcome of each rule - which messages are
damaged, which rows a page holds - from the events themselves.
"""

from __future__ import annotations

from gaugeflow.operators.metrics import HISTOGRAM_BOUNDS

# One row per event: the reading behind it, and the number in its props.
READINGS = """
r AS (
  SELECT event_id, event_id AS id, user_id, event_type,
    CAST(user_id * 10 + CASE WHEN event_type IN ('view', 'click') THEN 1
      WHEN event_type IN ('signup', 'error') THEN 2 ELSE 3 END AS INTEGER) AS sensor_id,
    'loc-' || user_id AS name, ts AS collected_at, value,
    CASE WHEN event_type IN ('view', 'click') THEN 'air_quality'
      WHEN event_type IN ('signup', 'error') THEN 'motion' ELSE 'energy' END AS sensor_type,
    CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value * 5) AS INTEGER) END AS co2,
    CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value / 10) AS INTEGER) END AS pm25,
    CASE WHEN event_type IN ('view', 'click')
      THEN CAST(floor(value) AS INTEGER) % 100 END AS humidity,
    CASE WHEN event_type = 'purchase' THEN value END AS energy_kwh,
    CASE WHEN event_type IN ('signup', 'error') THEN event_type = 'signup' END AS motion_detected,
    CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events
), s AS (SELECT DISTINCT sensor_id AS id, name, sensor_type FROM r)"""

# One row per wire message, with the reason it cannot be decoded, if any.
MESSAGES = (
    READINGS
    + """, m AS (
  SELECT r.*, CAST(user_id % 3 AS INTEGER) AS "partition", event_id * 2 + copy AS "offset",
    CASE
      WHEN k = 17 THEN 'The message body is empty.'
      WHEN k = 11 THEN 'The message body deserialized to null.'
      WHEN k IN (7, 13, 41, 43, 47) THEN 'The message body is not valid JSON.'
      WHEN k IN (19, 53) THEN 'The message has no sensor name.'
      WHEN k = 3 THEN 'Unrecognised sensor type ''temperature''.'
      WHEN k = 31 THEN 'The payload is Array, expected an object.'
      WHEN k = 37 THEN 'The payload is Undefined, expected an object.'
      WHEN k IN (23, 29) AND sensor_type = 'air_quality'
        THEN 'An air quality payload requires numeric co2, pm25 and humidity fields.'
      WHEN k = 29 AND sensor_type = 'motion'
        THEN 'A motion payload requires a boolean motionDetected field.'
      WHEN k IN (23, 29) AND sensor_type = 'energy'
        THEN 'An energy payload requires a numeric energy field.'
    END AS error_detail
  FROM r, (VALUES (0), (1)) AS c(copy) WHERE copy = 0 OR k = 61
), g AS (SELECT * FROM m WHERE error_detail IS NULL),
f AS (
  SELECT * FROM g QUALIFY row_number() OVER (
    PARTITION BY name, sensor_type, collected_at ORDER BY "partition", "offset") = 1
)"""
)

# One row per landed poll, and one per reading of the successful ones.
POLLS = (
    READINGS
    + """, p AS (
  SELECT event_id // 20 AS poll_id, arg_min(k, event_id) AS k0, max(collected_at) AS fetched_at,
    bool_or(k = 31) AS has_bad
  FROM r GROUP BY 1
), po AS (
  SELECT *, CASE WHEN k0 < 5 THEN 'rate_limited' WHEN k0 < 9 THEN 'server_error'
      WHEN k0 < 10 THEN 'unexpected' WHEN k0 < 13 THEN 'corrupted' WHEN k0 < 15 THEN 'malformed'
      WHEN k0 < 17 THEN 'empty' WHEN has_bad THEN 'malformed' ELSE 'success' END AS outcome
  FROM p
), pr AS (
  SELECT po.poll_id, po.fetched_at, r.*,
    CAST(row_number() OVER (PARTITION BY po.poll_id ORDER BY event_id) - 1 AS INTEGER) AS position,
    CASE WHEN k = 3 THEN 'temperature' ELSE sensor_type END AS wire_type
  FROM r JOIN po ON r.event_id // 20 = po.poll_id WHERE outcome = 'success'
)"""
)

VALUES = "co2, pm25, humidity, energy_kwh, motion_detected"
FLAT = f"id, name AS sensor_name, sensor_type, collected_at, {VALUES}"
PLAIN = f"id, sensor_id, collected_at, sensor_type, {VALUES}"
IN_RANGE = "collected_at >= '2024-01-03 10:30:00' AND collected_at < '2024-01-24 17:45:00'"

CHANGES = (
    READINGS
    + """, c AS (
  SELECT *, make_timestamp(epoch_us(TIMESTAMP '2024-01-31')
      + CAST(floor((epoch_us(collected_at) - epoch_us(TIMESTAMP '2024-01-31')) / 1000) AS BIGINT))
      AS published_at,
    CAST(CASE WHEN k = 2 THEN 0 ELSE k END AS INTEGER) AS reading_count,
    CAST(CASE WHEN k = 5 THEN 0 ELSE 1 END AS INTEGER) AS sensor_count
  FROM r WHERE k NOT IN (7, 11, 17)
)"""
)

BURSTS = """, j AS (SELECT *, CASE WHEN published_at - lag(published_at) OVER (
      ORDER BY published_at) < INTERVAL 400 MILLISECOND THEN 0 ELSE 1 END AS opens FROM c),
  k AS (SELECT *, sum(opens) OVER (ORDER BY published_at
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM j)
  SELECT min(published_at) AS first_event_at,
    max(published_at) + INTERVAL 400 MILLISECOND AS refresh_at, count(*) AS events,
    CAST(sum(reading_count) AS BIGINT) AS readings FROM k GROUP BY burst"""

METRICS = (
    READINGS
    + """, d AS (
  SELECT collected_at AS ts, event_type,
    CASE event_type WHEN 'view' THEN 'ingest.messages_consumed'
      WHEN 'click' THEN 'ingest.readings_inserted'
      WHEN 'signup' THEN 'produce.poll_requests'
      WHEN 'error' THEN 'ingest.dead_lettered_messages'
      ELSE 'ingest.batch_duration' END AS name,
    CASE WHEN event_type = 'error' THEN
      CASE WHEN k < 10 THEN 'persist-failed' ELSE 'decode-failed' END END AS reason,
    CASE WHEN event_type = 'signup' THEN
      CASE WHEN k < 20 THEN 'failure' ELSE 'success' END END AS outcome,
    CASE WHEN event_type = 'purchase' THEN value ELSE CAST(k AS DOUBLE) END AS value
  FROM r
), w AS (
  SELECT d.*, time_bucket(INTERVAL 15 SECOND, ts) + to_seconds(15 * i) AS range_end
  FROM d, range(1, 21) AS t(i)
)"""
)

INSTRUMENTS = (
    READINGS
    + """, d AS (
  SELECT collected_at AS ts, event_type,
    CASE WHEN event_type = 'purchase' THEN ['ingest.write_duration', 'ingest.newest_reading_lag',
        'produce.poll_duration', 'relay.event_lag'][1 + k % 4]
      ELSE ['ingest.duplicates_skipped', 'ingest.batch_retries', 'ingest.batches_processed',
        'ingest.events_published', 'produce.messages_produced', 'produce.messages_failed',
        'produce.readings_polled', 'relay.events_consumed', 'relay.events_pushed'][1 + k % 9]
    END AS name,
    CASE WHEN event_type = 'purchase' THEN value ELSE CAST(k AS DOUBLE) END AS value
  FROM r
), w AS (
  SELECT d.*, time_bucket(INTERVAL 15 SECOND, ts) + to_seconds(15 * i) AS range_end
  FROM d, range(1, 21) AS t(i)
)"""
)

AGE = """CASE WHEN secs < 60 THEN secs || 's' WHEN secs < 3600 THEN (secs // 60) || 'm'
  ELSE (secs // 3600) || 'h' || lpad(CAST((secs // 60) % 60 AS VARCHAR), 2, '0') END"""


POSITIONS = """, sp AS (
  SELECT "partition", min("offset") AS low, max("offset") - min("offset") + 1 AS width
  FROM m GROUP BY 1
), sb AS (
  SELECT "partition", low, sum(width) OVER (ORDER BY "partition") - width AS before FROM sp
), gp AS (
  SELECT g.*, CAST((before + "offset" - low) // 500 AS BIGINT)::VARCHAR AS announcement
  FROM g JOIN sb USING ("partition")
), fp AS (
  SELECT announcement, CAST(count(*) AS INTEGER) AS reading_count
  FROM f JOIN gp USING ("partition", "offset") GROUP BY 1
)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()} {select}"


def _secs(at: str, now: str) -> str:
    age = f"(epoch_ms(TIMESTAMP '{now}') - floor(epoch_us({at}) / 1000))"
    return f"CAST(greatest(0, floor(({age} + 500) / 1000)) AS BIGINT)"


def _state(at: str, now: str) -> str:
    age = f"(epoch_ms(TIMESTAMP '{now}') - floor(epoch_us({at}) / 1000))"
    return (
        f"CASE WHEN {at} IS NULL THEN NULL WHEN {age} >= 900000 THEN 'lost' "
        f"WHEN {age} >= 120000 THEN 'stale' ELSE 'live' END"
    )


def _buckets(value: str, kind: str, unit: str, where: str = IN_RANGE) -> str:
    return _with(
        READINGS,
        f"""SELECT date_trunc('{unit}', collected_at)::TIMESTAMP AS period_start, name AS location,
        count(*) AS count, round(avg({value}), 6) AS average,
        CAST(min({value}) AS DOUBLE) AS minimum, CAST(max({value}) AS DOUBLE) AS maximum
        FROM r WHERE sensor_type = '{kind}' AND {where} GROUP BY 1, 2""",
    )


# Widened to whole days and to whole weeks.
IN_DAYS = "collected_at >= '2024-01-03' AND collected_at < '2024-01-25'"
IN_WEEKS = "collected_at >= '2024-01-01' AND collected_at < '2024-01-29'"
IN_HOURS = "collected_at >= '2024-01-03 10:00:00' AND collected_at < '2024-01-24 18:00:00'"

BREACHES = """, b AS (
  SELECT id, 1 AS place, 'CO2 HIGH' AS label, '>1000' AS "limit" FROM r WHERE co2 > 1000
  UNION ALL SELECT id, 2, 'PM2.5 HIGH', '>15' FROM r WHERE pm25 > 15
  UNION ALL SELECT id, 3, 'RH LOW', '<30' FROM r WHERE humidity < 30
  UNION ALL SELECT id, 4, 'RH HIGH', '>60' FROM r WHERE humidity > 60
), bp AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS INTEGER) AS position,
    count(*) OVER (PARTITION BY id) AS n FROM b
)"""

STATUS_NOW = "2024-01-29 12:00:00"
STATUS = (
    READINGS
    + BREACHES
    + f""", l AS (
  SELECT *, {_state("collected_at", STATUS_NOW)} AS state FROM r
  WHERE collected_at >= '2024-01-10'
  QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY collected_at DESC, id DESC) = 1
), o AS (
  SELECT name AS location, min(collected_at) AS oldest,
    {_state("min(collected_at)", STATUS_NOW)} AS worst,
    {_secs("min(collected_at)", STATUS_NOW)} AS secs,
    concat_ws(' + ', max(CASE WHEN sensor_type = 'air_quality' THEN 'AIR_QUALITY' END),
      max(CASE WHEN sensor_type = 'motion' THEN 'MOTION' END),
      max(CASE WHEN sensor_type = 'energy' THEN 'ENERGY' END)) AS types
  FROM l GROUP BY 1
), a AS (SELECT * FROM l WHERE sensor_type = 'air_quality'),
mo AS (SELECT * FROM l WHERE sensor_type = 'motion'),
en AS (SELECT * FROM l WHERE sensor_type = 'energy')"""
)
JOINED = """FROM o LEFT JOIN a ON a.name = o.location LEFT JOIN mo ON mo.name = o.location
  LEFT JOIN en ON en.name = o.location"""

CURSOR = "to_base64(encode(epoch_us(collected_at) || ':' || id))"
OLDER = f"""SELECT {FLAT}, {CURSOR} AS cursor FROM r
  WHERE collected_at < '2024-01-16' ORDER BY collected_at DESC, id DESC LIMIT 40"""
NEWER = f"""SELECT {FLAT}, {CURSOR} AS cursor FROM r
  WHERE collected_at >= '2024-01-16' ORDER BY collected_at, id LIMIT 40"""


def _histogram(bounds: tuple[float, ...], rows: str = METRICS) -> str:
    """Interpolated quantile from per-bucket counts, bucket by bucket."""
    lowers = (0.0, *bounds[:-1])
    counts = ", ".join(
        f"count(*) FILTER (WHERE value <= {upper}) AS c{i}" for i, upper in enumerate(bounds)
    )
    cases = "WHEN c0 >= 0.95 * n THEN 0.0 " + " ".join(
        f"WHEN c{i} >= 0.95 * n THEN {lowers[i]} + ({bounds[i]} - {lowers[i]}) "
        f"* (0.95 * n - c{i - 1}) / (c{i} - c{i - 1})"
        for i in range(1, len(bounds))
    )
    return _with(
        rows,
        f""", h AS (SELECT name, range_end, count(*) AS n, {counts} FROM w
        WHERE event_type = 'purchase' GROUP BY 1, 2)
        SELECT name, range_end, round(CAST(CASE {cases} ELSE {bounds[-1]} END AS DOUBLE), 6) AS quantile
        FROM h""",
    )


ORACLES: dict[str, str] = {
    # landed polls and messages
    "poll_outcomes": _with(
        POLLS,
        """SELECT poll_id, outcome,
        CASE WHEN outcome = 'rate_limited' AND k0 < 3 THEN 120.0::DOUBLE ELSE 60.0::DOUBLE END
          AS next_delay_s FROM po""",
    ),
    "poll_readings": _with(
        POLLS,
        """SELECT poll_id, position, wire_type AS type, name,
        CASE WHEN k <> 3 THEN co2 END AS co2, CASE WHEN k <> 3 THEN pm25 END AS pm25,
        CASE WHEN k = 23 AND humidity IS NOT NULL THEN 0 WHEN k <> 3 THEN humidity END AS humidity,
        CASE WHEN k = 23 AND motion_detected IS NOT NULL THEN false
          WHEN k <> 3 THEN motion_detected END AS "motionDetected",
        CASE WHEN k <> 3 THEN energy_kwh END AS energy, fetched_at AS collected_at FROM pr""",
    ),
    "poll_unknown_payloads": _with(
        POLLS,
        """SELECT poll_id, position, wire_type AS type, co2 AS raw_co2,
        CAST(motion_detected AS VARCHAR) AS raw_motion FROM pr WHERE k = 3""",
    ),
    "reading_messages": _with(
        POLLS,
        """SELECT poll_id, position, wire_type || ':' || name AS key,
        'type,name,payload,collectedAt' AS members,
        CASE wire_type WHEN 'air_quality' THEN 'co2,pm25,humidity' WHEN 'motion'
          THEN 'motionDetected' WHEN 'energy' THEN 'energy' ELSE 'rawJson' END AS fields,
        strftime(fetched_at, '%Y-%m-%dT%H:%M:%S')
          || rtrim(rtrim(strftime(fetched_at, '.%f'), '0'), '.') || '+00:00' AS collected_text,
        'content-type=application/json;schema-version=1' AS headers FROM pr""",
    ),
    "decoded_readings": _with(
        MESSAGES,
        f"""SELECT "partition", "offset", name, sensor_type, collected_at, {VALUES} FROM g""",
    ),
    "decode_failures": _with(
        MESSAGES,
        """SELECT "partition", "offset", error_detail FROM m WHERE error_detail IS NOT NULL""",
    ),
    "dead_letter_headers": _with(
        MESSAGES,
        """, h AS (SELECT "offset" AS source_offset, unnest([
          ('traceparent', '00-' || lower(lpad(hex(event_id + 1), 32, '0')) || '-00f067aa0ba902b7-01'),
          ('dlq-original-topic', 'meter-readings'),
          ('dlq-original-partition', CAST("partition" AS VARCHAR)),
          ('dlq-original-offset', CAST("offset" AS VARCHAR)),
          ('dlq-reason', 'decode-failed'), ('dlq-detail', error_detail),
          ('dlq-timestamp', '2024-01-31T00:00:00.0000000+00:00')]) AS h,
          unnest([0, 1, 2, 3, 4, 5, 6]) AS position
          FROM m WHERE error_detail IS NOT NULL)
        SELECT source_offset, CAST(position AS INTEGER) AS position, h[1] AS header,
          h[2] AS value FROM h""",
    ),
    "sensor_type_spellings": _with(
        READINGS,
        """SELECT event_id, CASE event_type WHEN 'click' THEN upper(sensor_type)
          WHEN 'error' THEN '2' ELSE sensor_type END AS spelling,
          event_type NOT IN ('click', 'error') AS known FROM r""",
    ),
    "normalized_instants": "SELECT event_id, ts - INTERVAL 2 HOUR AS collected_at FROM events",
    "next_offsets": _with(
        MESSAGES,
        """SELECT 'meter-readings' AS topic, "partition", max("offset") + 1 AS next_offset
        FROM m GROUP BY 2""",
    ),
    "upstream_traces": """SELECT DISTINCT lower(lpad(hex(event_id + 1), 32, '0')) AS trace_id
        FROM events""",
    "batch_lag": _with(
        MESSAGES,
        """SELECT (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(collected_at))) / 1000000.0::DOUBLE
        AS lag_s FROM g""",
    ),
    "rows_from_parallel_arrays": _with(READINGS, "SELECT id, sensor_id, collected_at, co2 FROM r"),
    # listings
    "flat_readings": _with(READINGS, f"SELECT {FLAT} FROM r"),
    "nested_readings": _with(READINGS, f"SELECT {FLAT}, sensor_id FROM r"),
    "motion_readings": _with(
        READINGS,
        """SELECT id, sensor_id, collected_at, sensor_type, motion_detected FROM r
        WHERE sensor_type = 'motion'""",
    ),
    "filtered_readings": _with(
        READINGS,
        f"""SELECT {PLAIN} FROM r WHERE name = 'loc-7' AND sensor_type = 'air_quality'
        AND {IN_RANGE}""",
    ),
    "readings_in_range": _with(READINGS, f"SELECT {PLAIN} FROM r WHERE {IN_RANGE}"),
    "readings_page": _with(
        READINGS,
        f"SELECT {FLAT} FROM r ORDER BY collected_at DESC, id DESC LIMIT 50 OFFSET 100",
    ),
    "readings_page_filtered": _with(
        READINGS,
        f"""SELECT {FLAT} FROM r WHERE sensor_type = 'energy'
        AND collected_at >= '2024-01-03 10:30:00'
        ORDER BY collected_at DESC, id DESC LIMIT 25""",
    ),
    "readings_page_deep": _with(
        READINGS,
        f"SELECT {PLAIN} FROM r ORDER BY collected_at DESC, id DESC LIMIT 500 OFFSET 7000",
    ),
    "readings_page_summary": """SELECT 2 AS page, 50 AS page_size, count(*) AS total_count,
        CAST(ceil(count(*) / 50) AS INTEGER) AS total_pages, count(*) > 100 AS has_more
        FROM events WHERE ts >= '2024-01-03 10:30:00'""",
    "reading_count": _with(
        READINGS, f"SELECT count(*) AS total_count FROM r WHERE name = 'loc-7' AND {IN_RANGE}"
    ),
    "connection_forward": _with(READINGS, OLDER),
    "connection_forward_info": _with(
        READINGS,
        f""", e AS ({OLDER}) SELECT
        (SELECT count(*) FROM r WHERE collected_at < '2024-01-16') > 40 AS has_next_page,
        true AS has_previous_page, arg_max(cursor, collected_at) AS start_cursor,
        arg_min(cursor, collected_at) AS end_cursor FROM e""",
    ),
    "connection_backward": _with(READINGS, NEWER),
    "connection_backward_info": _with(
        READINGS,
        f""", e AS ({NEWER}) SELECT true AS has_next_page,
        (SELECT count(*) FROM r WHERE collected_at >= '2024-01-16') > 40 AS has_previous_page,
        arg_max(cursor, collected_at) AS start_cursor,
        arg_min(cursor, collected_at) AS end_cursor FROM e""",
    ),
    "connection_default": _with(
        READINGS,
        f"""SELECT {FLAT}, {CURSOR} AS cursor FROM r WHERE sensor_type = 'motion'
        ORDER BY collected_at DESC, id DESC LIMIT 25""",
    ),
    "connection_total": _with(
        READINGS, "SELECT count(*) AS total_count FROM r WHERE sensor_type = 'energy'"
    ),
    "reading_json": _with(
        READINGS,
        """SELECT id, 'id,sensor_name,sensor_type,' || CASE sensor_type
          WHEN 'air_quality' THEN 'co2,pm25,humidity' WHEN 'motion' THEN 'motion_detected'
          ELSE 'energy_kwh' END AS members, co2, pm25, humidity, energy_kwh, motion_detected
        FROM r""",
    ),
    "location_search": _with(
        READINGS, "SELECT DISTINCT name AS location FROM s WHERE name LIKE '%loc-1%'"
    ),
    "sensor_catalogue": _with(READINGS, "SELECT id, name, sensor_type FROM s"),
    "locations": _with(READINGS, "SELECT DISTINCT name AS location FROM s"),
    "sensor_lookup": _with(
        READINGS, "SELECT min(id) AS id FROM s WHERE name = 'loc-7' AND sensor_type = 'motion'"
    ),
    "readings_per_type": _with(
        READINGS, "SELECT sensor_type, count(*) AS count FROM r GROUP BY 1"
    ),
    "latest_per_sensor": _with(
        READINGS,
        f"""SELECT {FLAT} FROM r QUALIFY row_number() OVER (
        PARTITION BY sensor_id ORDER BY collected_at DESC, id DESC) = 1""",
    ),
    "latest_in_range": _with(
        READINGS,
        f"""SELECT {FLAT} FROM r WHERE sensor_type = 'air_quality' AND {IN_RANGE}
        QUALIFY row_number() OVER (
        PARTITION BY sensor_id ORDER BY collected_at DESC, id DESC) = 1""",
    ),
    # aggregates
    "hourly_energy": _buckets("energy_kwh", "energy", "hour"),
    "daily_co2": _buckets("co2", "air_quality", "day"),
    "weekly_motion": _buckets("CAST(motion_detected AS INTEGER)", "motion", "week"),
    "monthly_humidity": _buckets("humidity", "air_quality", "month"),
    "daily_pm25_of_location": _buckets(
        "pm25", "air_quality", "day", f"name = 'loc-7' AND {IN_RANGE}"
    ),
    "hourly_default_range": _buckets(
        "energy_kwh",
        "energy",
        "hour",
        "collected_at >= '2024-01-30' AND collected_at < '2024-01-31'",
    ),
    "metric_samples": _with(
        READINGS,
        """SELECT sensor_id, collected_at, 'co2' AS metric, 'ppm' AS unit,
          CAST(co2 AS DOUBLE) AS value FROM r WHERE co2 IS NOT NULL
        UNION ALL SELECT sensor_id, collected_at, 'pm25', 'ug/m3', pm25 FROM r
          WHERE pm25 IS NOT NULL
        UNION ALL SELECT sensor_id, collected_at, 'humidity', '%', humidity FROM r
          WHERE humidity IS NOT NULL
        UNION ALL SELECT sensor_id, collected_at, 'motion_detected', 'fraction',
          CASE WHEN motion_detected THEN 1 ELSE 0 END FROM r WHERE motion_detected IS NOT NULL
        UNION ALL SELECT sensor_id, collected_at, 'energy_kwh', 'kWh', energy_kwh FROM r
          WHERE energy_kwh IS NOT NULL""",
    ),
    "period_starts": """SELECT event_id AS id, date_trunc('hour', ts)::TIMESTAMP AS hour,
        date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('week', ts)::TIMESTAMP AS week,
        date_trunc('month', ts)::TIMESTAMP AS month FROM events""",
    "weekly_series": "SELECT *, 'ppm' AS unit FROM ("
    + _buckets("co2", "air_quality", "week", IN_WEEKS)
    + ")",
    "aligned_series": _with(
        READINGS,
        f""", q AS (SELECT date_trunc('day', collected_at)::TIMESTAMP AS period_start,
          name AS location, avg(humidity) AS average FROM r
          WHERE sensor_type = 'air_quality' AND {IN_DAYS} GROUP BY 1, 2)
        SELECT l.location, '%' AS unit, x.period_start, round(q.average, 6) AS average,
          60.0::DOUBLE AS threshold
        FROM (SELECT DISTINCT location FROM q) l
        CROSS JOIN (SELECT DISTINCT period_start FROM q) x
        LEFT JOIN q ON q.location = l.location AND q.period_start = x.period_start""",
    ),
    "series_gaps": _with(
        READINGS,
        f""", q AS (SELECT DISTINCT date_trunc('day', collected_at)::TIMESTAMP AS period_start,
          name AS location FROM r WHERE sensor_type = 'air_quality' AND {IN_DAYS}),
        x AS (SELECT period_start, row_number() OVER (ORDER BY period_start) - 1 AS i
          FROM (SELECT DISTINCT period_start FROM q)),
        e AS (SELECT l.location, min(CASE WHEN q.location IS NULL THEN x.i END) AS gap
          FROM (SELECT DISTINCT location FROM q) l CROSS JOIN x
          LEFT JOIN q ON q.location = l.location AND q.period_start = x.period_start GROUP BY 1)
        SELECT e.location, CAST(e.gap AS INTEGER) AS gap_index, x.period_start AS lost_at
        FROM e LEFT JOIN x ON x.i = e.gap - 1""",
    ),
    "period_axis": _with(
        READINGS,
        f"""SELECT DISTINCT date_trunc('day', collected_at)::TIMESTAMP AS period_start FROM r
        WHERE sensor_type = 'energy' AND {IN_DAYS}""",
    ),
    "period_count": _with(
        READINGS,
        f"""SELECT count(DISTINCT date_trunc('hour', collected_at)) AS period_count FROM r
        WHERE sensor_type = 'energy' AND {IN_HOURS}""",
    ),
    # ingest
    "first_arrivals": _with(
        MESSAGES, """SELECT "partition", "offset", name, sensor_type, collected_at FROM f"""
    ),
    "insert_skipping_stored": _with(
        READINGS,
        f"SELECT {PLAIN} FROM r WHERE collected_at >= '2024-01-16'",
    ),
    "insert_summary": _with(
        MESSAGES,
        """SELECT count(*) AS inserted, (SELECT count(*) FROM g) - count(*) AS duplicates_skipped
        FROM f WHERE collected_at >= '2024-01-16'""",
    ),
    "new_sensors": _with(
        READINGS,
        """, u AS (SELECT DISTINCT name, sensor_type FROM r WHERE collected_at >= '2024-01-02'
          EXCEPT SELECT name, sensor_type FROM r WHERE collected_at < '2024-01-02')
        SELECT CAST(1000 + row_number() OVER (ORDER BY name, sensor_type) AS INTEGER) AS id,
          name, sensor_type FROM u""",
    ),
    "change_events": _with(
        MESSAGES + POSITIONS,
        """, pairs AS (SELECT announcement, name, sensor_type, min(("partition", "offset")) AS seen
            FROM gp GROUP BY 1, 2, 3),
        newest AS (SELECT announcement, max(collected_at) AS newest_collected_at FROM gp GROUP BY 1)
        SELECT pairs.announcement, TIMESTAMP '2024-01-31' AS published_at, reading_count,
          newest_collected_at, name AS location, sensor_type,
          CAST(row_number() OVER (PARTITION BY pairs.announcement ORDER BY seen) - 1 AS INTEGER)
            AS position
        FROM pairs JOIN fp USING (announcement) JOIN newest USING (announcement)""",
    ),
    "ingest_stored": _with(
        MESSAGES,
        f"""SELECT name AS sensor_name, sensor_type, collected_at, {VALUES},
        row_number() OVER (ORDER BY "partition", "offset") AS arrival FROM f""",
    ),
    "fed_stored": _with(MESSAGES, f"SELECT name AS sensor_name, sensor_type, collected_at, {VALUES} FROM f"),
    "ingest_dead_letters": _with(
        MESSAGES,
        """SELECT sensor_type || ':' || name AS key, CAST("offset" AS VARCHAR) AS source_offset,
        'decode-failed' AS reason, error_detail AS detail FROM m
        WHERE error_detail IS NOT NULL""",
    ),
    "ingest_announced": _with(
        MESSAGES + POSITIONS,
        """SELECT any_value(reading_count) AS reading_count,
          max(collected_at) AS newest_collected_at,
          string_agg(DISTINCT name || ' ' || sensor_type, ',' ORDER BY name || ' ' || sensor_type)
            AS sensors
        FROM gp JOIN fp USING (announcement) GROUP BY announcement""",
    ),
    # change signals
    "decoded_changes": _with(
        CHANGES,
        """SELECT event_id, published_at, reading_count, collected_at AS newest_collected_at,
        sensor_count FROM c""",
    ),
    "changes_since": _with(
        CHANGES,
        "SELECT event_id, published_at FROM c WHERE published_at >= '2024-01-30 23:40:00'",
    ),
    "refresh_signals": _with(CHANGES, BURSTS),
    # A stream reports the bursts that ended ten seconds before its newest event.
    "refresh_stream": _with(CHANGES, BURSTS),
    "running_view": _with(
        CHANGES,
        """SELECT count(*) AS events_seen, max(published_at) AS published_at,
        arg_max(reading_count, published_at) AS reading_count,
        arg_max(CASE WHEN sensor_count = 0 THEN '' ELSE name || ' ' || sensor_type END,
          published_at) AS sensors FROM c""",
    ),
    "arrivals": _with(
        CHANGES,
        f""", z AS (SELECT *, {_secs("published_at", "2024-01-31 00:00:00")} AS secs FROM c
          ORDER BY published_at DESC LIMIT 1)
        SELECT 0 AS position, upper(name) AS location,
          CASE sensor_type WHEN 'air_quality' THEN 'AIR QUALITY' WHEN 'motion' THEN 'MOTION'
            ELSE 'ENERGY' END AS type, {AGE} AS age FROM z WHERE sensor_count = 1""",
    ),
    # dashboard
    "threshold_breaches": _with(
        READINGS + BREACHES, 'SELECT id, position, label, "limit" FROM bp'
    ),
    "breach_flags": _with(
        READINGS,
        """SELECT id, coalesce(co2 > 1000, false) AS co2_breached,
        coalesce(pm25 > 15, false) AS pm25_breached,
        coalesce(humidity < 30 OR humidity > 60, false) AS humidity_breached FROM r""",
    ),
    "band_verdicts": _with(
        READINGS + BREACHES,
        """SELECT r.id, CASE WHEN r.sensor_type <> 'air_quality' THEN NULL
          WHEN bp.id IS NULL THEN 'NORMAL'
          ELSE label || ' ' || "limit" || CASE WHEN n > 1 THEN ' +' || (n - 1) ELSE '' END END
          AS verdict FROM r LEFT JOIN bp ON bp.id = r.id AND bp.position = 0""",
    ),
    "feed_states": _with(
        READINGS,
        f""", z AS (SELECT id, {_state("collected_at", "2024-01-16 00:00:00")} AS state,
          {_secs("collected_at", "2024-01-16 00:00:00")} AS secs FROM r)
        SELECT id, state, {AGE} AS age FROM z""",
    ),
    "chart_limits": _with(
        READINGS,
        """, z AS (
          SELECT 'co2' AS metric, 'ppm' AS unit, 1000.0::DOUBLE AS threshold,
            CAST(co2 AS DOUBLE) AS value FROM r
          UNION ALL SELECT 'pm25', 'ug/m3', 15.0, pm25 FROM r
          UNION ALL SELECT 'humidity', '%', 60.0, humidity FROM r
          UNION ALL SELECT 'motion_detected', 'fraction', NULL, CAST(motion_detected AS INTEGER)
            FROM r
          UNION ALL SELECT 'energy_kwh', 'kWh', NULL, energy_kwh FROM r)
        SELECT metric, unit, threshold, count(*) AS samples,
          count(*) FILTER (WHERE value > threshold) AS above
        FROM z WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    "location_status": _with(
        STATUS,
        f"""SELECT o.location, a.co2, a.state AS air_state, mo.motion_detected AS detected,
        mo.state AS motion_state, en.energy_kwh AS kwh, en.collected_at AS energy_at, o.worst,
        o.oldest AS oldest_collected_at, o.types {JOINED}""",
    ),
    "latest_values": _with(
        STATUS,
        f"""SELECT o.location, upper(o.location) AS title, o.types,
        CASE WHEN a.state <> 'lost' THEN a.co2 END AS co2,
        CASE WHEN a.state <> 'lost' THEN a.pm25 END AS pm25,
        CASE WHEN a.state <> 'lost' THEN a.humidity END AS humidity,
        coalesce(a.state <> 'lost' AND a.co2 > 1000, false) AS co2_breached,
        coalesce(a.state <> 'lost' AND a.pm25 > 15, false) AS pm25_breached,
        coalesce(a.state <> 'lost' AND (a.humidity < 30 OR a.humidity > 60), false)
          AS humidity_breached,
        CASE WHEN mo.state <> 'lost' THEN CASE WHEN mo.motion_detected THEN 'YES' ELSE 'NO' END END
          AS motion,
        CASE WHEN en.state <> 'lost' THEN en.energy_kwh END AS kwh, o.worst AS feed, {AGE} AS age,
        CASE WHEN a.state <> 'lost' THEN CASE WHEN bp.id IS NULL THEN 'NORMAL' ELSE label || ' '
          || "limit" || CASE WHEN n > 1 THEN ' +' || (n - 1) ELSE '' END END END AS verdict
        {JOINED} LEFT JOIN bp ON bp.id = a.id AND bp.position = 0
        WHERE lower(o.location) LIKE '%loc-1%'""",
    ),
    "type_summary": _with(
        STATUS,
        """SELECT round(avg(co2) FILTER (WHERE state <> 'lost'), 6) AS avg_co2,
        count(*) FILTER (WHERE sensor_type = 'air_quality' AND state <> 'lost') AS air_reporting,
        round(avg(CASE WHEN motion_detected THEN 1.0 ELSE 0.0 END)
          FILTER (WHERE sensor_type = 'motion' AND state <> 'lost'), 6) AS motion_fraction,
        count(*) FILTER (WHERE sensor_type = 'motion' AND state <> 'lost') AS motion_reporting,
        round(avg(energy_kwh) FILTER (WHERE state <> 'lost'), 6) AS avg_kwh,
        count(*) FILTER (WHERE sensor_type = 'energy' AND state <> 'lost') AS energy_reporting,
        (SELECT count(*) FROM o WHERE worst = 'lost') AS lost_locations FROM l""",
    ),
    "lost_locations": _with(
        STATUS, f"SELECT location, {AGE} AS silent_for FROM o WHERE worst = 'lost'"
    ),
    # recorded metrics
    "counter_rates": _with(
        METRICS,
        """SELECT name, range_end, round(sum(value) / 300, 6) AS rate FROM w
        WHERE event_type IN ('view', 'click') GROUP BY 1, 2""",
    ),
    "dead_letter_rates": _with(
        METRICS,
        """SELECT name, reason, range_end, round(sum(value) / 300, 6) AS rate FROM w
        WHERE event_type = 'error' GROUP BY 1, 2, 3""",
    ),
    "poll_rates": _with(
        METRICS,
        """SELECT name, outcome, range_end, round(sum(value) / 300, 6) AS rate FROM w
        WHERE event_type = 'signup' GROUP BY 1, 2, 3""",
    ),
    "duration_p95": _histogram(HISTOGRAM_BOUNDS),
    "duration_p95_sketch": _with(
        METRICS,
        """SELECT name, range_end, count(*) AS n, true AS close FROM w
        WHERE event_type = 'purchase' GROUP BY 1, 2""",
    ),
    "instrument_rates": _with(
        INSTRUMENTS,
        """SELECT name, range_end, round(sum(value) / 300, 6) AS rate FROM w
        WHERE event_type <> 'purchase' GROUP BY 1, 2""",
    ),
    "instrument_p95": _histogram(HISTOGRAM_BOUNDS, INSTRUMENTS),
}

# The stored table answers as the readings it was written from.
ORACLES |= {
    "stored_latest": ORACLES["latest_per_sensor"],
    "kept_latest": ORACLES["latest_per_sensor"],
    "stored_latest_until": _with(
        READINGS,
        f"""SELECT {FLAT} FROM r WHERE sensor_type = 'air_quality'
        AND collected_at < '2024-01-24 17:45:00' QUALIFY row_number() OVER (
        PARTITION BY sensor_id ORDER BY collected_at DESC, id DESC) = 1""",
    ),
    "stored_page": ORACLES["readings_page"],
    "stored_after_upkeep": ORACLES["flat_readings"],
    "live_signals": ORACLES["refresh_signals"],
    "relayed_changes": ORACLES["changes_since"],
    "live_view": ORACLES["running_view"],
    "stored_page_deep": _with(
        READINGS,
        f"""SELECT {FLAT} FROM r WHERE sensor_type = 'air_quality'
        ORDER BY collected_at DESC, id DESC LIMIT 200 OFFSET 3600""",
    ),
    "stored_connection": ORACLES["connection_forward"],
    "stored_hourly_energy": ORACLES["hourly_energy"],
}
