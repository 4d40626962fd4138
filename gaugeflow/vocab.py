"""Fixed values of the data model: spellings, units, limits and message texts."""

from __future__ import annotations

from typing import NamedTuple

# Stored spellings of the sensor types, in enum order.
AIR_QUALITY = "air_quality"
MOTION = "motion"
ENERGY = "energy"
SENSOR_TYPES = (AIR_QUALITY, MOTION, ENERGY)


class Metric(NamedTuple):
    """What one metric reads: its value column, the sensor type it implies, its unit."""

    column: str
    sensor_type: str
    unit: str
    alert_limit: float | None


# Metrics, their units and the limit drawn on their charts.
METRICS = {
    "co2": Metric("co2", AIR_QUALITY, "ppm", 1000.0),
    "pm25": Metric("pm25", AIR_QUALITY, "ug/m3", 15.0),
    "humidity": Metric("humidity", AIR_QUALITY, "%", 60.0),
    "motion_detected": Metric("motion_detected", MOTION, "fraction", None),
    "energy_kwh": Metric("energy_kwh", ENERGY, "kWh", None),
}

# Aggregation intervals, the hours one counts as, the default look-back in days.
INTERVAL_HOURS = {"hour": 1, "day": 24, "week": 168, "month": 672}
DEFAULT_RANGE_DAYS = {"hour": 1, "day": 30, "week": 90, "month": 90}
MAX_RANGE_DAYS = 90
MAX_PERIODS = 2000

# Page sizes.
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 500
DEFAULT_CURSOR_SIZE = 25
MAX_CURSOR_SIZE = 100

# Alert thresholds; a value on the limit is still inside.
CO2_MAX = 1000
PM25_MAX = 15
HUMIDITY_MIN = 30
HUMIDITY_MAX = 60

# Feed ages.
STALE_AFTER_MS = 120_000
LOST_AFTER_MS = 900_000

# Labels shown for types in the arrivals list and on a location's subtitle.
TYPE_LABELS = {AIR_QUALITY: "AIR QUALITY", MOTION: "MOTION", ENERGY: "ENERGY"}
TYPE_BADGES = {AIR_QUALITY: "AIR_QUALITY", MOTION: "MOTION", ENERGY: "ENERGY"}

# Topics and message headers.
READINGS_TOPIC = "meter-readings"
DEAD_LETTER_TOPIC = "meter-readings-dlq"
PERSISTED_TOPIC = "meter-readings-persisted"
MESSAGE_HEADERS = {"content-type": "application/json", "schema-version": "1"}
DLQ_TOPIC = "dlq-original-topic"
DLQ_PARTITION = "dlq-original-partition"
DLQ_OFFSET = "dlq-original-offset"
DLQ_REASON = "dlq-reason"
DLQ_DETAIL = "dlq-detail"
DLQ_TIMESTAMP = "dlq-timestamp"
DLQ_DETAIL_LENGTH = 512
DECODE_FAILED = "decode-failed"
PERSIST_FAILED = "persist-failed"

# Ingest limits.
BATCH_MESSAGES = 500
BATCH_LINGER = "2 seconds"
MAX_ATTEMPTS = 5
BACKOFF_BASE_MS = 500
BACKOFF_MAX_MS = 30_000
NAME_LENGTH = 128

# Poll handling.
POLL_INTERVAL_S = 60.0
RATE_LIMIT_FALLBACK_S = 60.0
CORRUPTED_BODY = "data corrupted"

# Database states worth retrying.
TRANSIENT_SQLSTATES = frozenset(
    (
        "08000", "08001", "08003", "08004", "08006",
        "40001", "40P01",
        "53000", "53100", "53200", "53300",
        "57P01", "57P02", "57P03",
    )
)

# Rejection texts.
BODY_EMPTY = "The message body is empty."
BODY_NOT_JSON = "The message body is not valid JSON."
BODY_NULL = "The message body deserialized to null."
NO_NAME = "The message has no sensor name."
UNKNOWN_TYPE = "Unrecognised sensor type '%s'."
PAYLOAD_KIND = "The payload is %s, expected an object."
AIR_FIELDS = "An air quality payload requires numeric co2, pm25 and humidity fields."
MOTION_FIELD = "A motion payload requires a boolean motionDetected field."
ENERGY_FIELD = "An energy payload requires a numeric energy field."
BATCH_NOT_STORED = "The batch could not be persisted within the configured attempt limit."
RANGE_ORDER = "from must be earlier than to."

# Counters and durations that the jobs record.
MESSAGES_CONSUMED = "ingest.messages_consumed"
BATCHES_PROCESSED = "ingest.batches_processed"
BATCH_RETRIES = "ingest.batch_retries"
DEAD_LETTERED = "ingest.dead_lettered_messages"
EVENTS_PUBLISHED = "ingest.events_published"
READINGS_INSERTED = "ingest.readings_inserted"
DUPLICATES_SKIPPED = "ingest.duplicates_skipped"
BATCH_DURATION = "ingest.batch_duration"
WRITE_DURATION = "ingest.write_duration"
CONSUMER_LAG = "ingest.newest_reading_lag"
MESSAGES_PRODUCED = "produce.messages_produced"
MESSAGES_FAILED = "produce.messages_failed"
READINGS_POLLED = "produce.readings_polled"
POLL_REQUESTS = "produce.poll_requests"
POLL_DURATION = "produce.poll_duration"
EVENTS_CONSUMED = "relay.events_consumed"
EVENT_LAG = "relay.event_lag"
EVENTS_PUSHED = "relay.events_pushed"
EVENTS_SKIPPED = "relay.events_skipped"


def metric(name: str) -> Metric:
    """Look up a metric by name; any letter case."""
    try:
        return METRICS[name.lower()]
    except KeyError:
        raise ValueError(f"Unknown metric {name!r}; expected one of {sorted(METRICS)}.") from None


def interval(name: str) -> str:
    """Check an aggregation interval; any letter case."""
    unit = name.lower()
    if unit not in INTERVAL_HOURS:
        raise ValueError(f"Unknown interval {name!r}; expected one of {list(INTERVAL_HOURS)}.")
    return unit
