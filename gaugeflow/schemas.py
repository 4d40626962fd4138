"""Explicit schemas of every table and message; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

POLL_RESPONSES = T.StructType(
    [
        T.StructField("status", T.IntegerType()),
        T.StructField("retry_after_s", T.DoubleType()),
        T.StructField("body", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

HEADERS = T.ArrayType(
    T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]
    )
)

# The columns of Spark's Kafka source that the jobs use; file feeds carry the same ones.
MESSAGES = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", HEADERS),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

SENSORS = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("sensor_type", T.StringType(), False),
    ]
)

READING_VALUES = [
    T.StructField("co2", T.IntegerType()),
    T.StructField("pm25", T.IntegerType()),
    T.StructField("humidity", T.IntegerType()),
    T.StructField("energy_kwh", T.DoubleType()),
    T.StructField("motion_detected", T.BooleanType()),
]

# One wide table for all three kinds: `sensor_type` says which value columns apply.
# Stored partitioned by `collected_date`, the UTC day of `collected_at`.
METER_READINGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("sensor_id", T.IntegerType(), False),
        T.StructField("collected_at", T.TimestampType(), False),
        T.StructField("sensor_type", T.StringType(), False),
        *READING_VALUES,
    ]
)

STORED_READINGS = T.StructType(
    [
        *METER_READINGS.fields,
        T.StructField("ingest_batch", T.StringType()),
        T.StructField("collected_date", T.DateType()),
    ]
)

VALUE_COLUMNS = [field.name for field in READING_VALUES]
READING_COLUMNS = [field.name for field in METER_READINGS.fields]

CHANGED_SENSORS = T.ArrayType(
    T.StructType(
        [
            T.StructField("location", T.StringType()),
            T.StructField("sensorType", T.StringType()),
        ]
    )
)

PIPELINE_METRICS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("name", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("value", T.DoubleType()),
    ]
)

REFRESH_SIGNALS = T.StructType(
    [
        T.StructField("first_event_at", T.TimestampType()),
        T.StructField("refresh_at", T.TimestampType()),
        T.StructField("events", T.LongType()),
        T.StructField("readings", T.LongType()),
    ]
)
