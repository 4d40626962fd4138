"""Listing readings: filters, projections and the latest row per sensor."""

from __future__ import annotations

import threading
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.functions import instants, labels
from gaugeflow.schemas import READING_COLUMNS, VALUE_COLUMNS

# Days looked at for sensors that reported lately, then for those that fell silent since.
_LOOK_BACK_DAYS = (2, 16, 128)
# Up to this many silent sensors are sent to every task that scans older days.
_BROADCAST_SENSORS = 200_000

_FOLDER_NAMES = threading.Lock()


@dataclass(frozen=True)
class ReadingFilter:
    """Optional location, sensor type and half-open range of instants; None means any."""

    location: str | None = None
    sensor_type: str | None = None
    start: datetime | None = None
    end: datetime | None = None

    @classmethod
    def of(
        cls,
        location: str | None = None,
        sensor_type: str | None = None,
        start: datetime | str | None = None,
        end: datetime | str | None = None,
    ) -> ReadingFilter:
        """Trim the location, check the type, bring the bounds to UTC."""
        if sensor_type is not None and sensor_type not in vocab.SENSOR_TYPES:
            raise ValueError(f"Unrecognised sensor type '{sensor_type}'.")
        return cls(
            labels.clean_location(location),
            sensor_type,
            instants.normalize(start),
            instants.normalize(end),
        )


def between(
    readings: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Readings collected from ``start`` (included) to ``end`` (excluded).

    Stored readings are also cut by their partition day, so other days are never listed.
    """
    if start is not None:
        readings = readings.filter(F.col("collected_at") >= instants.instant(start))
    if end is not None:
        readings = readings.filter(F.col("collected_at") < instants.instant(end))
    return _on_days(readings, start, end) if "collected_date" in readings.columns else readings


def stored_days(readings: DataFrame, where: ReadingFilter | None = None) -> list[date] | None:
    """The stored days that the range of a filter touches, oldest first.

    Taken from the names of the day folders: no file is opened, whatever else the filter asks
    for. None if the readings are not partitioned by day.
    """
    if "collected_date" not in readings.columns:
        return None
    days = readings.select("collected_date")
    if where is not None:
        days = _on_days(days, where.start, where.end)
    conf, name = readings.sparkSession.conf, "spark.sql.optimizer.metadataOnly"
    # The setting is the session's: one thread at a time changes it and puts it back.
    with _FOLDER_NAMES:
        before = conf.get(name, "false")
        conf.set(name, "true")
        try:
            # One row per day.
            return sorted(r[0] for r in days.distinct().collect() if r[0] is not None)
        finally:
            conf.set(name, before)


def _on_days(readings: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    if start is not None:
        readings = readings.filter(F.col("collected_date") >= instants.day(start.date()))
    if end is not None:
        readings = readings.filter(F.col("collected_date") <= instants.day(end.date()))
    return readings


def of_type(readings: DataFrame, sensor_type: str) -> DataFrame:
    """The readings of one kind, with only the value columns that kind has."""
    applies = {m.column for m in vocab.METRICS.values() if m.sensor_type == sensor_type}
    others = [c for c in VALUE_COLUMNS if c not in applies]
    return readings.filter(F.col("sensor_type") == sensor_type).drop(*others)


def filter_readings(readings: DataFrame, sensors: DataFrame, where: ReadingFilter) -> DataFrame:
    """Readings the filter admits, still without sensor columns.

    A location owns at most one sensor per type - the catalogue is unique on name and type -
    so the sensors of one location are a handful of rows and always fit a broadcast.
    """
    readings = between(readings, where.start, where.end)
    if where.sensor_type is not None:
        readings = readings.filter(F.col("sensor_type") == where.sensor_type)
    if where.location is not None:
        here = admitted_sensors(sensors, where).select(F.col("id").alias("sensor_id"))
        readings = readings.join(F.broadcast(here), "sensor_id", "left_semi")
    return readings


def admitted_sensors(sensors: DataFrame, where: ReadingFilter) -> DataFrame:
    """The sensors that the location and type of a filter admit."""
    if where.location is not None:
        sensors = sensors.filter(F.col("name") == where.location)
    if where.sensor_type is not None:
        sensors = sensors.filter(F.col("sensor_type") == where.sensor_type)
    return sensors


def with_sensor(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Flat projection: each reading with its sensor's name and type.

    No hint: Spark broadcasts the catalogue when its size allows and otherwise shuffles,
    where adaptive execution splits a sensor that owns a large share of the rows.
    """
    named = sensors.select(F.col("id").alias("sensor_id"), F.col("name").alias("sensor_name"))
    return readings.join(named, "sensor_id").select(
        "id", "sensor_name", "sensor_type", "collected_at", *VALUE_COLUMNS
    )


def with_nested_sensor(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Nested projection: each reading with its sensor as a struct of id, name and type."""
    nested = sensors.select(
        F.col("id").alias("sensor_id"),
        F.struct("id", "name", F.col("sensor_type").alias("type")).alias("sensor"),
    )
    return readings.join(nested, "sensor_id").select(
        "id", "sensor", "collected_at", *VALUE_COLUMNS
    )


def latest_per_sensor(
    readings: DataFrame, sensors: DataFrame, where: ReadingFilter | None = None
) -> DataFrame:
    """Newest reading of every admitted sensor; the larger id breaks a tie.

    Location and type choose sensors, the range chooses readings before the newest is taken,
    so a sensor whose newest reading lies outside the range answers with an older one.

    In a stored table most sensors are settled by the newest days there are. Those are read
    for all sensors, and older days only for the sensors that did not report since - or not
    at all, if there are none. Days are counted as they exist, so one reading of a clock far
    ahead costs one day. A sensor's newest reading is in the newest days it has readings in,
    so the answer is the same as over the whole table.
    """
    where = where or ReadingFilter()
    kept = filter_readings(readings, sensors, where)
    days = stored_days(readings, where) if where.location is None else None
    if not days:
        return newest_rows(kept)

    def since(n: int) -> DataFrame:
        return kept.filter(F.col("collected_date") >= instants.day(days[-min(n, len(days))]))

    known = admitted_sensors(sensors, where).select(F.col("id").alias("sensor_id"))

    def silent(days: int) -> tuple[DataFrame, int]:
        reporting = since(days).select("sensor_id").distinct()
        missing = known.join(reporting, "sensor_id", "left_anti")
        return missing, missing.count()

    recent, *wider = _LOOK_BACK_DAYS
    missing, count = silent(recent)
    found = newest_rows(since(recent))
    if count == 0:
        return found
    older = kept
    for reach in wider:
        if silent(reach)[1] == 0:
            older = since(reach)
            break
    if len(days) <= recent:
        return found
    older = older.filter(F.col("collected_date") < instants.day(days[-recent]))
    if count <= _BROADCAST_SENSORS:
        missing = F.broadcast(missing)
    return found.unionByName(newest_rows(older.join(missing, "sensor_id", "left_semi")))


def newest_rows(readings: DataFrame) -> DataFrame:
    """The newest row of every sensor among the given ones.

    Row-number-one windows are cut per map task before the shuffle, so at most one row per
    sensor and task travels, however large a sensor's share is.
    """
    newest_first = Window.partitionBy("sensor_id").orderBy(
        F.col("collected_at").desc(), F.col("id").desc()
    )
    return (
        readings.select(*READING_COLUMNS)
        .withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def order_by_type_name(rows: DataFrame, name: str = "sensor_name") -> DataFrame:
    """Catalogue order: name, then the stored spelling of the type."""
    return rows.orderBy(name, "sensor_type")


def order_by_type_rank(rows: DataFrame, name: str = "sensor_name") -> DataFrame:
    """Latest-list order: name, then the type's place in the enum."""
    return rows.orderBy(F.col(name), labels.type_rank(F.col("sensor_type")))


def distinct_locations(sensors: DataFrame) -> DataFrame:
    """Every location once, ordered."""
    return sensors.select(F.col("name").alias("location")).distinct().orderBy("location")


def count_by_type(readings: DataFrame) -> DataFrame:
    """Number of readings per sensor type."""
    return readings.groupBy("sensor_type").agg(F.count("*").alias("count"))
