"""Get-or-create keys of the sensor catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# About so many pairs are numbered in one task, in at most so many groups.
_GROUP, _MOST_GROUPS = 10_000, 1000


def unknown_sensors(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Distinct (name, sensor_type) pairs of the readings that the catalogue lacks."""
    return (
        readings.select("name", "sensor_type")
        .distinct()
        .join(sensors.select("name", "sensor_type"), ["name", "sensor_type"], "left_anti")
    )


def number_sensors(unknown: DataFrame, last_id: int, expected: int) -> DataFrame:
    """Give new pairs consecutive ids after ``last_id``, in the order of name and type.

    ``expected`` is their number. Names are cut into ranges of about 10,000 pairs, at names
    chosen by a hash, and pairs are numbered inside their range, after a running total of the
    sizes of the ranges before it. The ids are the same wherever the cuts fall, and a first
    backfill of millions of sensors is not numbered in one task.
    """
    groups = min(max(1, -(-expected // _GROUP)), _MOST_GROUPS)
    cuts = (
        unknown.select("name").distinct().orderBy(F.xxhash64("name"), "name").limit(groups - 1)
    )
    names = sorted(r["name"] for r in cuts.collect()) if groups > 1 else []
    below = F.filter(F.array(*map(F.lit, names)), lambda cut: cut <= F.col("name"))
    grouped = unknown.withColumn("_group", F.size(below) if names else F.lit(0))
    in_group = Window.partitionBy("_group").orderBy("name", "sensor_type")
    # One row per range.
    sizes = grouped.groupBy("_group").agg(F.count("*").alias("_size"))
    before = sizes.select(
        "_group",
        (F.sum("_size").over(Window.orderBy("_group")) - F.col("_size")).alias("_before"),
    )
    return (
        grouped.withColumn("_rank", F.row_number().over(in_group))
        .join(before, "_group")
        .select(
            (F.lit(last_id) + F.col("_before") + F.col("_rank")).cast("int").alias("id"),
            "name",
            "sensor_type",
        )
    )


def with_sensor_id(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Readings with the id of their sensor; Spark picks broadcast or shuffle by size."""
    ids = sensors.select(F.col("id").alias("sensor_id"), "name", "sensor_type")
    return readings.join(ids, ["name", "sensor_type"])


def find_sensor_id(sensors: DataFrame, name: str, sensor_type: str) -> DataFrame:
    """Id of one sensor: the lowest, should there be several; no row if there is none."""
    return (
        sensors.filter((F.col("name") == name) & (F.col("sensor_type") == sensor_type))
        .select("id")
        .orderBy("id")
        .limit(1)
    )
