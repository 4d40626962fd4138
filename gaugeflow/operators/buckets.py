"""Calendar buckets of one metric per location, and the series built from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.functions import instants, labels, thresholds
from gaugeflow.operators.readings import ReadingFilter, between, filter_readings

POINT_FIELDS = ["period_start", "count", "average", "minimum", "maximum"]


def metric_value(metric: str) -> Column:
    """The metric as a double; motion counts 1 and 0, so that its mean is a rate."""
    column = vocab.metric(metric).column
    if column == "motion_detected":
        return F.when(F.col(column), 1.0).otherwise(0.0)
    return F.col(column).cast("double")


def metric_samples(readings: DataFrame, metric: str) -> DataFrame:
    """One metric as (sensor_id, collected_at, value); implies the sensor type."""
    return readings.filter(F.col("sensor_type") == vocab.metric(metric).sensor_type).select(
        "sensor_id", "collected_at", metric_value(metric).alias("value")
    )


def all_samples(readings: DataFrame) -> DataFrame:
    """Every metric at once as (sensor_id, collected_at, metric, unit, value)."""
    each = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.lit(m.unit).alias("unit"),
                F.when(F.col("sensor_type") == m.sensor_type, metric_value(name)).alias("value"),
            )
            for name, m in vocab.METRICS.items()
        ]
    )
    return readings.select("sensor_id", "collected_at", F.inline(each)).filter(
        F.col("value").isNotNull()
    )


def aggregate_periods(
    readings: DataFrame,
    sensors: DataFrame,
    metric: str,
    interval: str,
    start: datetime | None = None,
    end: datetime | None = None,
    location: str | None = None,
) -> DataFrame:
    """Count, mean, minimum and maximum per calendar bucket and location.

    The facts are reduced before they meet the catalogue: grouped by the integer sensor id
    with map-side partial aggregates, so one busy sensor costs no more than a quiet one.
    The metric fixes the type, and the catalogue is unique on name and type, so a sensor is
    a location here and the groups need no second pass. Buckets without readings do not
    appear. Unordered; see ``by_period`` and ``by_location``.
    """
    where = ReadingFilter.of(location=location)
    kind = vocab.metric(metric).sensor_type
    kept = filter_readings(between(readings, start, end), sensors, where)
    reduced = (
        metric_samples(kept, metric)
        .groupBy(
            "sensor_id",
            instants.period_start(F.col("collected_at"), vocab.interval(interval)).alias(
                "period_start"
            ),
        )
        .agg(
            F.count("*").alias("count"),
            F.avg("value").alias("average"),
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
        )
    )
    named = sensors.filter(F.col("sensor_type") == kind).select(
        F.col("id").alias("sensor_id"), F.col("name").alias("location")
    )
    return reduced.join(named, "sensor_id").select("location", *POINT_FIELDS)


def by_period(periods: DataFrame) -> DataFrame:
    """Flat answer order: period, then location."""
    return periods.orderBy("period_start", "location")


def by_location(periods: DataFrame) -> DataFrame:
    """Series order: location, then period."""
    return periods.orderBy("location", "period_start")


def aggregate_series(periods: DataFrame, metric: str) -> DataFrame:
    """One row per location: unit, and its points oldest first.

    Runs over reduced rows; the range rule bounds the points of a location, so the lists
    stay small.
    """
    return (
        periods.groupBy("location")
        .agg(F.array_sort(F.collect_list(F.struct(*POINT_FIELDS))).alias("points"))
        .select("location", F.lit(vocab.metric(metric).unit).alias("unit"), "points")
    )


def explode_series(series: DataFrame) -> DataFrame:
    """Series as one row per point."""
    return series.select("location", "unit", F.inline("points"))


def period_axis(series: DataFrame) -> DataFrame:
    """Every period that any location reports, once, oldest first."""
    return (
        series.select(F.explode("points.period_start").alias("period_start"))
        .distinct()
        .orderBy("period_start")
    )


def period_count(series: DataFrame) -> DataFrame:
    """Number of distinct periods over all series."""
    return series.select(F.explode("points.period_start").alias("period_start")).agg(
        F.count_distinct("period_start").alias("period_count")
    )


def align_series(series: DataFrame) -> DataFrame:
    """Lay every location on the common period axis; a period it lacks is NULL, never filled.

    The axis has at most the range rule's number of periods and travels as one array value,
    so nothing is joined: a location's missing periods are the axis without its own.
    ``values`` holds (period_start, average) in axis order.
    """
    axis = (
        series.select(F.explode("points.period_start").alias("period_start"))
        .agg(F.collect_set("period_start").alias("axis"))
        .scalar()
    )
    known = F.transform(
        "points", lambda p: F.struct(p["period_start"].alias("period_start"), p["average"].alias("average"))
    )
    absent = F.transform(
        F.array_except(F.col("_axis"), F.col("points.period_start")),
        lambda p: F.struct(p.alias("period_start"), F.lit(None).cast("double").alias("average")),
    )
    return series.withColumn("_axis", axis).select(
        "location", "unit", F.array_sort(F.concat(known, absent)).alias("values")
    )


def explode_aligned(aligned: DataFrame, metric: str) -> DataFrame:
    """Aligned series as rows, with the metric's alert limit beside each value."""
    # The outer form: a filter for empty lists would lay every series out twice.
    return aligned.select(
        "location", "unit", F.inline_outer("values"), thresholds.alert_limit(metric).alias("threshold")
    )


def first_gaps(aligned: DataFrame) -> DataFrame:
    """Per location: index of its first missing period and the last one before it.

    A series without a gap, or one that starts with it, has no ``lost_at``.
    """
    gap = F.array_position(F.transform("values", lambda v: v["average"].isNull()), F.lit(True)) - 1
    return aligned.select(
        "location",
        F.when(gap >= 0, gap).cast("int").alias("gap_index"),
        F.when(gap > 0, F.get(F.col("values.period_start"), (gap - 1).cast("int"))).alias(
            "lost_at"
        ),
    )


def units(metrics: DataFrame) -> DataFrame:
    """Add the unit label to rows that carry a ``metric`` name."""
    return metrics.withColumn("unit", labels.unit_of(F.col("metric")))
