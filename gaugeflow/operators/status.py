"""One row per location: its slots, their age, and what they add up to."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.functions import instants, thresholds

# Slot column of each sensor type and the fields it carries: (field, reading column).
SLOTS = {
    "air_quality": (
        vocab.AIR_QUALITY,
        [("co2", "co2"), ("pm25", "pm25"), ("humidity", "humidity")],
    ),
    "motion": (vocab.MOTION, [("detected", "motion_detected")]),
    "energy": (vocab.ENERGY, [("kwh", "energy_kwh")]),
}


def location_rows(latest: DataFrame, now: datetime) -> DataFrame:
    """Pivot latest readings to one row per location.

    Each sensor type has a nullable slot with its values, its own instant and feed state.
    ``worst`` is the worst state over the location's sensors and ``oldest_collected_at``
    their oldest instant. The group holds one row per type, so plain maxima pick it and the
    buffers stay fixed-width.
    """
    picks, slots = [], []
    for slot, (kind, fields) in SLOTS.items():
        here = F.col("sensor_type") == kind
        at = F.col(f"_{slot}_at")
        picks.append(F.max(F.when(here, F.col("collected_at"))).alias(f"_{slot}_at"))
        picks.extend(
            F.max(F.when(here, F.col(column))).alias(f"_{slot}_{field}")
            for field, column in fields
        )
        slots.append(
            F.when(
                at.isNotNull(),
                F.struct(
                    *[F.col(f"_{slot}_{field}").alias(field) for field, _ in fields],
                    at.alias("collected_at"),
                    instants.feed_state(at, now).alias("state"),
                ),
            ).alias(slot)
        )
    oldest = F.col("oldest_collected_at")
    return (
        latest.groupBy(F.col("sensor_name").alias("location"))
        .agg(*picks, F.min("collected_at").alias("oldest_collected_at"))
        # Age decides the state, so the worst state is the state of the oldest instant.
        .select("location", *slots, instants.feed_state(oldest, now).alias("worst"), oldest)
    )


def reporting(slot: str) -> Column:
    """A slot while its sensor is not lost; stale values are kept."""
    return F.when(F.col(f"{slot}.state") != "lost", F.col(slot))


def types_present(rows: DataFrame) -> Column:
    """Types a location has, in fixed order, joined by `` + ``."""
    return F.concat_ws(
        " + ",
        *[
            F.when(F.col(slot).isNotNull(), vocab.TYPE_BADGES[kind])
            for slot, (kind, _) in SLOTS.items()
        ],
    )


def latest_values(rows: DataFrame, now: datetime) -> DataFrame:
    """Location rows as the latest-values table shows them.

    Values of lost sensors are withheld, each air value says whether it is out of band, and
    ``verdict`` is NULL without air values, NORMAL, or the first breach and how many more.
    """
    shown = rows.select(
        "location",
        types_present(rows).alias("types"),
        *[reporting(slot).alias(slot) for slot in SLOTS],
        F.col("worst").alias("feed"),
        instants.age_label(F.col("oldest_collected_at"), now).alias("age"),
    )
    air = {f: F.col(f"air_quality.{f}") for f in ("co2", "pm25", "humidity")}
    shown = shown.withColumn("breaches", thresholds.breaches(*air.values()))
    return shown.select(
        F.col("location"),
        F.upper("location").alias("title"),
        "types",
        *[value.alias(name) for name, value in air.items()],
        *[thresholds.is_breached(name, v).alias(f"{name}_breached") for name, v in air.items()],
        F.when(
            F.col("motion").isNotNull(),
            F.when(F.coalesce("motion.detected", F.lit(False)), "YES").otherwise("NO"),
        ).alias("motion"),
        F.col("energy.kwh").alias("kwh"),
        "feed",
        "age",
        thresholds.verdict(F.col("air_quality").isNotNull(), F.col("breaches")).alias("verdict"),
    )


def type_summary(rows: DataFrame) -> DataFrame:
    """One row: what each sensor type reads now, lost sensors left out.

    A mean over nothing is NULL. An undetected or missing motion value counts as none.
    """
    kept = rows.select(*[reporting(slot).alias(slot) for slot in SLOTS], "worst")
    moved = F.when(F.coalesce("motion.detected", F.lit(False)), 1.0).otherwise(0.0)
    return kept.agg(
        F.avg("air_quality.co2").alias("avg_co2"),
        F.count("air_quality").alias("air_reporting"),
        F.avg(F.when(F.col("motion").isNotNull(), moved)).alias("motion_fraction"),
        F.count("motion").alias("motion_reporting"),
        F.avg("energy.kwh").alias("avg_kwh"),
        F.count("energy").alias("energy_reporting"),
        F.count_if(F.col("worst") == "lost").alias("lost_locations"),
    )


def lost_locations(rows: DataFrame, now: datetime) -> DataFrame:
    """Locations whose worst feed is lost, with the time since their oldest reading."""
    return rows.filter(F.col("worst") == "lost").select(
        "location", instants.age_label(F.col("oldest_collected_at"), now).alias("silent_for")
    )
