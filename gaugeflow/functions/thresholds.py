"""Air-quality limits: which are broken, and the verdict for a location."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeflow import vocab


def breaches(co2: Column, pm25: Column, humidity: Column) -> Column:
    """Broken limits in display order; a missing value breaks none."""

    def broken(when: Column, label: str, limit: str) -> Column:
        return F.when(when, F.struct(F.lit(label).alias("label"), F.lit(limit).alias("limit")))

    candidates = F.array(
        broken(co2 > vocab.CO2_MAX, "CO2 HIGH", f">{vocab.CO2_MAX}"),
        broken(pm25 > vocab.PM25_MAX, "PM2.5 HIGH", f">{vocab.PM25_MAX}"),
        broken(humidity < vocab.HUMIDITY_MIN, "RH LOW", f"<{vocab.HUMIDITY_MIN}"),
        broken(humidity > vocab.HUMIDITY_MAX, "RH HIGH", f">{vocab.HUMIDITY_MAX}"),
    )
    return F.filter(candidates, lambda b: b.isNotNull())


def is_breached(metric: str, value: Column) -> Column:
    """Whether one value lies outside its metric's limits; false for a missing value."""
    outside = {
        "co2": value > vocab.CO2_MAX,
        "pm25": value > vocab.PM25_MAX,
        "humidity": (value < vocab.HUMIDITY_MIN) | (value > vocab.HUMIDITY_MAX),
    }[metric]
    return F.coalesce(outside, F.lit(False))


def verdict(has_air: Column, broken: Column) -> Column:
    """NULL without an air-quality slot, NORMAL without breaches, else the first and a count."""
    first = F.get(broken, F.lit(0))
    more = F.size(broken) - 1
    return F.when(
        has_air,
        F.when(F.size(broken) == 0, "NORMAL").otherwise(
            F.concat_ws(
                " ",
                first["label"],
                first["limit"],
                F.when(more > 0, F.concat(F.lit("+"), more.cast("string"))),
            )
        ),
    )


def alert_limit(metric: str) -> Column:
    """The limit drawn on a metric's chart; NULL for metrics without one."""
    return F.lit(vocab.metric(metric).alert_limit).cast("double")
