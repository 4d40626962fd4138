"""Names shown for types and units, and the text rules of filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeflow import vocab


def is_sensor_type(name: Column) -> Column:
    """Whether a spelling is one of the stored ones: exact case, no numbers."""
    return F.coalesce(name.isin(*vocab.SENSOR_TYPES), F.lit(False))


def type_rank(name: Column) -> Column:
    """Position of a sensor type in enum order."""
    rank = F.lit(None).cast("int")
    for position, known in enumerate(vocab.SENSOR_TYPES, start=1):
        rank = F.when(name == known, position).otherwise(rank)
    return rank


def type_label(name: Column) -> Column:
    """Label of a sensor type in the arrivals list; an unknown type shows as it is."""
    pairs = [F.lit(part) for pair in vocab.TYPE_LABELS.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def unit_of(metric: Column) -> Column:
    """Unit of a metric given by name."""
    pairs = [F.lit(p) for name, m in vocab.METRICS.items() for p in (name, m.unit)]
    return F.try_element_at(F.create_map(*pairs), F.lower(metric))


def matches_search(location: Column, term: str) -> Column:
    """Case-insensitive substring search; a blank term matches everything."""
    wanted = term.strip().lower()
    return F.lower(location).contains(wanted) if wanted else F.lit(True)


def clean_location(location: str | None) -> str | None:
    """A location argument, trimmed; blank means any."""
    return (location or "").strip() or None
