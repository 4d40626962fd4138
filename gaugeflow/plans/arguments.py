"""Argument rules of aggregations: default range, limits, whole periods."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

from gaugeflow import vocab
from gaugeflow.functions import instants


def aggregation_range(
    interval: str,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    now: datetime | None = None,
) -> tuple[datetime, datetime]:
    """Resolve and check the range of an aggregation; both bounds always end up set.

    An open end is ``now``, an open start looks back by the interval's default. The range
    may span 90 days and produce about 2,000 periods per location at most.
    """
    interval = vocab.interval(interval)
    end = instants.normalize(end) or instants.normalize(now) or datetime.now(timezone.utc)
    start = instants.normalize(start) or end - timedelta(days=vocab.DEFAULT_RANGE_DAYS[interval])
    if start >= end:
        raise ValueError(vocab.RANGE_ORDER)
    span = end - start
    if span > timedelta(days=vocab.MAX_RANGE_DAYS):
        days = math.floor(span / timedelta(days=1) + 0.5)
        raise ValueError(
            f"The requested range spans {days} days; "
            f"at most {vocab.MAX_RANGE_DAYS} are allowed."
        )
    periods = math.ceil(span / timedelta(hours=vocab.INTERVAL_HOURS[interval]))
    if periods > vocab.MAX_PERIODS:
        raise ValueError(
            f"The requested range would produce about {periods} periods; at most "
            f"{vocab.MAX_PERIODS} are allowed. Widen the interval or narrow the range."
        )
    return start, end


def whole_periods(interval: str, start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """Widen a range to period boundaries, so that its first and last periods are whole."""
    return instants.floor_to_period(start, interval), instants.ceil_to_period(end, interval)
