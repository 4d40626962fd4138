"""Instants in UTC: normalising, bucketing, ages, wire text.

Column arithmetic runs on microseconds since the epoch, so no result depends on the
session time zone.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeflow import vocab

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_HOUR_US = 3_600_000_000
_DAY_US = 24 * _HOUR_US
# Periods of equal length: how long, and how long before the epoch one began. Weeks start on
# Monday, and the epoch is a Thursday. Months are the other periods there are.
_PERIODS = {"hour": (_HOUR_US, 0), "day": (_DAY_US, 0), "week": (7 * _DAY_US, 3 * _DAY_US)}

# The wire profile of ISO 8601: a date, optionally a time with up to 16 fraction digits,
# optionally an offset of up to 14 hours.
_DATE = r"^(?!0000)\d{4}-\d{2}-\d{2}"
_SECONDS = r":\d{2}(\.\d{1,16})?"
_WIRE_INSTANT = (
    _DATE + r"(T\d{2}:\d{2}(" + _SECONDS + r")?"
    r"(Z|[+-](0\d|1[0-3])(:[0-5]\d)?|[+-]14(:00)?)?)?$"
)
_FULL_INSTANT = (
    _DATE + r"T\d{2}:\d{2}" + _SECONDS + r"(Z|[+-](0\d|1[0-3]):[0-5]\d|[+-]14:00)$"
)


# --- plain values -----------------------------------------------------------------------


def normalize(value: datetime | str | None) -> datetime | None:
    """An argument as a UTC instant; text may carry an offset, none means UTC."""
    if value is None:
        return None
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def micros_of(value: datetime) -> int:
    return (normalize(value) - _EPOCH) // timedelta(microseconds=1)


def floor_to_period(value: datetime, interval: str) -> datetime:
    """Start of the period that contains the instant, as ``period_start`` has it."""
    micros = micros_of(value)
    if interval in _PERIODS:
        width, lead = _PERIODS[interval]
        return _EPOCH + timedelta(microseconds=micros - (micros + lead) % width)
    day_of_month = timedelta(microseconds=micros % _DAY_US) + timedelta(days=normalize(value).day - 1)
    return normalize(value) - day_of_month


def ceil_to_period(value: datetime, interval: str) -> datetime:
    """The instant itself if a period starts there, else the start of the next period."""
    start = floor_to_period(value, interval)
    if start == normalize(value):
        return start
    # A month and a day from its start lie in the next one.
    width = _PERIODS[interval][0] if interval in _PERIODS else 32 * _DAY_US
    return floor_to_period(start + timedelta(microseconds=width), interval)


# --- columns ----------------------------------------------------------------------------


def instant(value: datetime | str) -> Column:
    """A literal instant; folds to a constant, so it can be pushed into scans."""
    return F.timestamp_micros(F.lit(micros_of(normalize(value))).cast("bigint"))


def day(value: date, shift: int = 0) -> Column:
    """A literal day, ``shift`` days on, of any year; folds, so it can prune partitions."""
    return F.date_from_unix_date(F.lit((value - _EPOCH.date()).days + shift))


def utc_day(at: Column) -> Column:
    """The UTC calendar day of an instant, the partition key of stored readings."""
    return F.date_from_unix_date(floor_div(F.unix_micros(at), _DAY_US).cast("int"))


def utc_wall(at: Column) -> Column:
    """An instant as a zone-less UTC wall-clock value."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(at), F.expr("TIMESTAMP_NTZ'1970-01-01'"))


def period_start(at: Column, interval: str) -> Column:
    """Calendar bucket of an instant: hour, day, ISO week or month, always in UTC."""
    if interval not in _PERIODS:
        return _day_start(F.trunc(utc_day(at), "MM"))
    width, lead = _PERIODS[interval]
    micros = F.unix_micros(at)
    return F.timestamp_micros(micros - F.pmod(micros + F.lit(lead), F.lit(width)))


def age_ms(at: Column, now: datetime) -> Column:
    """Whole milliseconds from an instant to a given now; negative for future instants."""
    return F.lit(micros_of(now) // 1000).cast("bigint") - floor_div(F.unix_micros(at), 1000)


def feed_state(at: Column, now: datetime) -> Column:
    """live under two minutes, stale under fifteen, lost from there on."""
    age = age_ms(at, now)
    return (
        F.when(at.isNull(), F.lit(None).cast("string"))
        .when(age >= vocab.LOST_AFTER_MS, "lost")
        .when(age >= vocab.STALE_AFTER_MS, "stale")
        .otherwise("live")
    )


def age_label(at: Column, now: datetime) -> Column:
    """Age as ``42s``, ``7m`` or ``1h05``; never negative."""
    seconds = F.greatest(F.lit(0).cast("bigint"), floor_div(age_ms(at, now) + 500, 1000))
    minutes = floor_div(seconds, 60)
    return F.when(
        at.isNotNull(),
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .otherwise(
            F.concat(
                floor_div(minutes, 60).cast("string"),
                F.lit("h"),
                F.lpad(F.pmod(minutes, F.lit(60)).cast("string"), 2, "0"),
            )
        ),
    )


def wire_instant(at: Column) -> Column:
    """An instant as messages spell it: no trailing fraction zeros, offset ``+00:00``."""
    wall = utc_wall(at)
    fraction = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    digits = F.rtrim(F.lpad(fraction.cast("string"), 6, "0"), F.lit("0"))
    return F.concat(
        F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == 0, "").otherwise(F.concat(F.lit("."), digits)),
        F.lit("+00:00"),
    )


def parse_wire_instant(text: Column) -> Column:
    """Instant of a wire text, cut (not rounded) to microseconds; NULL if it is not one.

    A text without an offset is taken as UTC, whatever the session zone.
    """
    timed = F.regexp_replace(text, r"^(.{10}T\d{2}:\d{2})(?=Z|[+-]|$)", "$1:00")
    completed = (
        F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z")))
        .when(timed.rlike(r"T.*[+-]\d{2}$"), F.concat(timed, F.lit(":00")))
        .when(timed.rlike(r"T.*(Z|[+-]\d{2}:\d{2})$"), timed)
        .otherwise(F.concat(timed, F.lit("Z")))
    )
    # Producers write the full form; only other texts pay for being completed.
    return F.when(text.rlike(_FULL_INSTANT), text.try_cast("timestamp")).when(
        text.rlike(_WIRE_INSTANT), completed.try_cast("timestamp")
    )


def floor_div(value: Column, by: int) -> Column:
    """Integer division that rounds down, also below zero."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by)).cast("bigint")


def _day_start(of: Column) -> Column:
    return F.timestamp_micros(F.unix_date(of).cast("bigint") * F.lit(_DAY_US))
