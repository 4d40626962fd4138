"""Pages of readings, newest first: by number and by cursor."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow import vocab
from gaugeflow.functions import instants

# Pages that end by this row are read with one top-k pass, unless day partitions tell more.
DIRECT_ROWS = 5_000
# Deeper pages are first narrowed to a key range with about this many rows around them.
RANGE_ROWS = 100_000
_RANGES = 4096
_DAY_US = 86_400_000_000
# Days counted first, then on to the next, then to the end.
_STRETCHES = (4, 64)


def newest_first(readings: DataFrame) -> DataFrame:
    """Total order of every listing: instant, then id, both descending."""
    return readings.orderBy(F.col("collected_at").desc(), F.col("id").desc())


def check_page(page: int, size: int, start: datetime | None, end: datetime | None) -> None:
    """Argument rule of numbered pages."""
    if page < 1:
        raise ValueError("page must be 1 or greater.")
    if not 1 <= size <= vocab.MAX_PAGE_SIZE:
        raise ValueError(f"pageSize must be between 1 and {vocab.MAX_PAGE_SIZE}.")
    if start is not None and end is not None and start >= end:
        raise ValueError(vocab.RANGE_ORDER)


def offset_page(
    readings: DataFrame,
    page: int,
    size: int,
    direct_rows: int = DIRECT_ROWS,
    range_rows: int = RANGE_ROWS,
    days: list[date] | None = None,
) -> DataFrame:
    """The rows of one numbered page.

    A top-k pass hands ``page * size`` rows per task to a single one, which is fine near the
    front of a small table. Otherwise the page's first and last row are located by counting:
    stored readings by day partition, which reads no column, then by ever finer ranges of
    instants and ids. What is left to sort is the page and at most about ``range_rows`` rows
    on either side of it, wherever it lies and however many rows share an instant. The
    counts come back as a few thousand numbers per round; the page holds the same rows.

    ``days`` are the stored days that the rows may lie in, where the caller knows them.
    """
    skip = (page - 1) * size
    if "collected_date" in readings.columns or skip + size > direct_rows:
        first = _locate(readings, skip, range_rows, days)
        if first is None:
            return readings.limit(0)
        last = first
        if first.ahead + first.rows < skip + size:
            last = _locate(readings, skip + size - 1, range_rows, days)
        readings = readings.filter(first.not_newer())
        if last is not None:
            readings = readings.filter(last.not_older())
        readings = _cut_days(readings, first.at_high, last.at_low if last else None)
        skip -= first.ahead
    return newest_first(readings).offset(skip).limit(size)


def page_summary(readings: DataFrame, page: int, size: int) -> DataFrame:
    """One row: page, page_size, total_count, total_pages, has_more."""
    total = readings.agg(F.count("*").alias("total_count"))
    return summarize_total(total, page, size)


def summarize_total(total: DataFrame, page: int, size: int) -> DataFrame:
    """Page arithmetic over a ``total_count`` column; no pages at size zero."""
    pages = F.ceil(F.col("total_count") / F.lit(size)) if size else F.lit(0)
    return total.select(
        F.lit(page).alias("page"),
        F.lit(size).alias("page_size"),
        F.col("total_count"),
        pages.cast("int").alias("total_pages"),
        (F.lit(page) < pages).alias("has_more"),
    )


@dataclass(frozen=True)
class Connection:
    """One cursor page: its edges, newest first, one row of page information, and the number
    of readings that the filter admits, whatever the cursor."""

    edges: DataFrame
    page_info: DataFrame
    total_count: DataFrame


def cursor_of(collected_at: Column, id_: Column) -> Column:
    """Opaque cursor of a row: its ordering key."""
    return F.base64(
        F.concat_ws(":", F.unix_micros(collected_at).cast("string"), id_.cast("string")).cast(
            "binary"
        )
    )


def read_cursor(cursor: str) -> tuple[int, int]:
    """Ordering key (microseconds, id) behind a cursor."""
    try:
        micros, id_ = base64.b64decode(cursor, validate=True).decode().split(":")
        return int(micros), int(id_)
    except ValueError:
        raise ValueError("The cursor is not valid.") from None


def keyset_page(
    readings: DataFrame,
    first: int | None = None,
    after: str | None = None,
    last: int | None = None,
    before: str | None = None,
    days: list[date] | None = None,
) -> Connection:
    """One page by cursor, forward with first/after or backward with last/before.

    The bound is a predicate on the ordering key, so it reaches the scan, and a page takes
    one top-k pass of at most 101 rows per task; stored readings are first cut to the day
    partitions nearest to the cursor that hold a page, or to the first stored day without a
    cursor; ``days`` are the stored days, where the caller knows them. Rows appended meanwhile
    never shift a page.
    """
    if first is not None and last is not None:
        raise ValueError("first and last cannot be used together.")
    size = first if first is not None else last
    size = vocab.DEFAULT_CURSOR_SIZE if size is None else size
    if size < 0:
        raise ValueError("A page cannot have a negative number of items.")
    if size > vocab.MAX_CURSOR_SIZE:
        raise ValueError(f"The maximum allowed items per page is {vocab.MAX_CURSOR_SIZE}.")
    backward = last is not None

    rows = readings
    if after is not None:
        micros, id_ = read_cursor(after)
        rows = _cut_days(rows, micros, None).filter(_beyond(micros, id_, older=True))
    if before is not None:
        micros, id_ = read_cursor(before)
        rows = _cut_days(rows, None, micros).filter(_beyond(micros, id_, older=False))

    if "collected_date" in rows.columns:
        cursor = before if backward else after
        if days is not None and cursor is not None:
            edge = _day_of(read_cursor(cursor)[0])
            days = [d for d in days if (d >= edge if backward else d <= edge)]
        rows = _nearest_days(rows, size + 1, not backward, days)

    key = [F.col("collected_at"), F.col("id")]
    towards = [k.asc() if backward else k.desc() for k in key]
    # At most 101 rows from here on, so one task may rank them.
    window = Window.orderBy(*towards)
    fetched = (
        rows.orderBy(*towards)
        .limit(size + 1)
        .withColumn("_rank", F.row_number().over(window))
        .withColumn("cursor", cursor_of(*key))
    )
    on_page = F.col("_rank") <= size
    edges = newest_first(fetched.filter(on_page).drop("_rank"))
    surplus = F.coalesce(F.max("_rank") > size, F.lit(False))
    # Ranks start at the side the page is entered from: the newest row going forward.
    rank = F.when(on_page, F.col("_rank"))
    newest, oldest = (F.max_by, F.min_by) if backward else (F.min_by, F.max_by)
    page_info = fetched.agg(
        (F.lit(before is not None) if backward else surplus).alias("has_next_page"),
        (surplus if backward else F.lit(after is not None)).alias("has_previous_page"),
        newest("cursor", rank).alias("start_cursor"),
        oldest("cursor", rank).alias("end_cursor"),
    )
    return Connection(edges, page_info, readings.agg(F.count("*").alias("total_count")))


def _at(micros: int) -> Column:
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def _beyond(micros: int, id_: int, older: bool) -> Column:
    """Rows strictly past a key in listing order (older) or strictly ahead of it."""
    time, row = F.col("collected_at"), F.col("id")
    if older:
        return (time <= _at(micros)) & ((time < _at(micros)) | (row < id_))
    return (time >= _at(micros)) & ((time > _at(micros)) | (row > id_))


def _cut_days(rows: DataFrame, newest: int | None, oldest: int | None) -> DataFrame:
    """Stored readings: leave out the day partitions beyond the given instants."""
    if "collected_date" not in rows.columns:
        return rows
    if newest is not None:
        rows = rows.filter(F.col("collected_date") <= F.to_date(instants.utc_day(_at(newest))))
    if oldest is not None:
        rows = rows.filter(F.col("collected_date") >= F.to_date(instants.utc_day(_at(oldest))))
    return rows


def _day_of(micros: int) -> date:
    return date(1970, 1, 1) + timedelta(days=micros // _DAY_US)


def _nearest_days(
    rows: DataFrame, needed: int, newest: bool, days: list[date] | None
) -> DataFrame:
    """Stored readings: the days, from the newest or the oldest on, that hold enough rows."""
    found = 0
    for day, count in _day_counts(rows, newest, days):
        found += count
        if found >= needed:
            edge = F.col("collected_date")
            return rows.filter(edge >= instants.day(day) if newest else edge <= instants.day(day))
    return rows


def _day_counts(
    rows: DataFrame, newest: bool, days: list[date] | None
) -> Iterator[tuple[date, int]]:
    """Rows per day partition in paging direction, counted as far as the caller asks.

    Days that exist are counted in growing stretches from the first one on, so a page near
    the front of a long table leaves the rest of it alone.
    """
    day = F.col("collected_date")
    if days is None:
        days = [r[0] for r in rows.select(day).distinct().collect()]
    ordered = sorted(days, reverse=newest)
    edges = [0, *_STRETCHES, len(ordered)]
    for begin, end in zip(edges, edges[1:]):
        part = ordered[begin:end]
        if part:
            low, high = min(part), max(part)
            stretch = rows.filter(day.between(instants.day(low), instants.day(high)))
            order = day.desc() if newest else day.asc()
            counted = stretch.groupBy(day).agg(F.count("*")).orderBy(order)
            yield from (tuple(r) for r in counted.collect())


@dataclass(frozen=True)
class _Span:
    """A range of ordering keys: how many rows it holds and how many lie ahead of it."""

    at_low: int
    at_high: int
    ahead: int
    rows: int
    id_low: int | None = None
    id_high: int | None = None

    def not_newer(self) -> Column:
        time, high = F.col("collected_at"), _at(self.at_high)
        if self.id_high is None:
            return time <= high
        return (time <= high) & ((time < high) | (F.col("id") <= self.id_high))

    def not_older(self) -> Column:
        time, low = F.col("collected_at"), _at(self.at_low)
        if self.id_low is None:
            return time >= low
        return (time >= low) & ((time > low) | (F.col("id") >= self.id_low))


def _locate(
    readings: DataFrame, rank: int, range_rows: int, days: list[date] | None
) -> _Span | None:
    """The key range that holds the row at ``rank``; None if there are fewer rows.

    Narrows until the range holds at most ``range_rows`` rows: by day where the table is
    partitioned by day, then by instant, and inside a single instant by id.
    """
    ahead, within = 0, readings
    if "collected_date" in readings.columns:
        for day, rows in _day_counts(readings, True, days):
            if rank < ahead + rows:
                break
            ahead += rows
        else:
            return None
        low = instants.micros_of(datetime.combine(day, datetime.min.time()))
        high = low + _DAY_US - 1
        within = readings.filter(F.col("collected_date") == instants.day(day))
    else:
        low, high, rows = within.agg(
            F.min(F.unix_micros("collected_at")),
            F.max(F.unix_micros("collected_at")),
            F.count("*"),
        ).first()
        if rank >= rows:
            return None

    while rows > range_rows and low < high:
        low, high, passed, rows = _enter(
            within, F.unix_micros("collected_at"), low, high, rank - ahead
        )
        ahead += passed
        within = within.filter(F.col("collected_at").between(_at(low), _at(high)))
    span = _Span(low, high, ahead, rows)
    if rows <= range_rows:
        return span

    low, high = within.agg(F.min("id"), F.max("id")).first()
    while rows > range_rows and low < high:
        low, high, passed, rows = _enter(within, F.col("id"), low, high, rank - ahead)
        ahead += passed
        within = within.filter(F.col("id").between(low, high))
    return replace(span, ahead=ahead, rows=rows, id_low=low, id_high=high)


def _enter(
    rows: DataFrame, key: Column, low: int, high: int, rank: int
) -> tuple[int, int, int, int]:
    """Out of up to 4096 equal key ranges the one that holds the row at ``rank``.

    Returns its bounds, the number of rows in the ranges ahead of it, and in itself.
    """
    width = -(-(high - low + 1) // _RANGES)
    counts = (
        rows.groupBy(F.call_function("div", F.lit(high) - key, F.lit(width)).alias("range"))
        .agg(F.count("*").alias("rows"))
        .orderBy("range")
        .collect()
    )
    ahead = 0
    for position, held in counts:
        if rank < ahead + held:
            top = high - position * width
            return max(low, top - width + 1), top, ahead, held
        ahead += held
    raise RuntimeError("The rows changed while a page was located; read the page again.")
