"""Hours, dates and after-hours tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# After-hours bounds per rule set, as (first working hour, last working hour, last hour included).
HOURS = {
    "rules": (6, 22, False),
    "ensemble": (8, 18, True),
    "transaction": (8, 18, False),
    "demo": (7, 19, True),
}

# Date layouts seen in exports, tried in this order, with the shape a value must have to be parsed.
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "dd-MMM-yy": r"^\d{2}-[A-Za-z]{3}-\d{2}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
}

# A clock time behind a date, as in `2024-11-14 09:30:00` or `2024-11-14T09:30`.
CLOCK_TAIL = r"[ T]\d{1,2}:\d{2}.*$"

# Fixed value: two-digit years from 69 on belong to the 1900s.
CENTURY_PIVOT = 2069


def is_after_hours(hour: Column, window: str = "rules") -> Column:
    """Whether `hour` lies outside the working day; `end_included` keeps the closing hour inside it."""
    start, end, end_included = HOURS[window]
    late = hour > end if end_included else hour >= end
    return (hour < start) | late


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def as_instant(wall_clock: Column) -> Column:
    """A timestamp without zone read as UTC, whatever the session's zone. Watermarks accept only instants."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), wall_clock))


def as_wall_clock(instant: Column) -> Column:
    """The inverse of `as_instant`: the UTC clock reading as a timestamp without zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch())


def hour_of_text(time: Column) -> Column:
    """The hour before the first colon, null when it is no number. Hour 24 is kept, timestamps could not hold it."""
    return F.regexp_extract(time, r"^(\d+)(?::|$)", 1).try_cast("int")


def clock_parts(time: Column, default_hour: int = 12) -> tuple[Column, Column]:
    """(hour, minute) of a leading `H:M` text, (default, 0) when the text has no such start."""
    hour = F.regexp_extract(time, r"^(\d+):(\d+)", 1).try_cast("int")
    minute = F.regexp_extract(time, r"^(\d+):(\d+)", 2).try_cast("int")
    return F.coalesce(hour, F.lit(default_hour)), F.when(hour.isNull(), 0).otherwise(minute)


def any_date(value: Column, formats: dict[str, str] = DATE_FORMATS) -> Column:
    """A date from text in any of the known layouts, with or without a clock time behind it; null when none fits.

    The shape test comes first: a failed parse costs an exception per row, a failed match next to nothing.
    """
    value = F.regexp_replace(F.trim(value), CLOCK_TAIL, "")
    tries = []
    for layout, shape in formats.items():
        parsed = F.try_to_date(value, layout)
        if "yyyy" not in layout:
            parsed = F.when(F.year(parsed) >= CENTURY_PIVOT, F.add_months(parsed, -1200)).otherwise(parsed)
        tries.append(F.when(value.rlike(shape), parsed))
    return F.coalesce(*tries)


def weekday_or(date: Column, default: int) -> Column:
    """Monday = 0; `default` when there is no date."""
    return F.coalesce(F.weekday(date), F.lit(default))
