"""Zone-free timestamps: parsing, alignment to a resolution, grids, calendar encodings, durations."""

from __future__ import annotations

import math
import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR_DAY = "2020-05-01"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(ts: Column | str) -> Column:
    """Whole seconds since the epoch of a zone-free timestamp."""
    return F.floor(F.unix_micros(_col(ts).cast("timestamp")) / F.lit(1_000_000)).cast("long")


def from_seconds(s: Column) -> Column:
    return F.timestamp_seconds(s).cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def floor_to(ts: Column | str, minutes: int) -> Column:
    step = minutes * 60
    return from_seconds(F.floor(micros(ts) / F.lit(step * 1_000_000)).cast("long") * step)


def ceil_to(ts: Column | str, minutes: int) -> Column:
    """The next aligned time; an aligned one is its own."""
    step = minutes * 60
    return from_seconds(F.ceil(micros(ts) / F.lit(step * 1_000_000)).cast("long") * step)


def plus_minutes(ts: Column | str, minutes: int) -> Column:
    return _col(ts) + F.expr(f"INTERVAL {minutes} MINUTES")


def grid(start: Column | str, end: Column | str, minutes: int) -> Column:
    """Regular timestamps from start to end, both included."""
    return F.sequence(_col(start), _col(end), F.expr(f"INTERVAL {minutes} MINUTES"))


def parse(text: Column | str) -> Column:
    """Timestamps in the accepted spellings, else null; an offset is applied and the label is UTC wall time."""
    x = F.trim(_col(text))
    plain = F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss"))
    day = F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))
    offset = F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    return F.coalesce(plain, offset, day).cast("timestamp_ntz")


def day_clock(day: Column | str, clock: Column | str, anchor: str = ANCHOR_DAY) -> Column:
    """The anchor day, day - 1 days later, at HH:MM; null if the clock can't be read."""
    ok = _col(clock).rlike(r"^\d{1,2}:\d{2}$")
    parts = F.split(_col(clock), ":")
    hour, minute = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    made = F.lit(anchor).cast("timestamp_ntz") + F.make_dt_interval(_col(day).cast("int") - 1, hour, minute)
    return F.when(ok & (hour < 24) & (minute < 60), made)


def calendar(ts: Column | str) -> dict[str, Column]:
    """Cyclic encodings of the minute of the day, the ISO weekday and the month, and weekend flags.

    is_weekend follows the established definition, ISO weekday of 5 or more, which has
    Friday in; is_weekend_corrected has Saturday and Sunday alone.
    """
    t = _col(ts)
    minute = F.hour(t) * 60 + F.minute(t)
    weekday = F.weekday(t) + 1
    month = F.month(t) - 1
    out = {}
    for name, value, period in (("time_of_day", minute, 1440.0), ("day_of_week", weekday - 1, 7.0), ("month_of_year", month, 12.0)):
        angle = value * F.lit(2 * math.pi / period)
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    out["is_weekend"] = (weekday >= 5).cast("int")
    out["is_weekend_corrected"] = (weekday >= 6).cast("int")
    return out


_DURATION = re.compile(r"(\d+)([dhms])")


def parse_duration(text: str) -> timedelta:
    """A duration such as 1d2h30m."""
    found = _DURATION.findall(text.strip().lower())
    if not found or "".join(n + u for n, u in found) != text.strip().lower():
        raise ValueError(f"not a duration: {text!r}")
    unit = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}
    total = timedelta()
    for n, u in found:
        total += timedelta(**{unit[u]: int(n)})
    return total


def format_duration(value: timedelta) -> str:
    left, out = int(value.total_seconds()), ""
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        n, left = divmod(left, size)
        out += f"{n}{unit}" if n else ""
    return out or "0s"


def duration_steps(text: str, minutes: int) -> int:
    """How many steps of a resolution a duration has; it must be a whole number."""
    n, rest = divmod(parse_duration(text).total_seconds(), minutes * 60)
    if rest or n <= 0:
        raise ValueError(f"{text} is not a whole number of {minutes} minute steps")
    return int(n)
