"""Time buckets and formatting. Times are microsecond timestamps without zone unless said."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of interval texts in microseconds; a month has 30 days, a year 365.2425.
UNIT_MICROS = {"us": 1, "microsecond": 1, "ms": 1_000, "millisecond": 1_000, "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "m": 60_000_000, "min": 60_000_000, "minute": 60_000_000, "h": 3_600_000_000, "hour": 3_600_000_000, "d": 86_400_000_000, "day": 86_400_000_000, "w": 604_800_000_000, "week": 604_800_000_000, "month": 2_592_000_000_000, "y": 31_556_952_000_000, "year": 31_556_952_000_000}
# Format tokens of TO_CHAR and their Java patterns.
CHAR_TOKENS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "MI": "mm", "SS": "ss"}
_PART = re.compile(r"(\d+(?:\.\d+)?)\s*([a-zA-Z]+)?")


def interval_micros(text: str | int, bare: str = "ms") -> int:
    """Microseconds of '15m', '1h30m', '5 minutes' or a bare number in ``bare`` units."""
    text = str(text).strip()
    total, at = 0.0, 0
    for part in _PART.finditer(text):
        if text[at : part.start()].strip():
            break
        unit = (part[2] or bare).lower()
        if unit not in UNIT_MICROS and unit.endswith("s"):
            unit = unit[:-1]
        if unit not in UNIT_MICROS:
            raise ValueError(f"unknown unit in interval {text!r}")
        total, at = total + float(part[1]) * UNIT_MICROS[unit], part.end()
    if not total or text[at:].strip():
        raise ValueError(f"not an interval: {text!r}")
    return round(total)


def sql_interval(micros: int) -> str:
    return f"{micros} microseconds"


def time_bucket(interval: str | int, ts: Column, origin: str | datetime | None = None) -> Column:
    """Start of the bucket that holds ``ts``: origin + floor((ts - origin) / interval) * interval.

    The origin is the epoch by default. Built on window(), so it prunes,
    aggregates and streams like Spark's own windows.
    """
    micros = interval_micros(interval)
    if origin is None:
        return F.window(ts, sql_interval(micros)).getField("start")
    base = datetime.fromisoformat(str(origin))
    shift = round((base - datetime(1970, 1, 1)).total_seconds() * 1_000_000) % micros
    return F.window(ts, sql_interval(micros), sql_interval(micros), sql_interval(shift)).getField("start")


def to_iso8601(ts: Column) -> Column:
    """2024-01-02T03:04:05+00:00, with microseconds only where they are not zero."""
    zoned = ts.cast("timestamp")
    whole = F.date_format(zoned, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.pmod(F.unix_micros(zoned), F.lit(1_000_000)) == 0, whole).otherwise(F.date_format(zoned, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def java_pattern(form: str) -> str:
    """Java pattern of a TO_CHAR format; other characters stand for themselves."""
    out, at = "", 0
    while at < len(form):
        token = next((t for t in sorted(CHAR_TOKENS, key=len, reverse=True) if form.startswith(t, at)), None)
        out += CHAR_TOKENS[token] if token else ("''" if form[at] == "'" else f"'{form[at]}'" if form[at].isalpha() else form[at])
        at += len(token) if token else 1
    return out


def to_char(ts: Column, form: str) -> Column:
    return F.date_format(ts, java_pattern(form))


def to_epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def at_time_zone(ts: Column, zone: str) -> Column:
    """Wall clock of a UTC time in a zone."""
    return F.from_utc_timestamp(ts, zone)


def difference_micros(a: Column, b: Column) -> Column:
    return F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
