"""Time literals in nanoseconds and epoch-aligned buckets."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput

HOUR_NS = 3600 * 10**9
_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "y": 365 * 86400 * 10**9}
_PART = re.compile(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d|w|y)")


def duration_ns(text: str | int) -> int:
    """``1h30m``, ``500ms``, ``1.5s``; a bare integer is nanoseconds."""
    text = str(text).strip()
    if re.fullmatch(r"\d+", text):
        return int(text)
    at, total = 0, 0.0
    for m in _PART.finditer(text):
        if m.start() != at:
            break
        total += float(m[1]) * _UNITS[m[2]]
        at = m.end()
    if at != len(text) or not text:
        raise InvalidInput(f"not a duration: {text!r}")
    return round(total)


def instant_ns(text: str | int, now_ns: int) -> int:
    """RFC 3339, ``now``, ``now-1h``, ``now+30m`` or integer nanoseconds."""
    if isinstance(text, int):
        return text
    text = text.strip()
    if text.startswith("now"):
        rest = text[3:].strip()
        if not rest:
            return now_ns
        if rest[0] not in "+-":
            raise InvalidInput(f"not a time: {text!r}")
        return now_ns + (1 if rest[0] == "+" else -1) * duration_ns(rest[1:])
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    try:
        when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise InvalidInput(f"not a time: {text!r}") from None
    when = when if when.tzinfo else when.replace(tzinfo=UTC)
    delta = when - datetime(1970, 1, 1, tzinfo=UTC)
    return (delta.days * 86400 + delta.seconds) * 10**9 + delta.microseconds * 1000


def bucket(ns: Column, step_ns: int) -> Column:
    """The start of the epoch-aligned step that a time is in, also before the epoch."""
    return ns - F.pmod(ns, F.lit(step_ns))


def window(column: Column, start_ns: int, end_ns: int) -> Column:
    """Closed at both ends."""
    return (column >= F.lit(start_ns)) & (column <= F.lit(end_ns))


def within(frame: DataFrame, time: str, start_ns: int, end_ns: int) -> DataFrame:
    """The rows of a window. Of a stored table, whose folders are hours, only those of the window are read."""
    if "hour_bucket" in frame.columns:
        frame = frame.where(F.col("hour_bucket").between(start_ns // HOUR_NS, end_ns // HOUR_NS))
    return frame.where(window(F.col(time), start_ns, end_ns))


def seconds_ns(seconds: int) -> int:
    """Epoch seconds as nanoseconds; numbers that must be milliseconds or finer are refused."""
    if isinstance(seconds, bool) or not isinstance(seconds, int) or abs(seconds) >= 10**11:
        raise InvalidInput(f"not a time in seconds: {seconds!r}")
    return seconds * 10**9


def steps(start_ns: int, end_ns: int, step_ns: int) -> Column:
    """All bucket starts of a window, as an array."""
    return F.sequence(F.lit(start_ns - start_ns % step_ns), F.lit(end_ns), F.lit(step_ns))
