"""Durations, downsampling requests, time buckets and the generation calendar's dates."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column

#: Seconds of a unit; a year is 365 days.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "y": 31_536_000}
#: A generation's dates fall on multiples of this many seconds (14 days).
SPAN = 14 * 86_400


def duration(text: str) -> int:
    """Seconds of `<n><unit>`."""
    m = re.fullmatch(r"([0-9]+)([smhdwy])", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}; expected a number and one of {', '.join(UNITS)}")
    return int(m[1]) * UNITS[m[2]]


def downsample_spec(text: str, aggregators) -> tuple[int, str]:
    """(seconds, aggregator) of `<duration>-<aggregator>`."""
    interval, dash, name = text.partition("-")
    if not dash or name not in aggregators:
        raise ValueError(f"not a downsampling request: {text!r}; expected <duration>-<one of {', '.join(sorted(aggregators))}>")
    seconds = duration(interval)
    if seconds <= 0:
        raise ValueError("a downsampling interval is at least one second")
    return seconds, name


def floor(ts: Column, n: int) -> Column:
    return ts - ts % n


def aligned_date(text: str) -> int:
    """Epoch seconds (UTC) of a dd/MM/yy date, moved back to a multiple of SPAN."""
    day = dt.datetime.strptime(text, "%d/%m/%y").replace(tzinfo=dt.timezone.utc)
    seconds = int(day.timestamp())
    return seconds - seconds % SPAN
