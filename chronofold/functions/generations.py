"""Generations: periods of time with their own partition; points outside all of them are set apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import timeutil

#: How many periods ahead of now a point may be.
AHEAD = 1
OUTLANDER = -1


@dataclass(frozen=True)
class Period:
    """From `start` on, generations of period_spans * 14 days; the first has the number `first`."""

    start: int
    length: int
    first: int


def calendar(configs: list[tuple[str, int]]) -> list[Period]:
    """Periods of (dd/MM/yy date, period_spans), in order of date; numbers go on from one to the next.

    No generation is cut: a further period begins where a generation of the period before ends, on
    or after its own date, and leaves that period AHEAD + 1 generations at least.
    """
    out: list[Period] = []
    for start, length in sorted((timeutil.aligned_date(d), spans * timeutil.SPAN) for d, spans in configs):
        if length <= 0:
            raise ValueError("a period has one span at least")
        if not out:
            out.append(Period(start, length, 0))
            continue
        before = out[-1]
        n = max(AHEAD + 1, -(-(start - before.start) // before.length))
        out.append(Period(before.start + n * before.length, length, before.first + n))
    return out


def generation(ts: Column, periods: list[Period], now: int) -> Column:
    """The generation's number of a time; OUTLANDER before the first period or too far ahead."""
    out = F.lit(OUTLANDER)
    for p in periods:
        out = F.when(ts >= p.start, F.lit(p.first) + F.floor((ts - p.start) / p.length)).otherwise(out)
    current = generation_at(now, periods)
    return F.when(out > current + AHEAD, OUTLANDER).otherwise(out).cast("int")


def generation_at(ts: int, periods: list[Period]) -> int:
    own = [p for p in periods if p.start <= ts]
    return own[-1].first + (ts - own[-1].start) // own[-1].length if own else OUTLANDER


def covering(start: int, stop: int, periods: list[Period]) -> list[int]:
    """Generations that hold times of [start, stop)."""
    if not periods or stop <= start or stop <= periods[0].start:
        return []
    return list(range(generation_at(max(start, periods[0].start), periods), generation_at(stop - 1, periods) + 1))


def time_range(number: int, periods: list[Period]) -> tuple[int, int]:
    """[start, stop) of a generation."""
    p = [p for p in periods if p.first <= number][-1]
    start = p.start + (number - p.first) * p.length
    return start, start + p.length
