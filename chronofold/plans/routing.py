"""Transparent downsampling: a request reads the coarsest stored rollup and finer ones for its tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rollup, series

RESOLUTIONS = (rollup.RAW, rollup.MINUTE5, rollup.HOUR, rollup.DAY)


def chosen(n: int | None) -> list[int]:
    """Resolutions to read for an interval: the coarsest up to it first, raw last."""
    return [r for r in reversed(RESOLUTIONS) if r == rollup.RAW or (n is not None and r <= n)]


def pieces(raw: DataFrame, rolled: DataFrame, start: int, stop: int, n: int | None, aggregator: str | None, boundaries: dict[int, int] | None = None) -> DataFrame:
    """raw's columns over [start, stop) from disjoint time ranges of ever finer resolutions.

    A resolution reaches to the bucket after its latest row, all series taken together; boundaries
    gives those ends where they are known, else one max(ts) is asked for each resolution.
    """
    columns = [c for c in raw.columns if c in rolled.columns]
    out, at = None, start
    for r in chosen(n if aggregator in rollup.AGGREGATES else None):
        if at >= stop:
            break
        if r == rollup.RAW:
            own, end = raw.select(*columns), stop
        else:
            own = rolled.filter((F.col("resolution") == r) & (F.col("agg") == aggregator)).select(*columns)
            if boundaries is not None:
                end = boundaries.get(r, at)
            else:
                last = series.latest(own.filter((F.col("ts") >= at) & (F.col("ts") < stop)))
                end = at if last is None else last - last % r + r
            end = min(max(end, at), stop)
        if end > at:
            own = own.filter((F.col("ts") >= at) & (F.col("ts") < end))
            out, at = own if out is None else out.unionByName(own), end
    return raw.select(*columns).limit(0) if out is None else out


def read(raw: DataFrame, rolled: DataFrame, keys: list[str], start: int, stop: int, n: int, aggregator: str, boundaries: dict[int, int] | None = None) -> DataFrame:
    """keys, ts, value downsampled to n: the pieces together first, then one downsampling, so that no
    bucket is split at a boundary."""
    return series.downsample(pieces(raw, rolled, start, stop, n, aggregator, boundaries), keys, n, aggregator)
