"""Query requests as DataFrames: filter, downsample, group, rate, interpolate; and their JSON and text."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregators, timeutil
from ..operators import filters, series
from . import routing


@dataclass(frozen=True)
class Query:
    metric: str
    aggregator: str
    filters: tuple[filters.TagFilter, ...] = ()
    rate: bool = False
    downsample: tuple[int, str] | None = None


@dataclass(frozen=True)
class Request:
    start: int
    stop: int
    queries: tuple[Query, ...] = field(default=())


def parse(body: dict | str, now: int | None = None) -> Request:
    """The JSON request; times are in milliseconds, a missing end is now."""
    body = json.loads(body) if isinstance(body, str) else body
    queries = []
    for q in body["queries"]:
        name = q["aggregator"]
        aggregators.get(name)
        spec = q.get("downsample")
        queries.append(Query(q["metric"], name, tuple(filters.from_mapping(q.get("tags", {}))), bool(q.get("rate", False)), timeutil.downsample_spec(spec, aggregators.names()) if spec else None))
    end = body.get("end")
    return Request(int(body["start"] / 1000), int(end / 1000) if end is not None else int(time.time() if now is None else now), tuple(queries))


def parse_simple(metric: str, start: int, end: int, attrs: str = "", agrg: str = "", **ignored) -> Request:
    """The simple request: times in seconds; without an aggregator the single series' points."""
    if agrg:
        aggregators.get(agrg)
    return Request(int(start), int(end), (Query(metric, agrg or "sum", tuple(filters.from_text(attrs))),))


def plan(points: DataFrame, request: Request, query: Query, rolled: DataFrame | None = None, check_shard: bool = True, method: str = "auto", deduplicate: bool = True) -> DataFrame:
    """group, the group-by tags, ts, value of one query over points (and stored rollups of them).

    Stages: select, last write, downsampling of each series (through rollups where stored), rate,
    interpolated aggregation over each group, and averages of the request's buckets.
    Unknown metrics and tags give no rows.
    """
    if check_shard:
        filters.require_shard(list(query.filters))
    names = filters.group_tags(list(query.filters))
    own = filters.select(points, query.metric, request.start, request.stop, list(query.filters))
    if deduplicate:
        own = series.last_write(own)
    tagged = lambda df: df.select(filters.group_key(names).alias("group"), *[F.col("tags")[n].alias(f"tag_{n}") for n in names], "series_key", "ts", "value", *[c for c in ("resolution", "agg") if c in df.columns])
    own = tagged(own)
    group = ["group", *[f"tag_{n}" for n in names]]
    n = None
    if query.downsample:
        n, by = query.downsample
        if rolled is not None:
            coarse = tagged(filters.select(rolled, query.metric, request.start, request.stop, list(query.filters)))
            own = routing.read(own, coarse, [*group, "series_key"], request.start, request.stop, n, by)
        else:
            own = series.downsample(own, [*group, "series_key"], n, by)
    if query.rate:
        own = series.rate(own, [*group, "series_key"])
    return series.interpolate_and_downsample(own, group, ["series_key"], query.aggregator, n, method)


def run(points: DataFrame, request: Request, rolled: DataFrame | None = None, **options) -> list[DataFrame]:
    return [plan(points, request, q, rolled, **options) for q in request.queries]


def to_json_rows(result: DataFrame, metric: str) -> DataFrame:
    """One JSON object for each group: metric, tags (the group-by tags), dps by time in order."""
    names = [c.removeprefix("tag_") for c in result.columns if c.startswith("tag_")]
    tags = F.create_map(*[x for n in names for x in (F.lit(n), F.first(f"tag_{n}"))]) if names else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    points = F.array_sort(F.collect_list(F.struct("ts", "value")))
    dps = F.map_from_entries(F.transform(points, lambda p: F.struct(p["ts"].cast("string"), p["value"])))
    return result.groupBy("group").agg(F.to_json(F.struct(F.lit(metric).alias("metric"), tags.alias("tags"), dps.alias("dps"))).alias("json"))


def to_text_lines(result: DataFrame) -> DataFrame:
    """Of each group: a line with its tags, then `ts value` lines; in order by (group, line)."""
    lines = result.select("group", F.col("ts").alias("line"), F.concat_ws(" ", F.col("ts").cast("string"), F.col("value").cast("string")).alias("text"))
    heads = result.select("group").distinct().select("group", F.lit(-1).cast("bigint").alias("line"), F.concat(F.lit("{"), "group", F.lit("}")).alias("text"))
    return heads.unionByName(lines)
