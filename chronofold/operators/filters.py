"""Tag filters: predicates over points and the tags they group by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model


@dataclass(frozen=True)
class TagFilter:
    """values: one (equal, not grouped by), several (any of them, grouped by) or None (present, grouped by)."""

    tag: str
    values: tuple[str, ...] | None = None

    @property
    def grouped(self) -> bool:
        return self.values is None or len(self.values) > 1

    def column(self, tags: str = "tags") -> Column:
        value = F.col(tags)[self.tag]
        if self.values is None:
            return value.isNotNull()
        return value == self.values[0] if len(self.values) == 1 else value.isin(*self.values)


def of(tag: str, text: str, separator: str = "|") -> TagFilter:
    """`*`, `v`, or values with a separator between."""
    if text == "*":
        return TagFilter(tag)
    values = tuple(text.split(separator))
    if not all(values):
        raise ValueError(f"an empty value in the filter {text!r} of tag {tag!r}")
    return TagFilter(tag, values)


def from_mapping(tags: dict[str, str]) -> list[TagFilter]:
    return [of(k, v) for k, v in tags.items()]


def from_text(text: str) -> list[TagFilter]:
    """`k->v;k->a b;k->*`."""
    out = []
    for part in filter(None, text.split(";")):
        tag, arrow, value = part.partition("->")
        if not arrow or not tag or not value:
            raise ValueError(f"not a filter: {part!r}; expected tag->value")
        out.append(of(tag, value, " "))
    return out


def require_shard(filters: list[TagFilter], shard_tags: tuple[str, ...] = model.SHARD_TAGS) -> TagFilter:
    """The one shard filter that a query must have; it names values."""
    own = [f for f in filters if f.tag in shard_tags]
    if len(own) != 1 or own[0].values is None:
        raise ValueError(f"a query filters exactly one of the tags {', '.join(shard_tags)} by value")
    return own[0]


def select(points: DataFrame, metric: str | None = None, start: int | None = None, stop: int | None = None, filters: list[TagFilter] = ()) -> DataFrame:
    """Points of a metric in [start, stop) that pass all filters; further tags are allowed."""
    if metric is not None:
        points = points.filter(F.col("metric") == metric)
    if start is not None:
        points = points.filter(F.col("ts") >= start)
    if stop is not None:
        points = points.filter(F.col("ts") < stop)
    for f in filters:
        points = points.filter(f.column())
    return points


def group_tags(filters: list[TagFilter]) -> list[str]:
    return sorted(f.tag for f in filters if f.grouped)


def group_key(tags: list[str]) -> Column:
    """`k=v` of the group-by tags, joined by commas; empty without any."""
    if not tags:
        return F.lit("")
    return F.concat_ws(",", *[F.concat(F.lit(t + "="), F.col("tags")[t]) for t in sorted(tags)])
