"""Aggregators by name. A registered one is a function from a column to an aggregate column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_KNOWN: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
BUILT_IN = frozenset(_KNOWN)


def names() -> frozenset[str]:
    return frozenset(_KNOWN)


def register(name: str, function: Callable[[Column], Column]) -> None:
    """Add an aggregator (any Spark or pandas aggregate) to queries; built-in names are kept."""
    if name in BUILT_IN:
        raise ValueError(f"{name} is built in")
    _KNOWN[name] = function


def get(name: str) -> Callable[[Column], Column]:
    try:
        return _KNOWN[name]
    except KeyError:
        raise ValueError(f"unknown aggregator {name!r}; known: {', '.join(sorted(_KNOWN))}") from None
