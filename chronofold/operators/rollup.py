"""Rollups: five-minute and hourly from raw points, daily from hourly; max, min, sum and avg of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timeutil

RAW, MINUTE5, HOUR, DAY = 0, 300, 3600, 86_400
AGGREGATES = ("max", "min", "sum", "avg")


def rollup_points(points: DataFrame, keys: list[str], resolution: int, value_type: str = "float") -> DataFrame:
    """keys, resolution, agg, ts (a bucket's start), value: four rows for each filled bucket."""
    bucket = timeutil.floor(F.col("ts"), resolution).alias("ts")
    wide = points.groupBy(*keys, bucket).agg(*[getattr(F, a)("value").alias(a) for a in AGGREGATES])
    stack = ", ".join(f"'{a}', {a}" for a in AGGREGATES)
    long = wide.select(*keys, "ts", F.expr(f"stack({len(AGGREGATES)}, {stack}) AS (agg, value)"))
    return long.select(*keys, F.lit(resolution).alias("resolution"), "agg", "ts", F.col("value").cast(value_type).cast("double").alias("value"))


def hourly(points: DataFrame, keys: list[str], value_type: str = "float") -> DataFrame:
    """Raw to five minutes and, from their sums and counts, to an hour: one read and one shuffle, by
    the hour, in which both buckets lie."""
    hour, minutes = timeutil.floor(F.col("ts"), HOUR).alias("_hour"), timeutil.floor(F.col("ts"), MINUTE5).alias("ts")
    rows = points.select(*keys, hour, minutes, "value").repartition(*keys, "_hour")
    five = rows.groupBy(*keys, "_hour", "ts").agg(F.max("value").alias("max"), F.min("value").alias("min"), F.sum("value").alias("sum"), F.count("value").alias("n"))
    part = F.collect_list(F.struct(F.lit(MINUTE5).alias("resolution"), "ts", "max", "min", "sum", "n")).alias("parts")  # twelve at most
    whole = five.groupBy(*keys, "_hour").agg(F.max("max").alias("max"), F.min("min").alias("min"), F.sum("sum").alias("sum"), F.sum("n").alias("n"), part)
    every = F.concat("parts", F.array(F.struct(F.lit(HOUR).alias("resolution"), F.col("_hour").alias("ts"), "max", "min", "sum", "n")))
    rows = whole.select(*keys, F.inline(every)).withColumn("avg", F.try_divide("sum", "n"))
    long = rows.select(*keys, "resolution", "ts", F.expr("stack(4, " + ", ".join(f"'{a}', {a}" for a in AGGREGATES) + ") AS (agg, value)"))
    return long.select(*keys, "resolution", "agg", "ts", F.col("value").cast(value_type).cast("double").alias("value"))


def daily(hours: DataFrame, keys: list[str], value_type: str = "float") -> DataFrame:
    """Hourly rows to days, each aggregate from its own kind (avg is the average of averages)."""
    bucket = timeutil.floor(F.col("ts"), DAY).alias("ts")
    same = F.when(F.col("agg") == "max", F.max("value")).when(F.col("agg") == "min", F.min("value")).when(F.col("agg") == "sum", F.sum("value")).otherwise(F.avg("value"))
    rows = hours.filter(F.col("resolution") == HOUR).groupBy(*keys, "agg", bucket).agg(same.cast(value_type).cast("double").alias("value"))
    return rows.select(*keys, F.lit(DAY).alias("resolution"), "agg", "ts", "value")


def check_range(start: int, stop: int, granularity: str) -> None:
    step = {"hour": HOUR, "day": DAY}.get(granularity)
    if step is None:
        raise ValueError("the granularity is hour or day")
    if start % step or stop % step or stop <= start:
        raise ValueError(f"times of a rollup by the {granularity} are multiples of {step} s, the stop after the start")


def run(points: DataFrame, rolled: DataFrame | None, keys: list[str], start: int, stop: int, granularity: str) -> DataFrame:
    """New rollup rows of [start, stop): from raw points by the hour, from hourly rows by the day."""
    check_range(start, stop, granularity)
    within = (F.col("ts") >= start) & (F.col("ts") < stop)
    return hourly(points.filter(within), keys) if granularity == "hour" else daily(rolled.filter(within), keys)
