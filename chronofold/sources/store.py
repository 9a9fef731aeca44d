"""Points in partitioned Parquet: writing, pruned scans, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import generations
from ..operators import filters, rollup, series

PARTITIONS = ["generation", "resolution", "agg", "shard"]


def placed(points: DataFrame, periods: list[generations.Period], now: int, shard_tags=model.SHARD_TAGS) -> DataFrame:
    """points with generation, resolution, agg and shard; outlanders have generation -1."""
    out = points.withColumns({"generation": generations.generation(F.col("ts"), periods, now), "shard": model.shard_of(F.col("tags"), shard_tags)})
    for name, value in (("resolution", F.lit(0)), ("agg", F.lit("none"))):
        if name not in out.columns:
            out = out.withColumn(name, value)
    return out


def write(points: DataFrame, path: str, mode: str = "append") -> None:
    """Rows dealt by partition and metric, sorted as a scan reads them. Adaptive execution cuts a
    hot partition over several tasks and joins small ones (a rebalance, not a fixed repartition)."""
    rows = points.hint("rebalance", *[F.col(c) for c in PARTITIONS], F.col("metric")).sortWithinPartitions(*PARTITIONS, "metric", "series_key", "ts")
    rows.write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def scan(spark: SparkSession, path: str, metric: str, start: int, stop: int, tag_filters: list[filters.TagFilter], periods: list[generations.Period], resolution: int = 0, agg: str = "none", shard_tags=model.SHARD_TAGS) -> DataFrame:
    """Stored points: partitions by generation, resolution, aggregate and shard are pruned, metric
    and time are pushed to the files, other tags filter what is read."""
    shard = filters.require_shard(tag_filters, shard_tags)
    rows = spark.read.parquet(path).filter(F.col("generation").isin(generations.covering(start, stop, periods)) & (F.col("resolution") == resolution) & (F.col("agg") == agg) & F.col("shard").isin(*shard.values))
    return filters.select(rows, metric, start, stop, tag_filters)


def outlanders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("generation") == generations.OUTLANDER)


def _merged(rows: DataFrame) -> DataFrame:
    """Each time's last write, within generation, resolution and aggregate."""
    return series.last_write(rows, by_series=("generation", "resolution", "agg", "shard"))


def compact(spark: SparkSession, path: str, to: str, deduplicate: bool = True) -> None:
    """The stored points with only each time's last write, or all of them, to another path, in a few sorted files."""
    rows = spark.read.parquet(path)
    write(_merged(rows) if deduplicate else rows, to, "overwrite")


def compact_changed(spark: SparkSession, path: str, staging: str, most_files: int = 1) -> int:
    """Compact in place the partitions of more than most_files files, and no others; how many.

    They are merged to staging first and then replace the partitions that they came from.
    """
    rows = spark.read.parquet(path)
    files = rows.select(*PARTITIONS, F.input_file_name().alias("f")).distinct().groupBy(*PARTITIONS).agg(F.count("*").alias("n"))
    changed = files.filter(F.col("n") > most_files).select(*PARTITIONS)
    write(_merged(rows.join(changed, PARTITIONS, "left_semi")), staging, "overwrite")
    done = spark.read.schema(rows.schema).parquet(staging)
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    return done.select(*PARTITIONS).distinct().count()


def write_lists(lists: DataFrame, path: str, periods: list[generations.Period], now: int, mode: str = "append") -> None:
    """List points (model.LISTS) beside the scalars, laid out alike."""
    write(placed(lists, periods, now), path, mode)


def scan_lists(spark: SparkSession, path: str, metric: str, start: int, stop: int, tag_filters: list[filters.TagFilter], periods: list[generations.Period]) -> DataFrame:
    """Stored list points of a range, pruned as scan() does, with `values` widened."""
    return scan(spark, path, metric, start, stop, tag_filters, periods).withColumn("values", model.widened_list(F.col("int_list"), F.col("float_list")))


def roll_up(spark: SparkSession, path: str, periods: list[generations.Period], start: int, stop: int, granularity: str, deduplicate: bool = True) -> list[int]:
    """The rollup job: for each generation that [start, stop) meets, read its raw (by the hour) or
    hourly (by the day) points alone, and append their rollups to the store; the generations done.
    Of one time's writes the last counts, or all do."""
    rollup.check_range(start, stop, granularity)
    done = []
    for g in generations.covering(start, stop, periods):
        low, high = generations.time_range(g, periods)
        rows = spark.read.parquet(path).filter((F.col("generation") == g) & (F.col("ts") >= max(start, low)) & (F.col("ts") < min(stop, high)))
        keys = ["metric", "series_key", "generation", "shard"]
        if granularity == "hour":
            raw = rows.filter((F.col("resolution") == rollup.RAW) & (F.col("agg") == "none"))
            out = rollup.hourly(series.last_write(raw, by_series=("generation", "shard", "agg")) if deduplicate else raw, keys)
        else:
            out = rollup.daily(rows.filter(F.col("resolution") == rollup.HOUR).select(*keys, "resolution", "agg", "ts", "value"), keys)
        full = out.withColumns({"tags": model.tags_of(F.col("series_key")), "kind": F.lit("FLOAT"), "int_value": F.lit(None).cast("bigint"), "float_value": F.col("value").cast("float"), "write_seq": F.lit(0).cast(model.SEQUENCE)})
        write(full.select(*model.POINTS.names, *PARTITIONS), path)
        done.append(g)
    return done


def create_table(spark: SparkSession, name: str, path: str) -> None:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.POINTS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, generation INT, resolution INT, agg STRING, shard STRING) USING parquet PARTITIONED BY ({', '.join(PARTITIONS)}) LOCATION '{path}'")


def list_points(lists: DataFrame, metric: str, start: int, stop: int, tag_filters: list[filters.TagFilter]) -> DataFrame:
    """List points of a range, with their items widened to doubles in `values`."""
    return filters.select(lists, metric, start, stop, tag_filters).withColumn("values", model.widened_list(F.col("int_list"), F.col("float_list")))
