"""Points: schemas, canonical series keys, widening, and points from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tag names of which every point has exactly one; its value is the point's shard.
SHARD_TAGS = ("cluster",)

#: Order of writes: several columns in one number, of fixed width, so that aggregates by it can hash.
SEQUENCE = T.DecimalType(38, 0)

POINTS = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("series_key", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("int_value", T.LongType()),
    T.StructField("float_value", T.FloatType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("write_seq", SEQUENCE),
])
LISTS = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("series_key", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("int_list", T.ArrayType(T.LongType())),
    T.StructField("float_list", T.ArrayType(T.FloatType())),
    T.StructField("write_seq", SEQUENCE),
])


def series_key(tags: Column) -> Column:
    """Sorted `k=v` entries joined by commas: maps themselves can't be grouped or joined."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def epoch_seconds(column: str) -> Column:
    """Whole seconds of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01', `{column}`)")


def widened(int_value: Column, float_value: Column) -> Column:
    return F.coalesce(int_value.cast("double"), float_value.cast("double"))


def widened_list(int_list: Column, float_list: Column) -> Column:
    return F.coalesce(F.transform(int_list, lambda x: x.cast("double")), F.transform(float_list, lambda x: x.cast("double")))


def sequence(*columns: tuple[str, int]) -> Column:
    """(column, digits) of non-negative whole numbers as one number that orders rows as they do; 36 digits in all at most."""
    out = F.lit(0).cast("decimal(38,0)")
    for name, digits in columns:
        out = (out * F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast("decimal(38,0)") + F.col(name).cast("decimal(20,0)")
    return out.cast(SEQUENCE)


def tags_of(key: Column) -> Column:
    """The tags that a series key was made of. Names and values have no ',' or '=' (validation sees to that)."""
    return F.when(key == "", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.str_to_map(key, F.lit(","), F.lit("=")))


def shard_of(tags: Column, shard_tags: tuple[str, ...] = SHARD_TAGS) -> Column:
    """The value of the one shard tag; null unless there is exactly one."""
    own = F.map_filter(tags, lambda k, v: k.isin(*shard_tags))
    return F.when(F.size(own) == 1, F.element_at(F.map_values(own), 1))


def shard_name(tag: Column, value: Column) -> Column:
    """`{tag: value}_len_len` (a fixed format): unambiguous whatever characters the two hold."""
    return F.concat(F.lit("{"), tag, F.lit(": "), value, F.lit("}_"), F.length(tag).cast("string"), F.lit("_"), F.length(value).cast("string"))


def complete(rows: DataFrame, key: str | None = None) -> DataFrame:
    """POINTS columns from metric, tags, ts, kind, int_value, float_value and write_seq; key names a column that has the series key."""
    own = series_key(F.col("tags")) if key is None else F.col(key)
    return rows.select("metric", "tags", own.alias("series_key"), F.col("ts").cast("bigint").alias("ts"), "kind", F.col("int_value").cast("bigint").alias("int_value"), F.col("float_value").cast("float").alias("float_value"), widened(F.col("int_value"), F.col("float_value")).alias("value"), F.col("write_seq").cast(SEQUENCE).alias("write_seq"))


def event_points(events: DataFrame) -> DataFrame:
    """FLOAT points of an event table: metric event_type, tags user and cluster. The key is written
    out in the order of its two names, as sorting a map row by row takes several times as long, and
    not from tags, so that a query without them makes no map."""
    own = {"cluster": F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")), "user": F.col("user_id").cast("string")}
    tags = F.create_map(*[c for k, v in own.items() for c in (F.lit(k), v)])
    key = F.concat_ws(",", *[F.concat(F.lit(f"{k}="), v) for k, v in own.items()])
    return complete(events.select(F.col("event_type").alias("metric"), tags.alias("tags"), key.alias("_key"), epoch_seconds("ts").alias("ts"), F.lit("FLOAT").alias("kind"), F.lit(None).cast("bigint").alias("int_value"), F.col("value").cast("float").alias("float_value"), F.col("event_id").alias("write_seq")), "_key")


def quantity_points(lineitem: DataFrame) -> DataFrame:
    """INT points of order lines by day, with many writes of one series and time; write_seq has the
    line's columns as digits, the value last, so that the latest write is the same everywhere."""
    tags = F.create_map(F.lit("cluster"), F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")), F.lit("linestatus"), F.col("l_linestatus"), F.lit("returnflag"), F.col("l_returnflag"))
    rows = lineitem.select(F.lit("lineitem.quantity").alias("metric"), tags.alias("tags"), epoch_seconds("l_shipdate").alias("ts"), F.lit("INT").alias("kind"), F.col("l_quantity").cast("bigint").alias("int_value"), F.lit(None).cast("float").alias("float_value"), sequence(("l_orderkey", 0), ("l_linenumber", 1), ("l_partkey", 11), ("l_suppkey", 10), ("l_quantity", 2)).alias("write_seq"))
    return rows.withColumns({"series_key": series_key(F.col("tags")), "value": widened(F.col("int_value"), F.col("float_value"))})
