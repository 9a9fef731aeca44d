"""Names, suggestions and health checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import filters

LIMIT = 25
#: Latest generations that suggestions look into.
GENERATIONS = 3
KINDS = {"metrics": "metric", "tagk": "tagk", "tagv": "tagv"}
#: The share of tag values that may vanish between two windows.
MOST_LOST = 0.3


def names(points: DataFrame) -> DataFrame:
    """Distinct (generation, kind, name) of metrics, tag names and tag values."""
    generation = F.col("generation") if "generation" in points.columns else F.lit(0)
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    metric = F.array(entry("metric", F.col("metric")))
    keys = F.transform(F.map_keys("tags"), lambda k: entry("tagk", k))
    values = F.transform(F.map_values("tags"), lambda v: entry("tagv", v))
    return points.select(generation.alias("generation"), F.explode(F.concat(metric, keys, values)).alias("n")).select("generation", "n.kind", "n.name").distinct()


def suggest(known: DataFrame, prefix: str, kind: str, limit: int = LIMIT) -> DataFrame:
    """name, in order: the first `limit` names of each of the latest generations that begin so."""
    own = known.filter((F.col("kind") == KINDS.get(kind, kind)) & F.col("name").startswith(prefix))
    latest = [r.generation for r in known.select("generation").distinct().orderBy(F.desc("generation")).limit(GENERATIONS).collect()]
    w = Window.partitionBy("generation").orderBy("name")
    ranked = own.filter(F.col("generation").isin(latest)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    return ranked.select("name").distinct().orderBy("name")


def unregistered(found: DataFrame, known: DataFrame) -> DataFrame:
    """Names that are not yet in known: append them to register them."""
    return found.join(known, ["generation", "kind", "name"], "left_anti")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """The stored dimension of names: (generation, kind, name); empty before the first name."""
    schema = "name string, generation int, kind string"
    try:
        return spark.read.schema(schema).parquet(path).select("generation", "kind", "name")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).select("generation", "kind", "name")


def register(points: DataFrame, path: str) -> None:
    """Append the names of points that the stored dimension lacks: only what is new is written, so
    a suggestion reads names, not points."""
    new = unregistered(names(points).select(F.col("generation").cast("int").alias("generation"), "kind", "name"), read_names(points.sparkSession, path))
    new.repartition("generation", "kind").write.mode("append").partitionBy("generation", "kind").parquet(path)


def distinct_values(points: DataFrame, tag: str) -> DataFrame:
    return points.filter(F.col("tags")[tag].isNotNull()).agg(F.countDistinct(F.col("tags")[tag]).alias("n"))


def health(points: DataFrame, metric: str, fixed: list[filters.TagFilter], tag: str, now: int, interval: int) -> DataFrame:
    """count1, count2, healthy: values of a tag in [now - 3i, now - 2i) and in [now - 2i, now - i);
    healthy while less than MOST_LOST of them went. None in the first window is not healthy."""
    own = filters.select(points, metric, now - 3 * interval, now - interval, fixed)
    value = F.col("tags")[tag]
    early = F.col("ts") < now - 2 * interval
    counts = own.agg(F.countDistinct(F.when(early, value)).alias("count1"), F.countDistinct(F.when(~early, value)).alias("count2"))
    lost = F.try_divide(F.col("count1") - F.col("count2"), F.col("count1"))
    return counts.withColumn("healthy", F.coalesce(lost < MOST_LOST, F.lit(False)))


def error_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("error").agg(F.count("*").alias("n"))
