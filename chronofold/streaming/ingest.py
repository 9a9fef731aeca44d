"""Structured Streaming: lines to stored points with fail-over, replay of the drop, rollups, meters."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import parsing
from ..operators import rollup

Sink = Callable[[DataFrame, int], None]


def parquet_sink(path: str) -> Sink:
    """Each batch in a folder of its own, overwritten if the batch comes again: a replay adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def black_hole(batch: DataFrame, batch_id: int) -> None:
    batch.write.format("noop").mode("overwrite").save()


def failing(batch: DataFrame, batch_id: int) -> None:
    raise RuntimeError("this sink always fails")


def failover(main: Sink, drop: Sink, to_drop=None) -> Sink:
    """Rows that to_drop (a column) selects go to drop, others to main and, if that fails, to drop.
    A sink replaces what it had of a batch, so the drop then gets the whole batch. If drop fails too,
    so does the batch: the stream stops and comes back to it from its checkpoint."""

    def send(batch: DataFrame, batch_id: int) -> None:
        rest = batch
        if to_drop is not None:
            chosen = F.coalesce(to_drop, F.lit(False))
            drop(batch.filter(chosen), batch_id)
            rest = batch.filter(~chosen)
        try:
            main(rest, batch_id)
        except Exception:
            drop(batch, batch_id)

    return send


def write_seq(batch_id: int):
    """A batch's number, then a row's place in it: whole, so that no two rows of any partitions agree."""
    return (F.lit(batch_id).cast("decimal(18,0)") * F.lit(str(1 << 63)).cast("decimal(20,0)") + F.monotonically_increasing_id().cast("decimal(20,0)")).cast(model.SEQUENCE)


def ingest(lines: DataFrame, main: Sink, drop: Sink, quarantine: Sink, checkpoint: str, to_drop=None, trigger: dict | None = None):
    """Start a query that parses lines, sends valid points to main or drop and others to quarantine.

    Points carry write_seq (batch, then place), so that later batches win; delivery is at least
    once, and last_write makes it idempotent.
    """
    send = failover(main, drop, to_drop)

    def batch(rows: DataFrame, batch_id: int) -> None:
        parsed = parsing.parse_lines(rows).withColumn("write_seq", write_seq(batch_id)).persist()
        try:
            valid, bad = parsing.split_valid(parsed)
            quarantine(bad.select("line", "error"), batch_id)
            send(valid.withColumn("value", model.widened(F.col("int_value"), F.col("float_value"))), batch_id)
        finally:
            parsed.unpersist()

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def replay(spark, drop: str, main: Sink, checkpoint: str):
    """Start a query that brings what fail-over left in the drop (a parquet_sink's folder) into main,
    each batch once: what a run has replayed its checkpoint remembers, and what main refuses is
    tried again by the next run. One run at a time holds the checkpoint's lock."""
    held = f"{checkpoint}/replaying"
    files = spark._jvm.org.apache.hadoop.fs.Path(held)
    store = files.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.createNewFile(files):
        raise RuntimeError(f"another replay runs, or one was cut off: {held}")
    store.deleteOnExit(files)
    schema = spark.read.parquet(drop).schema
    rows = spark.readStream.schema(schema).parquet(drop)
    try:
        query = rows.drop("batch").writeStream.foreachBatch(main).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        store.delete(files, False)
    return query


def supervised(start, retries: int = 5, first_wait: float = 1.0, most_wait: float = 60.0, sleep=time.sleep) -> int:
    """Run a query from its checkpoint until it ends well; after a failure wait, twice as long each
    time. start() returns a started query. Returns how often it was started again."""
    for k in range(retries + 1):
        try:
            start().awaitTermination()
            return k
        except Exception:
            if k == retries:
                raise
            sleep(min(most_wait, first_wait * 2**k))
    return retries


def meters(query) -> dict[str, float]:
    """Of a query's recent batches: their number, rows, rows a second, and the median and 95th
    percentile of a batch's milliseconds."""
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    took = sorted(p["durationMs"].get("triggerExecution", 0) for p in batches)
    rows = sum(p["numInputRows"] for p in batches)
    return {"batches": len(batches), "rows": rows, "rows_per_second": rows * 1000 / max(1, sum(took)), "median_ms": median(took) if took else 0.0, "p95_ms": took[-(-95 * len(took) // 100) - 1] if took else 0.0}


def counted(parsed: DataFrame, name: str = "points") -> tuple[DataFrame, object]:
    """parsed points, and an observation that counts them by kind and the rejected while they pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    kinds = ("INT", "FLOAT", "INT_LIST", "FLOAT_LIST")
    bad = F.col("error").isNotNull()
    return parsed.observe(seen, F.count("*").alias("all"), F.count_if(bad).alias("rejected"), *[F.count_if(~bad & (F.col("kind") == k)).alias(k.lower()) for k in kinds]), seen


def deduplicated(points: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream's points without repeats of one series and time within the delay."""
    timed = points.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["metric", "series_key", "ts"]).drop("event_time")


def rollup_stream(points: DataFrame, resolution: int = rollup.MINUTE5, delay: str = "1 hour") -> DataFrame:
    """metric, series_key, ts, max, min, sum, avg of finished buckets. Later points are not in it:
    they belong to storage, and the next batch rollup counts them."""
    timed = points.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    out = timed.groupBy("metric", "series_key", F.window("event_time", f"{resolution} seconds")).agg(*[getattr(F, a)("value").cast("float").cast("double").alias(a) for a in rollup.AGGREGATES])
    return out.select("metric", "series_key", F.unix_seconds("window.start").alias("ts"), *rollup.AGGREGATES)


def lag(written: DataFrame, read: DataFrame) -> DataFrame:
    """total and max of unread offsets from (partition, offset) tables."""
    both = written.withColumnRenamed("offset", "_w").join(read.withColumnRenamed("offset", "_r"), "partition", "full_outer")
    behind = F.coalesce("_w", F.lit(0)) - F.coalesce("_r", F.lit(0))
    return both.agg(F.coalesce(F.sum(behind), F.lit(0)).alias("total"), F.coalesce(F.max(behind), F.lit(0)).alias("max"))
