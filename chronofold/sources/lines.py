"""Sources of points: line files (plain or compressed), sockets, JSON bodies, Kafka topics."""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing


def read(spark: SparkSession, path: str) -> DataFrame:
    """`put` lines of text files; Spark reads gzip, deflate, bzip2 and snappy by their suffix."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def stream_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumnRenamed("value", "line")


def stream_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumnRenamed("value", "line")


def kafka_rows(points: DataFrame) -> DataFrame:
    """key, value of points for a topic: the series as key, so that one partition keeps a series in order."""
    return parsing.to_lines(points).select(F.col("series_key").cast("binary").alias("key"), F.col("line").cast("binary").alias("value"))


def to_kafka(points: DataFrame, servers: str, topic: str) -> None:
    """Send points to a topic (a batch's sink). Needs Spark's Kafka package, as kafka() does."""
    kafka_rows(points).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True, start: str = "earliest", end: str = "latest", most_per_trigger: int | None = None, **options) -> DataFrame:
    """Values of a topic as lines, from `start`; a batch read goes to `end`; most_per_trigger limits
    the offsets of a micro-batch. Needs Spark's Kafka package on the class path; without it this
    raises what Spark raises."""
    if most_per_trigger and streaming:
        options["maxOffsetsPerTrigger"] = most_per_trigger
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start)
    reader = reader if streaming else reader.option("endingOffsets", end)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select(F.col("value").cast("string").alias("line"))


def received(connection, size: int = 65_536) -> Iterator[bytes]:
    """Chunks of a connected socket until the other side closes it."""
    while chunk := connection.recv(size):
        yield chunk


def land(lines: Iterable[str], folder: str, lines_per_file: int = 10_000) -> int:
    """Write lines as they come to files that stream_files reads; a file appears whole, under its
    final name, once it is full or the lines end. Returns the number of files. With
    inflated(received(socket)) it is the compressed socket source."""
    os.makedirs(folder, exist_ok=True)
    n, rows = 0, iter(lines)
    while own := list(itertools.islice(rows, lines_per_file)):
        name = f"{uuid.uuid4().hex}.txt"
        with open(f"{folder}/.{name}", "w") as out:
            out.writelines(f"{x}\n" for x in own)
        os.rename(f"{folder}/.{name}", f"{folder}/{name}")
        n += 1
    return n


def inflated(chunks: Iterable[bytes], most: int = 2048) -> Iterator[str]:
    """Lines of a raw or zlib deflate stream that arrives in chunks of any size; a line longer than
    `most` bytes raises ValueError."""
    unzip, rest = None, b""
    for chunk in chunks:
        if unzip is None and chunk:
            unzip = zlib.decompressobj() if chunk[:1] == b"\x78" else zlib.decompressobj(-15)
        *lines, rest = (rest + (unzip.decompress(chunk) if unzip else b"")).split(b"\n")
        for line in lines:
            if len(line) > most:
                raise ValueError("line too long")
            yield line.removesuffix(b"\r").decode()
        if len(rest) > most:
            raise ValueError("line too long")
    if rest:
        yield rest.removesuffix(b"\r").decode()
