"""A training-data pipeline: each stage takes what its predecessor kept, as documents.

Every stage judges each row by its own text: rows are told apart by a key of doc_id and text, so
repeated or null ids share nothing. Extra columns, whatever their names, pass through unchanged up
to the last stage, which returns the placement alone. Equal rows (of one id and text) are one
document. A stage over an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import common, decontamination, jaccard, language, mixing, sharding

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Scratch folders of the stage before.
_MADE: list[str] = []


def stage(f):
    """A stage that first deletes the scratch tables of the stage before, whose result was written
    and is read again by now; what `docs` itself reads stays."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        in_use = {common.local_path(x.rsplit("/", 1)[0]) for x in docs.inputFiles()}
        common.settle(spark, *(x for x in _MADE if common.local_path(x) not in in_use))
        _MADE.clear()
        with common.noting(_MADE):
            return f(spark, docs, sf_dir)

    return run_stage


def row_key() -> Column:
    """64 bits of a row's doc_id and text (nulls count as values)."""
    return F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull())


@stage
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejected documents go (null, no letter, or a score under the calibrated level)."""
    names = common.fresh(docs, "lang_pred", "score", "rejected")
    return language.predict(docs, language.fit(docs), names).filter(~F.col(names[2])).select(*common.columns(docs))


@stage
def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join of 5-word shingles at 0.8: of each component the document of the
    smallest id stays (null last, ties by the key), and of equal rows one. Documents without words
    link with nothing: each that differs in id or text stays."""
    key, twin = common.fresh(docs, "key", "twin")
    ids = docs.select(row_key().alias("doc_id"), F.col("doc_id").alias("id"), "text")
    group = jaccard.join(ids, size=5, near=80).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct()
    named = ids.select(F.col("doc_id").alias("key"), "id").distinct().join(group, "key")
    best = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("best")).select(F.col("best.key").alias(key))
    kept = docs.withColumn(key, row_key()).join(best, key, "left_semi").withColumn(twin, F.xxhash64(F.lit(1), "text", "doc_id"))
    return kept.dropDuplicates([key, twin]).select(*common.columns(docs))


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents (a twentieth of the words hit) go."""
    (key,) = common.fresh(docs, "key")
    found = decontamination.digest(decontamination.decontaminate(docs.select(row_key().alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark")))
    bad = found.filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(*common.columns(docs))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources: a document is repeated as often as the mix takes it, to the nearest whole
    number; what the mix takes less than half of is left out. Documents without words stay once."""
    key, times, copy = common.fresh(docs, "key", "times", "copy")
    taken = mixing.mix(docs.select(row_key().alias("doc_id"), "text", "source"))
    taken = taken.select(F.col("doc_id").alias(key), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias(times))
    taken = taken.groupBy(key).agg(F.max(times).alias(times))
    repeated = docs.withColumn(key, row_key()).join(taken, key).filter(F.col(times) > 0)
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*common.columns(docs))


@stage
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: the final placement of every row."""
    return sharding.shard(docs)


STAGES = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can express neither the language model nor crc32; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        before, docs = docs, common.written(function(spark, docs, sf_dir), f"stage-{name}")
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
