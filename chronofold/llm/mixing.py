"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Slots of equal numbers of words are dealt to sources by van der Corput points: slot k of 2**bits
has the point whose binary digits are those of k, reversed, a whole number below 2**bits. Each
point is taken exactly once, so a source whose interval of the cumulative weights is n points wide
gets exactly n slots, at any size, and any run of slots holds its share of each source to within
the sequence's discrepancy. A slot's rank among its source's slots tells which block of that source
it takes. A source's documents,
shuffled by a hash, form a stream that repeats for each epoch; block r is its words
[r * block, (r + 1) * block). Joining slots with blocks gives what the mix takes from a document.
Prefix sums go by hash buckets, so a source of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Words in a slot.
BLOCK_WORDS = 4096
#: No document is taken more often.
MAX_EPOCHS = 3
#: Cells of the points, by which they meet intervals: a power of two, as a power of two.
CELL_BITS = 12


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.SPACES)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """From (source, source_size): weight, target, quota (whole words) and n_slots of each source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. They share the sum of all
    sizes; a target stops at MAX_EPOCHS times its source's size and the excess is shared again.
    With sources by falling need of the cap, the final level is the greatest of the levels
    (what is left) / (weights left).
    """
    cap = F.lit(MAX_EPOCHS) * F.col("source_size")
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), "source")
    ix = F.row_number().over(by_name).cast("int")
    s = sources.select("source", "source_size", (ix - 1).alias("source_ix")).withColumn("weight", (F.col("source_ix") % 3 + 1).cast("bigint"))
    by_need = everything.orderBy(cap / F.col("weight"), "source_ix")
    left = F.sum("source_size").over(everything) - (F.sum(cap).over(by_need) - cap)
    weights = F.sum("weight").over(everything) - (F.sum("weight").over(by_need) - F.col("weight"))
    s = s.withColumn("_level", left.cast("double") / weights)
    s = s.withColumn("_level", F.max("_level").over(everything))
    s = s.withColumn("target", F.least(cap.cast("double"), F.col("_level") * F.col("weight"))).drop("_level")
    s = s.withColumn("quota", F.floor(F.col("target") + 0.5))
    return s.withColumn("n_slots", F.ceil(F.col("quota") / F.lit(block_words)).cast("bigint"))


def reversed_bits(k: Column, bits: int) -> Column:
    """The lowest `bits` binary digits of k in reverse (at most 62)."""
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("bigint")


def bits_for(total: int) -> int:
    """Points are 2**bits, the least power of two that holds all slots."""
    return max(1, (max(total, 1) - 1).bit_length())


def dealt(points: DataFrame, sources: DataFrame, bits: int) -> DataFrame:
    """(slot, source_ix) of points(id): the source in whose interval, n_slots wide, the slot's point
    lies; points past the last interval belong to none. The intervals' running sum needs all
    sources in one place: a row for each source, which is the bound of this step."""
    cells = min(CELL_BITS, bits)
    down = bits - cells
    at = points.withColumn("_u", reversed_bits(F.col("id"), bits)).select(F.col("id").alias("slot"), "_u", F.shiftrightunsigned("_u", down).alias("_cell"))
    w = Window.partitionBy(F.lit(0)).orderBy("source_ix")
    ends = sources.filter("n_slots > 0").withColumn("_hi", F.sum("n_slots").over(w)).select("source_ix", (F.col("_hi") - F.col("n_slots")).alias("_lo"), "_hi")
    wide = ends.withColumn("_cell", F.explode(F.sequence(F.shiftrightunsigned("_lo", down), F.shiftrightunsigned(F.col("_hi") - 1, down))))
    return at.join(wide, "_cell").filter("_u >= _lo and _u < _hi").select("slot", "source_ix")


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, source_ix, rank): exactly n_slots of every source, spread evenly over the slots."""
    total = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    bits = bits_for(total)
    slots = dealt(sources.sparkSession.range(1 << bits if total else 0), sources, bits)
    n = common.buckets_for(1 << bits)
    own = slots.withColumns({"_bucket": F.shiftrightunsigned("slot", max(0, bits - (n.bit_length() - 1))), "_one": F.lit(1).cast("bigint")})
    return common.prefix_sums(own, ["source_ix"], "_bucket", ["slot"], "_one").select("slot", "source_ix", F.col("before").alias("rank"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What the mix takes from every row of docs(doc_id, text, source, ...).

    Returns doc_id, source, size (words), source_size, target, taken (words, repeats counted).
    A source's taken words sum to its target rounded; no row gives more than MAX_EPOCHS times its
    size, and an empty or null text gives 0. Null is a source of its own. Repeated rows count
    as rows; ties in the shuffle go by doc_id and size, so reruns agree. Other columns are ignored.
    """
    rows = common.written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_h")), "mix-sizes")
    n = common.buckets_for(rows.count())
    source = common.written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), block_words), "mix-sources")
    slots = common.written(schedule(source), "mix-slots")
    at = rows.withColumns({"_bucket": F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") * F.lit(n) / F.lit(1 << 32)), "_i": F.monotonically_increasing_id()})
    stream = common.prefix_sums(at, ["source"], "_bucket", ["_h", "doc_id", "size", "_i"], "size").drop("_bucket", "_h", "total")
    keyed = source.select(F.col("source").alias("_source"), "source_ix", "source_size", "target", "quota")
    stream = stream.join(keyed, stream["source"].eqNullSafe(keyed["_source"])).drop("_source")
    stream = common.written(stream, "mix-stream")
    epochs = stream.filter("size > 0").withColumn("_from", F.explode(F.expr(f"transform(sequence(0, {MAX_EPOCHS - 1}), e -> before + e * source_size)"))).filter("_from < quota")
    epochs = epochs.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("quota")))
    blocks = epochs.withColumn("rank", F.explode(F.expr(f"sequence(_from div {block_words}, (_to - 1) div {block_words})")))
    taken = blocks.join(slots, ["source_ix", "rank"]).select("_i", (F.least(F.col("_to"), (F.col("rank") + 1) * block_words) - F.greatest(F.col("_from"), F.col("rank") * block_words)).alias("_words"))
    taken = taken.groupBy("_i").agg(F.sum("_words").alias("taken"))
    return stream.join(taken, "_i", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS ix
  FROM d GROUP BY source
), w AS (SELECT *, (ix % 3 + 1)::BIGINT AS weight, ({MAX_EPOCHS} * source_size)::BIGINT AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER need - cap))::DOUBLE
            / (sum(weight) OVER () - (sum(weight) OVER need - weight))::DOUBLE AS level
  FROM w WINDOW need AS (ORDER BY cap::DOUBLE / weight::DOUBLE, ix ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l
), p AS (
  SELECT doc_id, d.source, size, source_size, target, floor(target + 0.5)::BIGINT AS quota,
         (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, quota - before)) + least(size, greatest(0, quota - before - source_size))
        + least(size, greatest(0, quota - before - 2 * source_size)))::BIGINT AS taken
FROM p
"""
