"""Shared-folder tables, bucketed prefix sums and text scanning used by the operators."""

from __future__ import annotations

import contextlib
import gc
import math
import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds that settle() waits.
SETTLE_S = 1.2
SPACES = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that setting is absent, a temporary folder is made and set if the session runs on one
    machine (a local master); on a cluster, whose executors could not read it, that is an error.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not re.fullmatch("local(\\[.*\\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="chronofold-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


_NOTED: list[list[str]] = []


@contextlib.contextmanager
def noting(paths: list[str]):
    """Adds the scratch paths made within to the list."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED.pop()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _NOTED:
        paths.append(path)
    return path


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a table in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """A path without the scheme of local files."""
    return re.sub("^file:/+", "/", path)


def discard(table: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more; only folders in the shared one are touched."""
    remove(table.sparkSession, *{f.rsplit("/", 1)[0] for f in table.inputFiles()})


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders that lie in the shared one."""
    base = local_path(shared_dir(spark)) + "/"
    for folder in folders:
        if local_path(folder).startswith(base):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession, *folders: str) -> None:
    """After a written step: delete its scratch folders, and let Spark drop the shuffle files of
    plans that nothing refers to (it does so when the driver's garbage is collected)."""
    remove(spark, *folders)
    gc.collect()
    for wait in (SETTLE_S, SETTLE_S / 4):  # the gateway lets go of the driver's objects a second later
        time.sleep(wait)
        spark._jvm.java.lang.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def buckets_for(n_rows: int) -> int:
    """Buckets for prefix_sums: about the root of the rows, so that neither the rows of a bucket
    nor the buckets of a group pass a few hundred thousand even for 10**11 rows."""
    return max(1, math.ceil(2 * math.sqrt(n_rows)))


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], size: str) -> DataFrame:
    """Adds `before` (sum of size over earlier rows of the group) and `total` (of the group).

    Earlier is by (bucket, *order). One group may hold any share of the rows: rows meet only
    within (group, bucket), and only the sums of buckets meet within a group.
    """
    per = df.groupBy(*group, bucket).agg(F.sum(size).alias("_in_bucket"))
    w = Window.partitionBy(*group)
    per = per.withColumns({
        "_base": F.sum("_in_bucket").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)),
        "total": F.sum("_in_bucket").over(w),
    }).drop("_in_bucket")
    inner = F.sum(size).over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    left = df.withColumn("_inner", inner)
    per = per.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, bucket])], "_base", "total")
    on = [left[c].eqNullSafe(per[f"_k{i}"]) for i, c in enumerate([*group, bucket])]
    both = left.join(per, on, "left")
    zero = F.lit(0).cast("bigint")
    return both.withColumn("before", F.coalesce("_base", zero) + F.coalesce("_inner", zero)).select(*df.columns, "before", "total")


# ---- scanning texts in numpy -------------------------------------------------------------

#: An odd multiplier for polynomial hashes modulo 2**64, and its inverse.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, uint64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for p in (_P, _P_INV):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of uint64 values (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Byte tables: lower-case A-Z, and 1 where a byte belongs to a word.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM_WORD[_lo : _hi + 1] = False


class Words:
    """The words of several texts: hash of each word, and where each text's words begin.

    first[i]:first[i + 1] are the words of text i. Hashes are 64 bits of the lower-cased bytes.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.hashes, self.first = hashes, first


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """data: UTF-8 bytes of texts one after the other; offsets: where each begins, and the end."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    low = _LOWER[data[lo:hi]]
    n = hi - lo
    starts_at = (offsets - lo).astype(np.int64)
    if n == 0:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = is_word[low]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = starts_at[:-1][starts_at[:-1] < n]
    begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    cut = cut[cut > 0]
    stop[cut - 1] = inside[cut - 1]
    ends = np.flatnonzero(stop) + 1
    return Words(span_hashes(low, starts, ends), np.searchsorted(starts, starts_at))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans starts[i]:ends[i]."""
    n = len(raw)
    powers, inverse = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array; nulls count as empty."""
    import pyarrow as pa

    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    raw = np.frombuffer(buffers[1], np.int64 if wide else np.int32) if buffers[1] is not None else np.zeros(1, np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def runs_of(offsets: np.ndarray, most_bytes: int):
    """Slices (i, j) of texts holding about most_bytes each; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j

