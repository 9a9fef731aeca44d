"""Connected components of distributed edges by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Edges that one task may finish (16 bytes each, and a dictionary of their nodes).
MOST_IN_TASK = 400_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b): root is the least node that it reaches.

    Each round hangs neighbours on the least one they know (larger neighbours, then smaller ones)
    and is written to the shared folder; rounds grow with the logarithm of the diameter. Minima are
    combined before shuffling, so a hub of any degree is fine. Once MOST_IN_TASK edges are left at
    most, one task finishes them by union-find. Self-loops and repeated edges do no harm; null ends
    are left out.
    """
    own = edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    current = common.written(own, "links")
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= MOST_IN_TASK:
            return finished(current)
        if state == before:
            return nodes(current)
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        out = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        done = current
        current = common.written(out.distinct(), "links")
        common.discard(done)


def finished(edges: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of edges (u, v), by union-find in one task."""

    def run(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(u), root(v)
                if x != y:
                    up[max(x, y)] = min(x, y)
        known = list(up)
        for i in range(0, len(known), 50_000):
            own = known[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([root(x) for x in own], pa.int64())], ["node", "root"])

    return common.written(edges.coalesce(1).mapInArrow(run, "node bigint, root bigint"), "roots")


def nodes(stars: DataFrame) -> DataFrame:
    """(node, root) from edges that all lead to roots."""
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
