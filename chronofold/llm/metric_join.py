"""Exact metric range join of embeddings.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so links are pairs within a radius r. Each
label's vectors go to the cell of their nearest pivot; a label of n vectors has about sqrt(n)
pivots. If y lies in cell j and x in cell i, the triangle inequality puts x within d(x, y) of the
plane half-way between pivots i and j, at (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)); so x is
copied to the later cells j whose plane is within r, and cells join independently. In a cell,
pairs of two copies are left to other cells, and the distances to a few more pivots leave out
pairs that differ by more than r in one of them. A cell larger than CHUNK vectors is compared in
tiles of two chunks, and a tile returns counts and a forest of its links, never its pairs. Equal
vectors of a label are one node with a multiplicity.

Copies grow with the number of cells that a vector's reach touches, so a second level merges cells
into groups: pivots are dealt to groups of near pivots, and a vector is copied once for each later
group that it may reach.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, components

COSINE = 0.93
#: Vectors that a group of cells holds at least, on average, and rows with copies at most; bytes of all pivots, which are broadcast (labels
#: of the most vectors first; a label without pivots is one cell, in tiles); pivots whose distances
#: leave out pairs; candidates for a pivot, and pivots that are chosen far apart.
CELL = 256
MOST_ROWS = 3
PIVOT_BYTES = 64 << 20
WITNESSES = 8
DRAWN, FARTHEST = 4, 1024
CHUNK = 4096
#: Vectors that are compared with all pivots at once.
BATCH = 1024
#: Slack for rounding in the cells' bound; links themselves are decided by the cosine alone.
SLACK = 1e-6


def _unit(raw: list[bytes]) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes(vectors: DataFrame) -> DataFrame:
    """(label, vec_id, copies, v, dims): one row for each distinct usable vector of a label, with
    its least vec_id; v holds its doubles."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                raw = [np.array(x, np.float64) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int32())], ["label", "vec_id", "v", "dims"])

    usable = vectors.select(F.col("label").cast("bigint").alias("label"), F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("e"))
    usable = usable.filter("label is not null and vec_id is not null and e is not null").filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0))
    packed = usable.mapInArrow(pack, "label bigint, vec_id bigint, v binary, dims int")
    return packed.groupBy("label", "dims", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))


@dataclass
class Pivots:
    """A label's unit pivots, in order of their groups, and the group of each."""

    at: np.ndarray
    group: np.ndarray


def spread(x: np.ndarray, n: int) -> list[int]:
    """Up to n rows, each the farthest from those before it; FARTHEST at most, then the rest in order."""
    out, apart = [0], 2 - 2 * x @ x[0]
    while len(out) < min(n, len(x), FARTHEST):
        out.append(int(apart.argmax()))
        apart = np.minimum(apart, 2 - 2 * x @ x[out[-1]])
    chosen = set(out)
    return out + [i for i in range(len(x)) if i not in chosen][: max(0, min(n, len(x)) - len(out))]


def grouped(drawn: np.ndarray, n: int, radius: float) -> Pivots:
    """About sqrt(n) of the drawn vectors, far apart so that clusters have one. The first ones head a
    group each, and every pivot goes to that of the nearest head; of 1, 2, 4 ... groups those are
    taken that leave the fewest pairs to compare, as the drawn vectors tell, without more than
    MOST_ROWS times the rows. Where vectors have no clusters that may be one group for all."""
    p = drawn[spread(drawn, math.isqrt(n) + 1)]
    best, share, k = Pivots(p, np.zeros(len(p), np.int64)), 1.0, 2
    while k <= min(len(p), -(-n // CELL)):
        own = (p @ p[:k].T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        tried = Pivots(p[order], own[order])
        home, _, other = reached(drawn, tried, radius)
        held = np.bincount(home, minlength=k) + np.bincount(other, minlength=k)
        if held.sum() <= MOST_ROWS * len(drawn) and (held / len(drawn) @ held / len(drawn)) < share:
            best, share = tried, float(held / len(drawn) @ held / len(drawn))
        k *= 2
    return best


def pivots(points: DataFrame, radius: float) -> dict[tuple[int, int], Pivots]:
    """Pivots of the labels (and dimensions): about sqrt(n) of a label's n nodes, from DRAWN times
    as many drawn by a hash, PIVOT_BYTES in all at most. Of too many labels the largest get pivots,
    all that fit."""
    sizes = points.groupBy("label", "dims").count()
    wanted = F.ceil(DRAWN * F.sqrt(F.col("count")))
    w = Window.orderBy(F.desc("count"), "label", "dims").rowsBetween(Window.unboundedPreceding, 0)
    kept = sizes.withColumns({"wanted": wanted, "bytes": F.sum(wanted * F.col("dims") * 8).over(w)}).filter((F.col("bytes") <= PIVOT_BYTES) & (F.col("count") > 2))
    share = F.least(F.lit(1.0), F.col("wanted") / F.col("count"))
    kept = common.written(kept.select(F.col("label").alias("_l"), F.col("dims").alias("_d"), share.alias("share"), "count"), "pivot-labels")
    u = F.pmod(F.xxhash64(F.lit("pivot"), "vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = points.join(kept, (F.col("label") == F.col("_l")) & (F.col("dims") == F.col("_d"))).filter(u < F.col("share")).select("label", "dims", "vec_id", "v", "count").collect()
    out: dict[tuple[int, int], list] = {}
    for r in sorted(drawn, key=lambda r: (r.label, r.dims, r.vec_id)):
        out.setdefault((r.label, r.dims), []).append(r)
    return {k: grouped(_unit([bytes(r.v) for r in rows]), rows[0]["count"], radius) for k, rows in out.items()}


def reached(x: np.ndarray, p: Pivots, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors x: the group of each one's nearest pivot; (vector, group) of the later groups
    with a cell that may hold something within the radius of it."""
    square = np.maximum(0, 2 - 2 * x @ p.at.T)
    home = square.argmin(axis=1)
    between = np.sqrt(np.maximum(0, 2 - 2 * p.at[home] @ p.at.T))
    near = square - square[np.arange(len(x)), home][:, None] <= 2 * between * (radius + SLACK)
    first = np.flatnonzero(np.diff(p.group, prepend=-1))
    groups = p.group[first]
    near = np.logical_or.reduceat(near, first, axis=1) & (groups > p.group[home][:, None])
    i, j = np.nonzero(near)
    return p.group[home], i, groups[j]


def celled(points: DataFrame, radius: float) -> DataFrame:
    """points with cell (a group of pivots' cells) and own: in their own cell, and as copies in
    later cells within reach; and near, the distances to the label's first WITNESSES pivots."""
    sent = points.sparkSession.sparkContext.broadcast(pivots(points, radius))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                label, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                kinds, which = np.unique(np.stack([label, dims.astype(np.int64)], axis=1), axis=0, return_inverse=True)
                for k, kind in enumerate(kinds):
                    rows = np.flatnonzero(which.ravel() == k)
                    p = sent.value.get((int(kind[0]), int(kind[1])))
                    x = _unit(batch.column(2).take(pa.array(rows)).to_pylist())
                    if p is None:
                        home, i, j = np.zeros(len(rows), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                        near = np.zeros((len(rows), 1))
                    else:
                        home, i, j = reached(x, p, radius)
                        pick = np.linspace(0, len(p.at) - 1, min(WITNESSES, len(p.at))).astype(np.int64)
                        near = np.sqrt(np.maximum(0, 2 - 2 * x @ p.at[pick].T))
                    at, cell = np.concatenate([np.arange(len(rows)), i]), np.concatenate([home, j]).astype(np.int32)
                    own = np.arange(len(at)) < len(rows)
                    for a in range(0, len(at), 2000):
                        s = slice(a, a + 2000)
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows[at[s]])).columns, pa.array(cell[s]), pa.array(own[s]), pa.array([d.tobytes() for d in near[at[s]]], pa.binary())], ["label", "dims", "v", "vec_id", "copies", "cell", "own", "near"])

    return points.select("label", "dims", "v", "vec_id", "copies").mapInArrow(run, "label bigint, dims int, v binary, vec_id bigint, copies bigint, cell int, own boolean, near binary")


def replication(cells: DataFrame) -> DataFrame:
    """label, dims, vectors, copies, cells, compared: how many vectors a label has, how many more
    rows its cells hold, and the share of its pairs that lie in one cell: what the pivots prune."""
    size = cells.groupBy("label", "dims", "cell").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return size.groupBy("label", "dims").agg(F.sum("own").alias("vectors"), (F.sum("n") - F.sum("own")).alias("copies"), F.count("*").alias("cells"), F.try_divide(pairs, F.sum("own") * (F.sum("own") - 1) / 2).alias("compared"))


def tiles(cells: DataFrame, cosine: float) -> DataFrame:
    """Rows of a tile are in order of their distance to the first witness, so blocks of rows whose
    distances to any witness lie further apart than the radius are not compared at all. (a, b, n): for each node and tile the linked vectors (b null), and a forest of links (n null)."""
    size = cells.groupBy("label", "dims", "cell").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("c"))
    rows = cells.join(size, ["label", "dims", "cell"]).withColumn("i", F.pmod(F.xxhash64("vec_id"), F.col("c")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.expr("sequence(0, c - 1)")))
    rows = rows.select("label", "dims", "cell", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "vec_id", "copies", "own", "v", "near")
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK

    def tile(frame):
        import pandas as pd

        from .jaccard import Forest

        away = np.frombuffer(b"".join(frame["near"]), np.float64).reshape(len(frame), -1)
        order = np.lexsort((frame["vec_id"].to_numpy(), away[:, 0]))
        frame, away = frame.iloc[order], away[order]
        ids, copies, own, side = (frame[c].to_numpy() for c in ("vec_id", "copies", "own", "i"))
        unit, forest = _unit(list(frame["v"])), Forest(len(ids))
        alike = side.min() == side.max()
        n, links = np.zeros(len(ids), np.int64), []
        blocks = [(s, min(len(ids), s + 256)) for s in range(0, len(ids), 256)]
        low, high = (np.array([f(away[a:b], axis=0) for a, b in blocks]) for f in (np.min, np.max))
        todo = ((k, m) for k in range(len(blocks)) for m in range(k, len(blocks)) if ((low[m] <= high[k] + reach) & (low[k] <= high[m] + reach)).all())
        for k, m in todo:
            part, other = np.arange(*blocks[k]), np.arange(*blocks[m])
            near = unit[part] @ unit[other].T >= cosine
            near &= (other > part[:, None]) & (own[part][:, None] | own[other])
            if not alike:
                near &= side[part][:, None] != side[other]
            i, j = np.nonzero(near)
            i, j = part[i], other[j]
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            for a, b in zip(i.tolist(), j.tolist()):
                x, y = forest.root(a), forest.root(b)
                if x != y:
                    forest.up[max(x, y)] = min(x, y)
                    links.append((ids[a], ids[b], None))
        some = np.flatnonzero(n)
        out = [(ids[k], None, int(n[k])) for k in some] + links
        return pd.DataFrame({c: pd.array([o[k] for o in out], dtype="Int64") for k, c in enumerate("abn")})

    return rows.groupBy("label", "dims", "cell", "x", "y").applyInPandas(tile, "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links and components of vectors(vec_id, embedding, label, ...) by cosine within a label.

    Returns vec_id, n_links, component_id, kept for every row. A vector that is null, empty, zero
    or holds null or non-finite components, or whose label is null, links with nothing; vectors of
    unlike dimensions don't link. Equal vectors of a label are linked. Rows are told apart by
    vec_id, which should be unique; a null vec_id has no links and a null component. Other columns
    are ignored. An empty table gives an empty result.
    """
    points = common.written(nodes(vectors), "vectors")
    cells = common.written(celled(points, float(np.sqrt(2 - 2 * cosine))), "cells")
    found = common.written(tiles(cells, cosine), "near")
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components.components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "_node")
    labelled = points.select("label", "dims", "v", F.col("vec_id").alias("node"), "copies").join(counts, "node", "left").join(roots, F.col("node") == F.col("_node"), "left")
    labelled = labelled.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    # equal vectors are told by 128 bits of their components, not by moving arrays
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    member = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.when(e.isNotNull(), F.xxhash64(F.lit(1), e)).alias("h"), F.xxhash64(F.lit(2), F.size(e), F.reverse(e)).alias("k"))
    least = member.filter("label is not null and vec_id is not null and h is not null").groupBy("label", "h", "k").agg(F.min("vec_id").alias("node"))
    own = member.join(least, ["label", "h", "k"], "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("node")).alias("node")).join(labelled, "node", "left")
    return own.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND coalesce(len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding), false)
         AND coalesce(len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE x.ok AND y.ok AND list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= {COSINE}
), r(vec_id, m) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.vec_id WHERE r.m < l.b
), c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n ON n.a = v.vec_id
"""
