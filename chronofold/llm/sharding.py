"""Hierarchical weighted hash tree: rows to shards with little movement when weights change.

A topology is a tree of regions, racks and shards. A row descends it: at each node every child
draws -ln(u) / weight, u being a hash of the row's key and the child's path, and the least draw
wins. A child's draw depends on the key, the path and that child's weight alone, so a change of
weight moves rows only into or out of the subtrees whose weights change. All DataFrame functions;
no shuffle for placement, and slots are ranked in small buckets so that a shard of any size is fine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. A leaf has a shard number and its own weight."""

    name: str
    shard: int | None = None
    own_weight: float = 1.0
    children: tuple["Node", ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def balanced(shards: int, regions: int = 2, racks: int = 2, weights: list[float] | None = None) -> Node:
    """A tree of `shards` numbered leaves dealt evenly over regions and racks."""
    per_rack = -(-shards // (regions * racks))
    leaves = [Node(f"s{i}", i, 1.0 if weights is None else weights[i]) for i in range(shards)]
    out = []
    for r in range(regions):
        inside = []
        for k in range(racks):
            at = (r * racks + k) * per_rack
            if own := tuple(leaves[at : at + per_rack]):
                inside.append(Node(f"k{k}", children=own))
        if inside:
            out.append(Node(f"r{r}", children=tuple(inside)))
    return Node("", children=tuple(out))


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """root with one more shard in a region and rack of its own: only the new subtree gains weight."""
    name = f"r{len(root.children)}"
    return Node(root.name, children=(*root.children, Node(name, children=(Node("k0", children=(Node(f"s{shard}", shard, weight),)),))))


def uniform(key: Column, path: str) -> Column:
    """In (0, 1): 52 bits of the MD5 of key and path."""
    hexed = F.substring(F.md5(F.concat(key, F.lit("|" + path)).cast("binary")), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def place(key: Column, node: Node, path: str = "") -> Column:
    """The shard number that a string key descends to."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"no weight under node {path!r}")
    paths = [f"{path}/{c.name}" for c in live]
    if len(live) == 1:
        return place(key, live[0], paths[0])
    draws = [F.struct((-F.ln(uniform(key, p)) / F.lit(float(c.weight))).alias("d"), F.lit(i).alias("i")) for i, (c, p) in enumerate(zip(live, paths))]
    if all(not c.children for c in live):
        return F.element_at(F.array(*[F.lit(c.shard) for c in live]), F.array_min(F.array(*draws))["i"] + 1)
    won = F.array_min(F.array(*draws))["i"]
    out = place(key, live[-1], paths[-1])
    for i in range(len(live) - 2, -1, -1):
        out = F.when(won == i, place(key, live[i], paths[i])).otherwise(out)
    return out


def ranked(df: DataFrame, group: str, key: str, order: list[str], n_rows: int) -> DataFrame:
    """Adds `slot`: gapless from 0 within each group, by a hash bucket of key and then by order."""
    n = common.buckets_for(n_rows)
    at = df.withColumns({"_bucket": F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(n)), "_one": F.lit(1).cast("bigint")})
    return common.prefix_sums(at, [group], "_bucket", order, "_one").withColumnRenamed("before", "slot").drop("_bucket", "_one", "total")


def shard(docs: DataFrame, shards: int = 16, topology: Node | None = None) -> DataFrame:
    """Place every row of docs(doc_id, text, ...) by its doc_id.

    Returns doc_id, size (UTF-8 bytes and 1), text_crc32, law ('key'), shard, slot, grown_shard
    (the shard with one more). Null ids share the key of the empty text and so a shard; repeated
    ids share a shard and get a slot each; a null text has size 1 and the crc32 of no bytes.
    Other columns of docs are ignored. An empty table gives an empty result.
    """
    root = topology or balanced(shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body).cast("bigint") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"), place(key, root).cast("int").alias("shard"), place(key, grown(root, shards)).cast("int").alias("grown_shard"))
    rows = common.written(rows, "shards")
    return ranked(rows, "shard", "doc_id", ["doc_id", "text_crc32", "size"], rows.count()).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
