"""N-gram Jaccard join by parity sketches.

A document's distinct word shingles are XOR-hashed into a bit sketch: each shingle toggles one
bit, so the Hamming distance of two sketches is at most the symmetric difference of the sets.
Sets of J >= t whose sizes lie in one band differ in at most D shingles, D known from the band.
The sketch of a band is cut into D + 1 + x blocks: of two such sets, x + 1 blocks at least are
equal. A block is keyed by the XOR of its toggled bits' codes, and equal keys are joined. Each set
leaves out x blocks, those with the fewest shingles, which unlike sets share most; the order is by
content alone, so of the equal blocks the two sets leave out nested parts, x at most, and one
remains. Joined pairs pass a Hamming test on folded sketches of about a bit for each shingle (fewer
would let all pairs of large sets pass) and are verified on whole sets.

Sets that are equal are one node. Keys shared by up to SMALL nodes give their pairs; the nodes of
larger keys form clouds, whose sketches are compared in tiles of bounded size, each giving only a
forest of its possible links. Of the nodes that possible links connect each is first verified
against its least neighbour, by whole sets. That leaves parts; a group of several is compared once
more by sketches, across parts alone, and only nodes that may still link another part meet with
their whole sets in tiles. So rows grow with the nodes, never with a group's pairs, and a group
whose possible links hold copies no set into tiles.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

SHINGLE = 4
#: J >= NEAR / 100.
NEAR = 85
#: A set's folded sketch has the power of two of bits from its size on, within these.
SKETCH_BITS = 1024
MOST_SKETCH_BITS = 1 << 15
#: Nodes that share a key and are still joined pair by pair.
SMALL = 16
#: Bytes of whole sets in a chunk; a tile compares two chunks.
CHUNK_BYTES = 24 << 20
BAND_GROWTH = 1.25
#: Blocks left out, as a part of those needed.
SPARE = 3
#: Neighbours verified in one task against one node, whose set is sent once for so many.
FAN = 64
#: Nodes in a tile's chunk, and ids that may be broadcast (8 bytes each).
CHUNK_NODES = 1024
MOST_SENT = 500_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def bands(near: int = NEAR, most: int = 1 << 33) -> np.ndarray:
    """Lower ends of the size bands: 1, then growing by BAND_GROWTH (and by one at least)."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, int(ends[-1] * max(BAND_GROWTH, 100 / near + 0.01))))
    return np.array(ends, np.int64)


def most_apart(sizes, near: int = NEAR):
    """Greatest symmetric difference of two sets with this sum of sizes and J >= near / 100."""
    return (100 - near) * sizes // (100 + near)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles; fewer words make one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    parts = [words[i : len(words) - n + 1 + i] * np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(n)]
    return np.unique(common.mix64(sum(parts[1:], parts[0]) + np.uint64(n * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)))


def identity(own: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    x = common.mix64(np.array([np.bitwise_xor.reduce(own), own.sum(), len(own)], np.uint64))
    return int(common.mix64(x[:1] + x[1:2] * _MIX[1] + x[2:] * _MIX[2]).view(np.int64)[0])


def folded(own: np.ndarray) -> bytes:
    bits = min(max(SKETCH_BITS, 1 << max(len(own) - 1, 0).bit_length()), MOST_SKETCH_BITS)
    bit = (own & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=bits) & 1 == 1).tobytes()


def narrowed(sketches: list[bytes], words: int) -> np.ndarray:
    """Rows of `words` uint64: folded sketches of as many or more, folded down to that width."""
    width = np.array([len(s) // 8 for s in sketches], np.int64)
    out = np.empty((len(sketches), words), np.uint64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        raw = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), w // words, words)
        out[at] = np.bitwise_xor.reduce(raw, axis=1)
    return out


def block_keys(own: np.ndarray, ends: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Keys of a sorted set's sketch blocks, for its band and, if it may pair upwards, the next."""
    n = len(own)
    band = int(np.searchsorted(ends, n, "right")) - 1
    out = []
    for k in (band, band + 1):
        if k > band and 100 * n < near * int(ends[k]):
            break
        d = int(most_apart(2 * (int(ends[k + 1]) - 1), near))
        if d == 0:
            continue
        spare = max(1, (d + 1) // SPARE)
        blocks = d + 1 + spare
        at = ((own >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(at, minlength=blocks)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        code = np.zeros(blocks, np.uint64)
        code[at[first]] = np.bitwise_xor.reduceat(common.mix64(own + _MIX[3]), first)
        where = np.lexsort((code, held))[spare:]
        code = code[where]
        out.append(common.mix64(code ^ common.mix64(where.astype(np.uint64) + np.uint64(k << 40))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(batch, i_text: int, size: int):
    """(row, sorted shingle set) of a batch's texts."""
    data, offsets = common.text_buffers(batch.column(i_text))
    for i, j in common.runs_of(offsets, 1 << 21):
        words = common.word_hashes(data, offsets[i : j + 1], common.SPACE_WORD)
        for r in range(j - i):
            yield i + r, shingles(words.hashes[words.first[r] : words.first[r + 1]], size)


def sketched(docs: DataFrame, size: int, near: int) -> DataFrame:
    """doc_id, n (size of the set), sid (name of the set), sketch and keys of every document."""
    ends = bands(near)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                n, sid, sketch, keys = [], [], [], []
                for _, own in _sets(part, 1, size):
                    n.append(len(own))
                    sid.append(identity(own) if len(own) else None)
                    sketch.append(folded(own) if len(own) else None)
                    keys.append(block_keys(own, ends, near).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "n", "sid", "sketch", "keys"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, sid bigint, sketch binary, keys binary")


def exploded(rows: DataFrame) -> DataFrame:
    """(key, sid): a row for each block key of rows(sid, keys)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                raw = [np.frombuffer(k, np.int64) for k in part.column(1).to_pylist()]
                sid = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(r) for r in raw])
                if len(sid):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(raw)), pa.array(sid)], ["key", "sid"])

    return rows.select("sid", "keys").mapInArrow(run, "key bigint, sid bigint")


def matched(keys: DataFrame) -> DataFrame:
    """(a, b, large): pairs of nodes that share a key of up to SMALL nodes; for a larger key, each
    of its nodes with the least one, and large set. A task holds its keys (16 bytes for each), so
    there are four times as many as shuffles have otherwise."""

    def run(batches):
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        key, sid = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((sid, key))
        key, sid = key[order], sid[order]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))  # repeated rows of one id
        key, sid = key[once], sid[once]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(first, append=len(key))
        pairs, stars = [], []
        for s in np.unique(size[size > 1]):
            at = first[size == s]
            if s <= SMALL:
                for x, y in itertools.combinations(range(s), 2):
                    pairs.append(np.stack([sid[at + x], sid[at + y]], axis=1))
            else:
                for i in at:
                    stars.append(np.stack([np.full(s - 1, sid[i]), sid[i + 1 : i + s]], axis=1))
        for found, large in ((pairs, False), (stars, True)):
            if found:
                ab = np.unique(np.concatenate(found), axis=0)
                for i in range(0, len(ab), 20_000):
                    own = ab[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy()), pa.array(np.full(len(own), large))], ["a", "b", "large"])

    parts = 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "key").mapInArrow(run, "a bigint, b bigint, large boolean")


def near_enough(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, near: int) -> np.ndarray:
    """Whether sketches (rows of uint64) and sizes allow J >= near / 100."""
    apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (apart <= most_apart(nx + ny, near)) & (100 * np.minimum(nx, ny) >= near * np.maximum(nx, ny))


def linked(x: np.ndarray, y: np.ndarray, near: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= near * (len(x) + len(y) - both)


class Forest:
    """Union-find over local numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _filtered(pairs: DataFrame, nodes: DataFrame, near: int) -> DataFrame:
    """Pairs that pass the Hamming test."""
    side = nodes.select("sid", "n", "sketch")
    a, b = (side.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(i).to_pylist() for i in (3, 5))
                nx, ny = (batch.column(i).to_numpy() for i in (2, 4))
                width = np.array([min(len(s), len(t)) // 8 for s, t in zip(x, y)], np.int64)
                ok = np.zeros(len(width), bool)
                for w in np.unique(width).tolist():
                    at = np.flatnonzero(width == w)
                    ok[at] = near_enough(narrowed([x[i] for i in at], w), narrowed([y[i] for i in at], w), nx[at], ny[at], near)
                import pyarrow as pa

                yield batch.select([0, 1]).filter(pa.array(ok))

    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "sa", "nb", "sb")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _tiled(rows: DataFrame, chunk: str, near: int, exact: bool) -> DataFrame:
    """A forest of the links between parts of each cloud of rows(cloud, part, sid, n, sketch or own),
    tile by tile: links by the Hamming test, or with exact by whole sets, where a part's nodes count
    as linked already. chunk: SQL for the number of chunks."""
    # most clouds are one chunk: only the others are looked up, so that rows stay where they are
    chunks = common.written(rows.groupBy("cloud").agg(F.expr(chunk).cast("int").alias("c")).filter("c > 1"), "chunks")
    chunks = F.broadcast(chunks) if chunks.count() <= MOST_SENT else chunks
    payload = "own" if exact else "sketch"
    dealt = rows.join(chunks, "cloud", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("sid"), F.col("c")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.expr("sequence(0, c - 1)"))).select("cloud", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "part", "sid", "n", payload)

    def tile(frame):
        import pandas as pd

        frame = frame.sort_values(["n", "sid"], kind="stable")
        sid, side, n, part = (frame[c].to_numpy() for c in ("sid", "i", "n", "part"))
        sets = [np.frombuffer(o, np.uint64) for o in frame["own"]] if exact else []
        sketches = list(map(folded, sets)) if exact else list(frame["sketch"])
        width = np.array([len(s) // 8 for s in sketches], np.int64)  # grows with n, as rows do
        begin, at_width = 0, -1
        alike = side.min() == side.max()
        forest, out = Forest(len(sid)), []
        if exact:
            _, first, own = np.unique(part, return_index=True, return_inverse=True)
            forest.up = first[own].tolist()
        upto = np.searchsorted(near * n, 100 * n, "right")
        for p in range(len(sid)):
            q = np.arange(p + 1, upto[p])
            q = q[part[q] != part[p]]
            if not alike:
                q = q[side[q] != side[p]]
            if not len(q):
                continue
            if width[p] != at_width:
                begin, at_width = p, int(width[p])
                sketch = narrowed(sketches[p : int(upto[width == at_width].max())], at_width)
            for k in q[near_enough(sketch[p - begin], sketch[q - begin], n[p], n[q], near)].tolist():
                x, y = forest.root(p), forest.root(k)
                if x != y and (not exact or linked(sets[p], sets[k], near)):
                    forest.up[max(x, y)] = min(x, y)
                    out.append((sid[p], sid[k]))
        return pd.DataFrame({"a": pd.Series([x for x, _ in out], dtype="int64"), "b": pd.Series([y for _, y in out], dtype="int64")})

    return dealt.groupBy("cloud", "x", "y").applyInPandas(tile, "a bigint, b bigint")


def _verified(edges: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """Those of edges(a, b) that whole sets(sid, own) confirm. A row of edges brings b's set, and each FAN of a node a its own."""
    many = edges.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("c"))
    dealt = edges.join(many, "a").withColumn("i", F.pmod(F.xxhash64("b"), F.col("c")).cast("int"))
    asked = dealt.select("a", "i", F.col("b").alias("sid")).unionByName(dealt.select("a", "i", F.col("a").alias("sid")).distinct())

    def check(key, frame):
        import pandas as pd

        found = {s: np.frombuffer(o, np.uint64) for s, o in zip(frame["sid"], frame["own"])}
        hub = found.pop(key[0], None)
        kept = [s for s, o in found.items() if hub is not None and linked(hub, o, near)]
        return pd.DataFrame({"a": pd.Series([key[0]] * len(kept), dtype="int64"), "b": pd.Series(kept, dtype="int64")})

    return asked.join(sets, "sid").select("a", "i", "sid", "own").groupBy("a", "i").applyInPandas(check, "a bigint, b bigint")


def _whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(sid, own) of the wanted(doc_id, sid): sets made again from the texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sids = batch.column(1).to_pylist()
            rows = [(sids[r], own.tobytes()) for r, own in _sets(batch, 0, size) if len(own) and identity(own) == sids[r]]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows[i : i + 256]], pa.int64()), pa.array([x[1] for x in rows[i : i + 256]], pa.binary())], ["sid", "own"])

    wanted = F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id").select("text", "sid")
    return texts.mapInArrow(run, "sid bigint, own binary").dropDuplicates(["sid"])


def join(docs: DataFrame, size: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """Components of docs(doc_id, text, ...) linked by J >= near / 100 of their shingle sets.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable) for every row. A null
    or empty text has no shingles and links with nothing; such a row is its own component. Equal
    sets are linked. Rows with a null doc_id are returned with a null component and link nothing.
    Rows of one doc_id but different texts are linked by their own texts only. Set names are 64-bit
    hashes. Other columns are ignored; an empty table gives an empty result.
    """
    all_rows = common.written(sketched(docs, size, near), "sketches")
    known = all_rows.filter("sid is not null and doc_id is not null")
    nodes = known.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = common.written(nodes, "nodes")
    # keys are large: only those of a node's own document are moved, and only once
    chosen = nodes.select("sid", "doc_id")
    keyed = known.select("sid", "doc_id", "keys").join(F.broadcast(chosen) if chosen.count() <= MOST_SENT else chosen, ["sid", "doc_id"], "left_semi")
    found = common.written(matched(exploded(keyed)).distinct(), "matches")
    common.settle(docs.sparkSession)
    clouds = components.components(found.filter("large").select("a", "b")).select(F.col("node").alias("sid"), F.col("root").alias("cloud"))
    clouds = common.written(clouds.join(nodes.select("sid", "n", "sketch"), "sid").withColumn("part", F.col("sid")), "clouds")
    pairs = _filtered(found.filter("not large").select("a", "b"), nodes, near)
    possible = common.written(pairs.unionByName(_tiled(clouds, f"ceil(count(*) / {CHUNK_NODES})", near, False)), "possible")
    common.discard(found)
    common.discard(clouds)
    common.settle(docs.sparkSession)
    groups = components.components(possible).select(F.col("node").alias("sid"), F.col("root").alias("cloud"))
    groups = common.written(groups.join(nodes.select("sid", "n", "doc_id"), "sid"), "groups")
    sets = common.written(_whole_sets(docs, groups.select("doc_id", "sid"), size), "sets")
    nearest = possible.groupBy(F.greatest("a", "b").alias("b")).agg(F.min(F.least("a", "b")).alias("a"))
    links = common.written(_verified(nearest, sets, near), "verified")
    common.discard(possible)
    common.settle(docs.sparkSession)
    parts = components.components(links).select(F.col("node").alias("sid"), F.col("root").alias("part"))
    parted = common.written(groups.join(parts, "sid", "left").select("cloud", F.coalesce("part", "sid").alias("part"), "sid", "n"), "parts")
    split = parted.groupBy("cloud").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most").select("cloud")
    across = parted.join(split, "cloud").join(nodes.select("sid", "sketch"), "sid")
    open_ = common.written(_tiled(across, f"ceil(count(*) / {CHUNK_NODES})", near, False), "open")
    common.settle(docs.sparkSession)
    again = components.components(open_).select(F.col("node").alias("sid"), F.col("root").alias("cloud"))
    members = common.written(parted.drop("cloud").join(again, "sid").join(sets, "sid").select("cloud", "part", "sid", "n", "own"), "members")
    common.discard(sets)
    common.settle(docs.sparkSession)
    links = links.unionByName(common.written(_tiled(members, f"ceil(sum(octet_length(own)) / {CHUNK_BYTES})", near, True), "linked"))
    common.discard(members)
    common.settle(docs.sparkSession)
    roots = components.components(links)
    named = nodes.select("sid", "doc_id").join(roots, F.col("sid") == F.col("node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("sid", "component_id")
    labels = common.written(nodes.select("sid", "doc_id").join(named, "sid", "left").select("sid", F.coalesce("component_id", "doc_id").alias("component_id")), "labels")
    rows = all_rows.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(labels, "sid", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM g),
e AS (SELECT doc_id, unnest(s) AS k FROM g),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_
  FROM e x JOIN e y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * both_ >= {NEAR} * (na.n + nb.n - both_)
), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.doc_id WHERE r.m < u.b
)
SELECT doc_id, any_value(n.n) AS n_shingles, min(m) AS component_id FROM n JOIN r USING (doc_id) GROUP BY doc_id
"""
