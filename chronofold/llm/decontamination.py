"""Benchmark decontamination over a distributed positional inverted index.

The index is split by documents: every row of the index table is a segment of some megabytes of
training text and holds, for each term, the sorted list of its positions. A segment answers
queries alone, so no posting list ever moves or meets in one task, however frequent its term.
A phrase is searched by fetching the list of its rarest term in the segment, adjusting it by the
term's offset, and intersecting it with the adjusted lists of the next rarest terms until none is
left. Proximity queries walk from the rarest term's list too.

Terms are 64-bit hashes of lower-cased words. Queries come in blocks of a bounded number of
words, each broadcast; more queries make more blocks, and blocks' hits are merged per segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a segment (a longer document is a segment alone).
SEGMENT_BYTES = 1 << 20
#: Words of a window.
WINDOW = 13
#: Query words in one broadcast block, at most (8 bytes each, 13 times for windows).
BLOCK_WORDS = 200_000
#: Candidate starts held at once while lists are intersected.
CANDIDATES = 1 << 20

INDEX_SCHEMA = "segment long, doc_ids array<bigint>, firsts binary, n_words binary, terms binary, starts binary, positions binary"


def build_index(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """Postings of docs(doc_id, text, ...): one row per segment.

    Null and empty texts have no words but stay listed. Documents' positions are kept apart by a
    gap, so no phrase spans two. With terms (sorted hashes), only their postings are stored.
    """
    sc = docs.sparkSession.sparkContext
    only = None if terms is None else sc.broadcast(np.unique(terms))

    def segments(batches):
        import pyarrow as pa

        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            ids = batch.column(0)
            for i, j in common.runs_of(offsets, SEGMENT_BYTES):
                words = common.word_hashes(data, offsets[i : j + 1], common.ALNUM_WORD)
                n = np.diff(words.first).astype(np.int32)
                gap = np.arange(j - i, dtype=np.int32)
                firsts = (words.first[:-1] + gap).astype(np.int32)
                positions = (np.arange(len(words.hashes)) + np.repeat(gap, n)).astype(np.int64)
                if only is None:
                    known, ix = np.unique(words.hashes, return_inverse=True)
                else:
                    known = only.value
                    if len(known):
                        ix = np.searchsorted(known, words.hashes)
                        ix[ix == len(known)] = 0
                        there = known[ix] == words.hashes
                        ix, positions = ix[there], positions[there]
                    else:
                        ix, positions = np.zeros(0, np.int64), positions[:0]
                keys = np.sort((ix.astype(np.int64) << 32) | positions)
                seen, starts = np.unique(keys >> 32, return_index=True)
                columns = [
                    pa.array([part << 32 | count], pa.int64()), pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (firsts, n, known[seen], np.append(starts, len(keys)).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32))),
                ]
                count += 1
                yield pa.RecordBatch.from_arrays(columns, ["segment", "doc_ids", "firsts", "n_words", "terms", "starts", "positions"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(segments, INDEX_SCHEMA)


class Segment:
    """One row of the index, open for searching."""

    def __init__(self, row: dict):
        self.id, self.doc_ids = row["segment"], row["doc_ids"]
        self.firsts = np.frombuffer(row["firsts"], np.int32)
        self.n_words = np.frombuffer(row["n_words"], np.int32)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["starts"], np.int32)
        self.positions = np.frombuffer(row["positions"], np.int32)
        self.keys = (np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.starts)) << 32) | self.positions
        self.width = int(self.firsts[-1] + self.n_words[-1] + 1) if len(self.firsts) else 0

    def locate(self, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash: its place among the segment's terms, and its number of postings."""
        if not len(self.terms):
            return np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
        at = np.searchsorted(self.terms, vocab)
        at[at == len(self.terms)] = 0
        return at, np.where(self.terms[at] == vocab, np.diff(self.starts)[at], 0).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return self.keys[at] == keys

    def phrases(self, vocab: np.ndarray, terms: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Exact matches of the phrases terms[p, :lengths[p]] (indexes of vocab): phrase and start, in pieces."""
        at, count = self.locate(vocab)
        inside = np.arange(terms.shape[1]) < lengths[:, None]
        counts = np.where(inside, count[terms], np.iinfo(np.int64).max)
        least = counts.min(axis=1, initial=np.iinfo(np.int64).max)
        live = np.flatnonzero((least > 0) & (lengths > 0))
        if not len(live):
            return
        order = np.argsort(counts[live], axis=1, kind="stable")
        upto = np.cumsum(least[live])
        cut = 0
        while cut < len(live):
            end = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + CANDIDATES, "right")))
            piece, turn = live[cut:end], order[cut:end]
            n = least[piece]
            rarest = at[terms[piece, turn[:, 0]]]
            row = np.repeat(np.arange(len(piece)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[self.starts[rarest][row] + within].astype(np.int64) - turn[row, 0]
            ok = start >= 0
            row, start = row[ok], start[ok]
            for k in range(1, terms.shape[1]):
                if not len(row):
                    break
                j = turn[row, k]
                ok = j >= lengths[piece[row]]
                todo = np.flatnonzero(~ok)
                ok[todo] = self.has((at[terms[piece[row[todo]], j[todo]]] << 32) | (start[todo] + j[todo]))
                row, start = row[ok], start[ok]
            if len(row):
                yield piece[row], start
            cut = end

    def proximity(self, hashes: np.ndarray, slop: int) -> list[tuple[int, int]]:
        """Spans (start, end) of at most slop words within one document that hold every term, from
        each occurrence of any term that begins such a span."""
        hashes = np.unique(hashes)
        at, count = self.locate(hashes)
        if not len(hashes) or (count == 0).any():
            return []
        lists = [self.positions[self.starts[a] : self.starts[a + 1]].astype(np.int64) for a in at[np.argsort(count)]]
        lefts = np.unique(np.concatenate(lists))
        near = lists[0]
        k = np.searchsorted(near, lefts)
        lefts = lefts[(k < len(near)) & (near[np.minimum(k, len(near) - 1)] < lefts + slop)]
        last = lefts
        for own in lists:
            k = np.searchsorted(own, lefts)
            ok = k < len(own)
            lefts, last, k = lefts[ok], last[ok], k[ok]
            last = np.maximum(last, own[k])
            ok = last < lefts + slop
            lefts, last = lefts[ok], last[ok]
        doc = np.searchsorted(self.firsts, lefts, "right")
        same = doc == np.searchsorted(self.firsts, last, "right")
        return list(zip(lefts[same].tolist(), (last[same] + 1).tolist()))


@dataclass
class Block:
    """Windows of some items: vocab holds hashes, windows index them, owner has the item."""

    vocab: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray
    items: list[str]


def query_words(items: DataFrame) -> DataFrame:
    """(item_id as string, hashes binary, n) of items(item_id, text, ...) that have words."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            words = common.word_hashes(data, offsets, common.ALNUM_WORD)
            raw = [words.hashes[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(np.diff(words.first), pa.int64())], ["item_id", "hashes", "n"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return named.mapInArrow(scan, "item_id string, hashes binary, n long").filter("n > 0")


def to_block(rows: list, size: int) -> Block:
    windows, owner, names = [], [], []
    for item_id, raw in rows:
        h = np.frombuffer(raw, np.uint64)
        w = np.lib.stride_tricks.sliding_window_view(h, min(size, len(h)))
        windows.append(w)
        owner += [len(names)] * len(w)
        names.append(item_id)
    vocab = np.unique(np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])) if rows else np.zeros(0, np.uint64)
    wide = np.zeros((len(owner), size), np.int32)
    lengths, at = np.zeros(len(owner), np.int32), 0
    for w in windows:
        wide[at : at + len(w), : w.shape[1]] = np.searchsorted(vocab, w)
        lengths[at : at + len(w)] = w.shape[1]
        at += len(w)
    return Block(vocab, wide, lengths, np.array(owner, np.int32), names)


def blocks(items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[int, Iterator[Block]]:
    """How many blocks of about block_words the items make, and the blocks, read to the driver one at a time."""
    words = common.written(query_words(items), "query-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = 1 if total <= block_words else -(-2 * total // block_words)
    part = lambda i: words if n == 1 else words.filter(F.pmod(F.xxhash64("item_id", "hashes"), F.lit(n)) == i)
    return n, (to_block([(r.item_id, r.hashes) for r in part(i).select("item_id", "hashes").toLocalIterator()], size) for i in range(n))


HITS = "segment long, bits binary, docs array<int>, items array<string>"
FOUND = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"


def _search(segment: Segment, block: Block) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hit positions as a boolean array; documents (by place) and items that occur in them, paired."""
    edges = np.zeros(segment.width + 1, np.int32)
    pairs = []
    for p, start in segment.phrases(block.vocab, block.windows, block.lengths):
        np.add.at(edges, start, 1)
        np.add.at(edges, start + block.lengths[p], -1)
        doc = np.searchsorted(segment.firsts, start, "right") - 1
        pairs.append(np.unique(doc.astype(np.int64) * len(block.items) + block.owner[p]))
    hit = np.cumsum(edges)[: segment.width] > 0
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    k = max(1, len(block.items))
    return hit, (both // k).astype(np.int32), [block.items[i] for i in both % k]


def _reported(segment: Segment, hit: np.ndarray, docs: np.ndarray, items: list[str]):
    """A batch of FOUND rows: one for each document of the segment."""
    import pyarrow as pa

    named: dict[int, set[str]] = {}
    for d, item in zip(docs.tolist(), items):
        named.setdefault(d, set()).add(item)
    n_hit, spans = np.zeros(len(segment.doc_ids), np.int64), [[] for _ in segment.doc_ids]
    for d in named:
        own = hit[segment.firsts[d] : segment.firsts[d] + segment.n_words[d]]
        n_hit[d] = own.sum()
        edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        spans[d] = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
    columns = [pa.array(segment.doc_ids, pa.int64()), pa.array(segment.n_words.astype(np.int64)), pa.array(n_hit), pa.array([sorted(named.get(d, ())) for d in range(len(n_hit))], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "spans"])


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def search(index: DataFrame, queries: Iterator[Block], n: int) -> DataFrame:
    """FOUND rows: for every indexed document its words, hit words, items and hit spans (word offsets).

    One block is broadcast and answered in one pass. Of several, each is broadcast in turn, its
    hits by segment are written, and a last pass merges them.
    """
    sc = index.sparkSession.sparkContext
    if n == 1:
        sent = sc.broadcast(next(iter(queries)))

        def whole(batches):
            for row in _rows(batches):
                segment = Segment(row)
                yield _reported(segment, *_search(segment, sent.value))

        return index.mapInArrow(whole, FOUND)

    def part(block):
        def run(batches):
            import pyarrow as pa

            for row in _rows(batches):
                hit, docs, items = _search(Segment(row), block.value)
                yield pa.RecordBatch.from_pylist([{"segment": row["segment"], "bits": np.packbits(hit).tobytes(), "docs": docs.tolist(), "items": items}], schema=pa.schema([("segment", pa.int64()), ("bits", pa.binary()), ("docs", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))

        return run

    hits = None
    for block in map(sc.broadcast, queries):
        own = common.written(index.mapInArrow(part(block), HITS), "query-hits")
        block.unpersist()
        hits = own if hits is None else hits.unionByName(own)
    hits = hits.groupBy("segment").agg(F.collect_list("bits").alias("bits"), F.flatten(F.collect_list("docs")).alias("docs"), F.flatten(F.collect_list("items")).alias("items"))

    def merged(batches):
        for row in _rows(batches):
            segment = Segment(row)
            hit = np.zeros(segment.width, bool)
            for bits in row["bits"]:
                hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=segment.width).astype(bool)
            yield _reported(segment, hit, np.array(row["docs"], np.int32), row["items"])

    return index.join(hits, "segment").select(*index.columns, "bits", F.col("docs"), "items").mapInArrow(merged, FOUND)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """FOUND rows of docs(doc_id, text, ...) against windows of items(item_id, text, ...).

    A window is `size` consecutive words of an item; an item of fewer words, but not none, is one
    window. Null or empty texts have no words and no hits. Items without words never occur; a null
    item_id reads as the empty string. Repeated documents are reported each; repeated item ids
    count once. Without documents the result is empty; without items nothing is hit. Other columns
    are ignored.
    """
    n, queries = blocks(items, size, block_words)
    return search(common.written(build_index(docs), "postings"), queries, n)


def near(index: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """(doc_id, start, end): spans of at most slop words that hold all the terms, in word offsets."""
    raw = [t.encode() for t in terms]
    offsets = np.cumsum([0, *map(len, raw)])
    hashes = common.word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, common.ALNUM_WORD).hashes

    def run(batches):
        import pyarrow as pa

        for row in _rows(batches):
            s = Segment(row)
            found = s.proximity(hashes, slop)
            doc = [int(np.searchsorted(s.firsts, a, "right")) - 1 for a, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array([s.doc_ids[d] for d in doc], pa.int64()), pa.array([a - int(s.firsts[d]) for d, (a, _) in zip(doc, found)], pa.int32()), pa.array([b - int(s.firsts[d]) for d, (_, b) in zip(doc, found)], pa.int32())], ["doc_id", "start", "end"])

    return index.mapInArrow(run, "doc_id bigint, start int, end int")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from FOUND rows."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({_LOW.format('text')}, '{_WORD}'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all({_LOW.format('text')}, '{_WORD}'), []) AS w FROM benchmark
), q AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0))
), g AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)
), h AS (SELECT g.r, g.i, g.n, q.item_id FROM g JOIN q ON g.n = q.n AND g.k = q.k),
p AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS at FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
