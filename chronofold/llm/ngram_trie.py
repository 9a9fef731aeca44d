"""Elias-Fano n-gram trie levels in memory-mapped files.

A level is one monotone sequence: node i's value is (its context's node) * width + (its successor),
so the pointers of contexts to their successors and the successors themselves share one sequence.
It is coded by partitioned Elias-Fano: blocks of 64 values keep a base, the low bits of each value
in whole words, and the high bits in unary within three words. Beside it lie one byte for each
node's quantised log probability and one for each context's backoff weight. From level 3 on a
successor is relative to its context: its rank among the successors of the context's last word. A
level is cut into segments by value; each is an Arrow file, memory-mapped if local, and is opened
only by the task that serves its range.
"""

from __future__ import annotations

import re

import numpy as np

BLOCK = 64
#: Queries that a sequence answers at once, and blocks that it decodes at once.
QUERIES = 1 << 18
BLOCKS = 1 << 12


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted distinct uint64 values to arrays of an Elias-Fano sequence."""
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.concatenate([values, np.full(blocks * BLOCK - n, values[-1] if n else 0, np.uint64)]).reshape(blocks, BLOCK)
    base = padded[:, 0].copy()
    rel = padded - base[:, None]
    span = rel[:, -1]
    width = np.zeros(blocks, np.int64)
    left = span >> np.uint64(7)
    while (left > 0).any():
        width += left > 0
        left >>= np.uint64(1)
    offset = np.concatenate([[0], np.cumsum(width)])
    high_at = (rel >> width.astype(np.uint64)[:, None]).astype(np.int64) + np.arange(BLOCK)
    bits = np.zeros((blocks, 192), np.uint8)
    bits[np.repeat(np.arange(blocks), BLOCK)[:n], high_at.ravel()[:n]] = 1
    highs = np.packbits(bits, axis=1, bitorder="little")
    lows = np.zeros(int(offset[-1]) + 1, np.uint64)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        low = rel[own] & np.uint64((1 << int(w)) - 1)
        words = np.zeros((len(own), int(w)), np.uint64)
        for i in range(BLOCK):
            at, shift = divmod(i * int(w), 64)
            words[:, at] |= low[:, i] << np.uint64(shift)
            if shift + int(w) > 64:
                words[:, at + 1] |= low[:, i] >> np.uint64(64 - shift)
        lows[(offset[own][:, None] + np.arange(int(w))).ravel()] = words.ravel()
    return {"base": base, "width": width.astype(np.uint8), "offset": offset.astype(np.uint64), "highs": highs.ravel(), "lows": lows, "n": np.array([n], np.int64)}


class Sequence:
    """Searching and decoding a coded sequence."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.base, self.width, self.offset, self.lows = a["base"], a["width"], a["offset"], a["lows"]
        self.highs = a["highs"].reshape(-1, 24)
        self.n = int(a["n"][0])

    def _low(self, block: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = self.width[block].astype(np.int64)
        at, shift = self.offset[block].astype(np.int64) + (i * w >> 6), (i * w & 63).astype(np.uint64)
        low = self.lows[at] >> shift
        over = shift.astype(np.int64) + w > 64
        low[over] |= self.lows[at[over] + 1] << (np.uint64(64) - shift[over])
        return low & ((np.uint64(1) << w.astype(np.uint64)) - np.uint64(1))

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of values below q, whether q is there) of uint64 queries in any order, QUERIES at a time."""
        parts = [self._search(q[i : i + QUERIES]) for i in range(0, max(1, len(q)), QUERIES)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Finds each query's block by its base, decodes the blocks that any query needs, and
        searches in those."""
        rank, found = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        if not self.n or not len(q):
            return rank, found
        block = np.searchsorted(self.base, q, "right") - 1
        todo = np.flatnonzero(block >= 0)
        if not len(todo):
            return rank, found
        block, q = block[todo], q[todo]
        needed, row = np.unique(block, return_inverse=True)
        values = self.decode(needed)
        begin = np.concatenate([[0], np.cumsum(np.minimum(BLOCK, self.n - needed * BLOCK))])
        at = np.searchsorted(values, q)
        rank[todo] = block * BLOCK + at - begin[row]
        inside = at < len(values)
        found[todo[inside]] = values[at[inside]] == q[inside]
        return rank, found

    def decode(self, blocks: np.ndarray | None = None) -> np.ndarray:
        """Values of some blocks, or of all."""
        wanted = np.arange(len(self.base)) if blocks is None else blocks
        out = []
        for i in range(0, len(wanted), BLOCKS):
            own = wanted[i : i + BLOCKS]
            row, at = np.nonzero(np.unpackbits(self.highs[own], axis=1, bitorder="little"))
            block = own[row]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            k = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
            out.append(self.base[block] + ((at - k).astype(np.uint64) << self.width[block].astype(np.uint64)) + self._low(block, k))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


#: Log10 probabilities and backoffs are coded in 255 equal steps over this range (fixed values).
LOWEST, HIGHEST = -20.0, 0.0


def quantise(x: np.ndarray) -> np.ndarray:
    return np.round((np.clip(x, LOWEST, HIGHEST) - LOWEST) * (255 / (HIGHEST - LOWEST))).astype(np.uint8)


def restore(code: np.ndarray) -> np.ndarray:
    return LOWEST + code.astype(np.float64) * ((HIGHEST - LOWEST) / 255)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:", "", uri))


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One row of binary columns, each the bytes of an array."""
    import pyarrow as pa

    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    schema = pa.schema([(k, pa.large_binary()) for k in arrays], metadata={k: str(v.dtype) for k, v in arrays.items()})
    batch = pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.large_binary()) for v in arrays.values()], schema=schema)
    with store.open_output_stream(path) as out, pa.ipc.new_file(out, schema) as file:
        file.write_batch(batch)


def load(uri: str) -> dict[str, np.ndarray]:
    import pyarrow as pa
    from pyarrow import fs

    store, path = filesystem(uri)
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(0)
    kinds = {k.decode(): np.dtype(v.decode()) for k, v in batch.schema.metadata.items()}
    return {name: np.frombuffer(batch.column(i)[0].as_buffer(), kinds[name]) for i, name in enumerate(batch.schema.names)}


class Rows:
    """An Arrow file of rows, each some named binary values, that are read by number."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.file = store.open_output_stream(path), None

    def add(self, row: dict[str, bytes]) -> None:
        import pyarrow as pa

        schema = pa.schema([(k, pa.large_binary()) for k in row])
        if self.file is None:
            self.file = pa.ipc.new_file(self.out, schema)
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.array([v], pa.large_binary()) for v in row.values()], schema=schema))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.out.close()


def save_packed(uri: str, row: dict[str, bytes]) -> None:
    """A file of one row."""
    file = Rows(uri)
    file.add(row)
    file.close()


def _opened(uri: str):
    import pyarrow as pa
    from pyarrow import fs

    store, path = filesystem(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


def read(uri: str, at: int) -> dict[str, bytes]:
    return _opened(uri).get_batch(at).to_pylist()[0]


def every_row(uri: str):
    file = _opened(uri)
    for i in range(file.num_record_batches):
        yield file.get_batch(i).to_pylist()[0]
