"""Token ids in Arrow files of fixed-size-list batches: random access to equal-length sequences.

A file is in Arrow's IPC file format. Its batches have `ids` (fixed-size list of unsigned
integers, 16 bits wide where the vocabulary allows) and `mask` (fixed-size list of booleans; false
marks the padding after a file's last token). All lists of a file have one length, so sequence i
lies at a known place and is read without copying where the file can be memory-mapped. A second
file lists its documents: doc_id, start (in the file's token stream) and n_tokens.

Documents go to files by ranges of doc_id, each task writing its own files to the shared folder
under a name that no other attempt uses; only the names that successful tasks report are read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Tokens of a sequence, and sequences of a batch.
SEQUENCE = 2048
BATCH = 64
#: Bytes of text encoded at once (a longer text is alone), places for the ids of distinct units
#: that a worker remembers, and ids that it remembers at most (or those of one run of texts).
RUN_BYTES = (1 << 20) - 8
PLACES = 1 << 21
POOL = 1 << 24

_ENCODERS: dict[str, "Encoder"] = {}
#: Bytes that surely are no white space: ASCII above the space, and leads of characters of two
#: bytes or more whose range has no white space (fixed values of Unicode).
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE1] = True
_SOLID[0xE4:0xF5] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def encoder(path: str) -> "Encoder":
    """This process's encoder of a vocabulary: what it remembers serves all tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Where the bytes of a text may be cut so that the ids of the whole are those of the units, one
    after the other: the vocabulary's pre-tokeniser never joins what lies on either side. True before
    a space that something solid follows, between a letter and a mark, and after a lone line feed
    between something solid and a letter."""
    out = np.zeros(len(raw), bool)
    if len(raw) > 1:
        out[:-1] = (raw[:-1] == 0x20) & _SOLID[raw[1:]]
        out[1:] |= _LETTER[raw[:-1]] & _MARK[raw[1:]]
        out[2:] |= (raw[1:-1] == 0x0A) & _LETTER[raw[2:]] & _SOLID[raw[:-2]] & (raw[:-2] < 0x7F)
    return out


class Encoder:
    """Ids of whole texts, by the tokenizers library, with the ids of units of text remembered.

    Texts are cut into units (unit_starts) that are looked up by 64-bit hashes; the library encodes
    what is not remembered, each distinct unit once a run.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.key, self.at, self.n = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int32)
        self.pool, self.used = np.zeros(POOL, self.dtype), 0

    def _library(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of each unit's). Words after a space go to the library
        many in a text: each begins at the next token that has a space."""
        joined, alone = [], []
        for i, u in enumerate(units):
            (joined if u[:1] == b" " and len(u.split()) == 1 and not _SPACE[np.frombuffer(u[1:], np.uint8)].any() else alone).append(i)
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(units)
        for k in range(0, len(joined), 2048):
            part = joined[k : k + 2048]
            ids = np.array(self.library.encode_batch_fast([b"".join(units[i] for i in part).decode()], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) != len(part):
                alone += part
                continue
            for i, own in zip(part, np.split(ids, at[1:])):
                out[i] = own
        for k in range(0, len(alone), 1024):
            part = alone[k : k + 1024]
            for i, e in zip(part, self.library.encode_batch_fast([units[i].decode() for i in part], add_special_tokens=False)):
                out[i] = np.array(e.ids, self.dtype)
        return np.concatenate([np.zeros(0, self.dtype), *out]), np.array([len(x) for x in out], np.int64)

    def _found(self, h: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of each unit."""
        slot = (h % np.uint64(PLACES)).astype(np.int64)
        hit = self.key[slot] == h
        at, n = self.at[slot], self.n[slot].astype(np.int64)
        missed = np.flatnonzero(~hit)
        if not len(missed):
            return at, n
        new, first, back = np.unique(h[missed], return_index=True, return_inverse=True)
        own = missed[first]
        ids, count = self._library([raw[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist())])
        if self.used + len(ids) > len(self.pool):
            if self.used:
                self.key[:], self.used = 0, 0
                return self._found(h, raw, starts, ends)
            self.pool = np.zeros(len(ids), self.dtype)
        place = self.used + np.cumsum(count) - count
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        slot = (new % np.uint64(PLACES)).astype(np.int64)
        self.key[slot], self.at[slot], self.n[slot] = new, place, count
        at[missed], n[missed] = place[back], count[back]
        return at, n

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after the other, each with the end id; number of each text's)."""
        lo = int(offsets[0])
        raw, at = data[lo : int(offsets[-1])], (offsets - lo).astype(np.int64)
        begin = unit_starts(raw)
        filled = at[:-1][np.diff(at) > 0]
        begin[filled] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        h = common.span_hashes(raw, starts, ends)
        h[h == 0] = 1
        place, n = self._found(h, raw, starts, ends)
        text = np.searchsorted(at, starts, "right") - 1
        of_text = np.bincount(text, weights=n, minlength=len(at) - 1).astype(np.int64) + 1
        out = np.full(int(of_text.sum()), end, self.dtype)
        before = np.cumsum(n) - n
        to = before + text  # earlier texts' end ids lie between
        step = np.arange(int(n.sum())) - np.repeat(before, n)
        out[np.repeat(to, n) + step] = self.pool[np.repeat(place, n) + step]
        return out, of_text


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a shared folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:", "", uri))


def schema(dtype, sequence: int):
    import pyarrow as pa

    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class Writer:
    """Streams token ids into one file of equal-length sequences."""

    def __init__(self, uri: str, dtype, sequence: int = SEQUENCE, batch: int = BATCH):
        import pyarrow as pa

        store, path = filesystem(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.schema, self.dtype, self.sequence, self.size = schema(dtype, sequence), np.dtype(dtype), sequence, batch * sequence
        self.out = store.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.waiting, self.n_tokens = np.zeros(0, self.dtype), 0

    def add(self, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        if len(self.waiting) + len(ids) >= self.size:
            ids = np.concatenate([self.waiting, ids])
            whole = len(ids) // self.size * self.size
            for i in range(0, whole, self.size):
                self._batch(ids[i : i + self.size], self.size)
            self.waiting = ids[whole:].copy()
        else:
            self.waiting = np.concatenate([self.waiting, ids])

    def _batch(self, ids: np.ndarray, full: int) -> None:
        import pyarrow as pa

        mask = np.arange(full) < len(ids)
        if len(ids) < full:
            ids = np.concatenate([ids, np.zeros(full - len(ids), self.dtype)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if len(self.waiting):
            self._batch(self.waiting, -(-len(self.waiting) // self.sequence) * self.sequence)
        self.file.close()
        self.out.close()


class Index:
    """Streams a token file's list of documents."""

    def __init__(self, uri: str):
        import pyarrow as pa

        store, path = filesystem(uri)
        self.schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = store.open_output_stream(path)
        self.file, self.n_docs = pa.ipc.new_file(self.out, self.schema), 0

    def add(self, doc_ids, start: np.ndarray, n: np.ndarray) -> None:
        import pyarrow as pa

        self.n_docs += len(n)
        self.file.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(start, pa.int64()), pa.array(n, pa.int64())], schema=self.schema))

    def close(self) -> None:
        self.file.close()
        self.out.close()


class TokenFile:
    """Random access to one file. Local files are memory-mapped: views, no copies."""

    def __init__(self, uri: str):
        import pyarrow as pa
        from pyarrow import fs

        store, path = filesystem(uri)
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.dtype = np.dtype(self.file.schema.field("ids").type.value_type.to_pandas_dtype())
        first = len(self.file.get_batch(0)) if self.file.num_record_batches else 0
        self.batch = first  # all batches but the last have as many sequences

    def ids(self, i: int) -> np.ndarray:
        """Sequence i, a view of its batch."""
        b = self.file.get_batch(i // self.batch).column(0)
        at = (i % self.batch + b.offset) * self.sequence
        return b.values.to_numpy(zero_copy_only=True)[at : at + self.sequence]

    def mask(self, i: int) -> np.ndarray:
        b = self.file.get_batch(i // self.batch).column(1)
        return b[i % self.batch].values.to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return 0 if n == 0 else (n - 1) * self.batch + len(self.file.get_batch(n - 1))

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n tokens of the file's stream; a view if one batch holds them."""
        size, parts = self.batch * self.sequence, []
        while n > 0:
            values = self.file.get_batch(start // size).column(0).values.to_numpy(zero_copy_only=True)
            part = values[start % size : start % size + n]
            if not len(part):
                raise EOFError("the file has fewer tokens")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, self.dtype)


MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint"


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, sequence: int = SEQUENCE) -> DataFrame:
    """Write docs(doc_id, text, ...) in ascending doc_id order; returns the manifest, part by part.

    Null ids come first; rows of one id are in order of a hash of their text, and equal rows in
    that of the input, so that no range of equal rows is bound to one task. A null text is empty:
    only the end id. Without documents the manifest is empty.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "_tie", "_row").sortWithinPartitions("doc_id", "_tie", "_row").select("doc_id", "text")

    def encode(batches):
        import pyarrow as pa

        from pyspark import TaskContext

        coder = writer = index = None
        path = f"{folder}/{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            for i, j in common.runs_of(offsets, RUN_BYTES):
                if writer is None:
                    coder = encoder(tokenizer)
                    writer, index = Writer(path, coder.dtype, sequence), Index(f"{path}.docs")
                ids, n = coder.encode(data, offsets[i : j + 1], end)
                index.add(batch.column(0).slice(i, j - i), writer.n_tokens + np.cumsum(n) - n, n)
                writer.add(ids)
        if writer is None:
            return
        writer.close()
        index.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([path]), pa.array([index.n_docs], pa.int64()), pa.array([writer.n_tokens], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    return common.written(rows.mapInArrow(encode, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: start counts the tokens of all documents before."""
    return _read(manifest, "ids binary", lambda ids: ids.astype("<u4").tobytes())


def _read(manifest: DataFrame, column: str, derive) -> DataFrame:
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    files = manifest.select("part", "path", base)
    files = files.repartition(max(1, manifest.count()), "part")
    name, kind = column.split()

    def run(batches):
        import pyarrow as pa

        kinds = {"binary": pa.binary(), "bigint": pa.int64()}
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                file = TokenFile(path)
                store, at = filesystem(f"{path}.docs")
                with store.open_input_file(at) as source:
                    listed = pa.ipc.open_file(source)
                    for k in range(listed.num_record_batches):
                        for part in pa.Table.from_batches([listed.get_batch(k)]).to_batches(max_chunksize=512):
                            own, n = part.column(1).to_numpy(), part.column(2).to_numpy()
                            got = [derive(file.tokens(int(a), int(k))) for a, k in zip(own, n)]
                            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own + start), part.column(2), pa.array(got, kinds[kind])], ["doc_id", "start", "n_tokens", name])

    return files.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {column}")


def round_trip(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Write docs to files in the shared folder and return their digests as read back:
    doc_id, start, n_tokens (with the end id) and ids_crc32."""
    folder = common.scratch(docs.sparkSession, "tokens")
    manifest = write(docs, folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), 0, sequence)
    return _read(manifest, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
