"""Language-model scores of texts from an Elias-Fano n-gram trie.

Interpolated absolute discounting over words, bigrams and trigrams. The corpus is cut into runs of
some megabytes of text, each kept as numbers of its own sorted dictionary. Level by level, a run
sends its distinct values, sorted and with their training counts, to the segments that hold their
ranges; a segment merges what it gets, writes its part of the level to a file, searches the values
in it, and answers each run in the run's own order. So a segment is opened by one task, tasks hold
one run or one segment, whatever the size of the corpus, and nothing is collected by the driver.

Values are (context, successor): for words the context is empty and the successor the word's hash;
for bigrams both are word numbers; for trigrams the context is a bigram's node and the successor
the rank of the last word among the successors of the middle one. The next level's segment of a
context follows from running sums of the contexts' occurrences, so that segments have about
SEGMENT_VALUES values; a context with more is split over several by its successors, and the sums
of such a context are put together from the parts.
"""

from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, ngram_trie

DISCOUNT = 0.75
#: Hash of the end token: a fixed value.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Bytes of text in a run (a longer text is a run of its own), and values that a segment is meant to hold.
RUN_BYTES = (1 << 22) - 8
SEGMENT_VALUES = 3_000_000

RUNS = "run bigint, file string, at int, entries bigint"
#: What a run asks of a segment: contexts from `base` on, successors, training counts, other counts, lower-order codes.
ASKED = "segment bigint, run bigint, file string, at int, state string, base bigint, width bigint, contexts binary, successors binary, train binary, rest binary, lower binary"
#: A segment: nodes, training tokens, all tokens, the most successors of a context, and of its first and last context the parts held here.
BUILT = "segment bigint, uri string, size bigint, total bigint, every bigint, widest bigint, first bigint, first_kinds bigint, first_total bigint, first_begin bigint, last bigint, last_kinds bigint, last_total bigint, last_begin bigint"
#: A segment's answers to a run, entry by entry.
ANSWERS = "run bigint, file string, at int, state string, segment bigint, found binary, node binary, begin binary, code binary, target binary, spread binary, count binary"


def pack(x: np.ndarray) -> bytes:
    """Bytes of non-negative whole numbers in the least width, transposed so that like bytes are together, compressed."""
    most = int(x.max(initial=0))
    size = next(k for k in (1, 2, 4, 8) if most < 1 << 8 * k)
    planes = np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(len(x), size).T)
    return bytes([size]) + zstandard.compress(planes.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(flat.reshape(raw[0], -1).T).view(f"<u{raw[0]}").ravel().astype(np.uint64)


def rising(x: np.ndarray) -> bytes:
    """pack() of the steps of a rising sequence."""
    x = x.astype(np.uint64)
    return pack(np.diff(x, prepend=np.uint64(0)))


def risen(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def bits(x: np.ndarray) -> bytes:
    return pack(np.packbits(x))


def unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(raw).astype(np.uint8), count=n).astype(bool)


def unigram(count: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((count.astype(np.float64) + 0.5) / (n + 0.5 * (v + 1)))


def _batch(rows: list[dict], ddl: str):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in fields], [name for name, _ in fields])


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# ---- runs -----------------------------------------------------------------------------------


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first token of each text): each text's words and its end."""
    w = common.word_hashes(data, offsets, common.SPACE_WORD)
    n = np.diff(w.first)
    ends = np.cumsum(n + 1) - 1
    out = np.empty(len(w.hashes) + len(n), np.uint64)
    out[ends] = END
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = np.where(w.hashes == END, END + np.uint64(1), w.hashes)
    return out, np.concatenate([[0], ends + 1])


def runs(docs: DataFrame, folder: str) -> DataFrame:
    """Cuts docs(doc_id, held_out, text) into runs in files: their documents and token numbers, and
    (in a file that the first level reads) their dictionaries; returns RUNS."""

    def cut(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        name = f"{part:06d}-{uuid.uuid4().hex}"
        files = None
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(2))
            ids, held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in common.runs_of(offsets, RUN_BYTES):
                files = files or (ngram_trie.Rows(f"{folder}/runs/{name}"), ngram_trie.Rows(f"{folder}/words/{name}"))
                hashes, first = tokens(data, offsets[i : j + 1])
                n, own = np.diff(first), ids.slice(i, j - i)
                words, back = np.unique(hashes, return_inverse=True)
                every = np.bincount(back, minlength=len(words))
                train = np.bincount(back[np.repeat(~held[i:j], n)], minlength=len(words))
                missing = own.is_null().to_numpy(zero_copy_only=False)
                files[0].add({"ids": pack(own.fill_null(0).to_numpy().view(np.uint64)), "missing": bits(missing), "held": bits(held[i:j]), "n": pack(n), "stream": pack(back)})
                files[1].add({"values": rising(words), "train": pack(train), "rest": pack(every - train)})
                yield _batch([{"run": part << 32 | k, "file": f"{folder}/runs/{name}", "at": k, "entries": len(words)}], RUNS)
                k += 1
        for file in files or ():
            file.close()

    return docs.mapInArrow(cut, RUNS)


def _asked(run: dict, segment: np.ndarray, context: np.ndarray, successor: np.ndarray, width: int, train: np.ndarray, rest: np.ndarray, lower: np.ndarray, state: str = ""):
    """A run's questions: rows of ASKED. Entries are in order of (context, successor). A run without
    any asks for the last successor of context 0, so that every run is answered."""
    if not len(segment):
        segment, context, successor, train, rest, lower = (np.array([x], np.uint64) for x in (0, 0, width - 1, 0, 0, 0))
    cut = np.flatnonzero(np.diff(segment.astype(np.int64), prepend=-1))
    out = []
    for a, b in zip(cut, np.append(cut[1:], len(segment))):
        base = int(context[a])
        out.append({"segment": int(segment[a]), "run": run["run"], "file": run["file"], "at": run["at"], "state": state, "base": base, "width": width, "contexts": rising(context[a:b] - np.uint64(base)), "successors": pack(successor[a:b]) if width else rising(successor[a:b]), "train": pack(train[a:b]), "rest": pack(rest[a:b]), "lower": pack(lower[a:b])})
    return _batch(out, ASKED)


def asked_words(listed: DataFrame, n_segments: int) -> DataFrame:
    def ask(batches):
        for run in _rows(batches):
            own = ngram_trie.read(run["file"].replace("/runs/", "/words/"), run["at"])
            h = risen(own["values"])
            none = np.zeros(len(h), np.uint64)
            yield _asked(run, ((h >> np.uint64(32)) * np.uint64(n_segments) >> np.uint64(32)).astype(np.int64), none, h, 0, unpack(own["train"]), unpack(own["rest"]), none)

    return listed.repartition("run").mapInArrow(ask, ASKED)


# ---- segments -------------------------------------------------------------------------------


def built(asked: DataFrame, folder: str, order: int) -> DataFrame:
    """Merges what runs ask of each segment, writes its trie level and, beside it, where each run's
    values lie in it; returns BUILT."""

    def build(key, table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["run"])
        low, width = min(r["base"] for r in rows), np.uint64(rows[0]["width"])
        parts = [(risen(r["contexts"]) + np.uint64(r["base"] - low)) * width + unpack(r["successors"]) if width else risen(r["successors"]) for r in rows]
        ends = np.cumsum([0, *map(len, parts)])
        value = np.concatenate(parts)
        place = np.argsort(value, kind="stable")
        value = value[place]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        back = np.empty(len(place), np.int64)
        back[place] = np.repeat(np.arange(len(first)), np.diff(first, append=len(place)))
        value = value[first]
        train, rest, lower = (np.concatenate([unpack(r[c]) for r in rows]) for c in ("train", "rest", "lower"))
        train, rest, lower = np.add.reduceat(train[place], first), np.add.reduceat(rest[place], first), lower[place[first]]
        known = train > 0
        name = f"{key[0].as_py():08d}-{uuid.uuid4().hex}"
        uri = f"{folder}/level{order}/{name}"
        ngram_trie.save(uri, ngram_trie.encode(value[known]))
        ngram_trie.save_packed(f"{uri}.counts", {"train": pack(train[known]), "every": pack(train[known] + rest[known]), "lower": pack(lower[known])})
        rank, found = ngram_trie.Sequence(ngram_trie.load(uri)).search(value)
        context = value // max(width, np.uint64(1)) + np.uint64(low) if width else np.zeros(len(value), np.uint64)
        asked_file = ngram_trie.Rows(f"{folder}/asked{order}/{name}")
        for r, a, b in zip(rows, ends[:-1], ends[1:]):
            own = back[a:b]
            asked_file.add({"run": pack(np.array([r["run"]])), "file": r["file"].encode(), "at": pack(np.array([r["at"]])), "state": r["state"].encode(), "n": pack(np.array([b - a])), "rank": rising(rank[own]), "found": bits(found[own]), "context": rising(context[own[~found[own]]])})
        asked_file.close()
        begin = np.flatnonzero(np.diff(context[known], prepend=np.uint64(1 << 63)))
        kinds = np.diff(begin, append=int(known.sum()))
        out = {"segment": key[0].as_py(), "uri": uri, "size": int(known.sum()), "total": int(train.sum()), "every": int((train + rest)[known].sum()), "widest": int(kinds.max(initial=0))}
        for side, c in (("first", context[0]), ("last", context[-1])):
            own = context[known] == c
            out |= {side: int(c), f"{side}_kinds": int(own.sum()), f"{side}_total": int(train[known][own].sum()), f"{side}_begin": int(own.argmax()) if len(own) else 0}
        return pa.Table.from_batches([_batch([out], BUILT)])

    return common.written(asked.groupBy("segment").applyInArrow(build, BUILT), "trie-segments")


def numbered(segments: DataFrame) -> DataFrame:
    """segments with node_base and every_base (sums over earlier segments), and for the first and
    last context their sums over all segments. One short row a segment is all that meets here."""
    w = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    s = segments.withColumns({"node_base": F.coalesce(F.sum("size").over(w), zero), "every_base": F.coalesce(F.sum("every").over(w), zero)})
    side = lambda x: s.select("segment", F.col(x).alias("context"), F.col(f"{x}_kinds").alias("kinds"), F.col(f"{x}_total").alias("total"), F.when(F.col(f"{x}_kinds") > 0, F.col("node_base") + F.col(f"{x}_begin")).alias("begin"))
    edges = side("first").unionByName(side("last")).dropDuplicates(["segment", "context"])
    sums = edges.groupBy("context").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total"), F.min("begin").alias("begin"))
    for x in ("first", "last"):
        own = sums.select(F.col("context").alias(x), F.col("kinds").alias(f"{x}_all_kinds"), F.col("total").alias(f"{x}_all"), F.coalesce("begin", zero).alias(f"{x}_start"))
        s = s.join(own, x)
    return s


def answers(segments: DataFrame, order: int, width: int, n: int = 0, v: int = 0) -> DataFrame:
    """Finishes each segment (probabilities and backoffs, beside its sequence) and answers its runs."""
    share = SEGMENT_VALUES

    def answer(batches):
        for row in _rows(batches):
            uri = row["uri"]
            sequence, counts = ngram_trie.Sequence(ngram_trie.load(uri)), {k: unpack(x) for k, x in ngram_trie.read(f"{uri}.counts", 0).items()}
            train, every = counts["train"].astype(np.float64), counts["every"]
            if order == 1:
                context = begin = np.zeros(0, np.uint64)
                code, backoff, start = ngram_trie.quantise(unigram(train, n, v)), np.zeros(0, np.uint8), np.zeros(len(train), np.int64)
            else:
                of = sequence.decode() // np.uint64(width) + np.uint64(row["first"])
                at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
                context, kinds = of[at], np.diff(at, append=len(of)).astype(np.float64)
                total = np.add.reduceat(train, at) if len(at) else np.zeros(0)
                begin = at + row["node_base"]
                for x in ("first", "last"):
                    k = int(np.searchsorted(context, np.uint64(row[x])))
                    if k == len(context) or context[k] != row[x]:
                        context, kinds, total, begin = np.insert(context, k, np.uint64(row[x])), np.insert(kinds, k, 0.0), np.insert(total, k, 0.0), np.insert(begin, k, 0)
                    kinds[k], total[k], begin[k] = row[f"{x}_all_kinds"], row[f"{x}_all"], row[f"{x}_start"]
                weight = DISCOUNT * kinds / np.maximum(total, 1)
                mine = np.searchsorted(context, of)
                p = np.maximum(train - DISCOUNT, 0) / total[mine] + weight[mine] * 10 ** ngram_trie.restore(counts["lower"].astype(np.uint8))
                code, backoff, start = ngram_trie.quantise(np.log10(p)), ngram_trie.quantise(np.log10(np.maximum(weight, 1e-30))), begin[mine]
            ngram_trie.save(f"{uri}.p", {"p": code, "backoff": backoff})
            before = np.cumsum(every, dtype=np.uint64) - every + np.uint64(row["every_base"])
            target = before // np.uint64(share)
            spread = np.where(every <= share, np.uint64(1), (before + every - np.uint64(1)) // np.uint64(share) - target + np.uint64(1))
            for asked in ngram_trie.every_row(uri.replace(f"/level{order}/", f"/asked{order}/")):
                found, rank = unbits(asked["found"], int(unpack(asked["n"])[0])), risen(asked["rank"]).astype(np.int64)
                hit = rank[found]
                out = np.zeros(len(found), np.uint8)
                out[found] = code[hit]
                if order > 1:
                    out[~found] = backoff[np.searchsorted(context, risen(asked["context"]))]
                full = {"node": rising(hit + row["node_base"]), "target": rising(target[hit]), "spread": pack(spread[hit])} if order < 3 else {"node": b"", "target": b"", "spread": b""}
                yield _batch([{"run": int(unpack(asked["run"])[0]), "file": asked["file"].decode(), "at": int(unpack(asked["at"])[0]), "state": asked["state"].decode(), "segment": row["segment"], "found": asked["found"], "code": pack(out), **full, "begin": rising(start[hit]) if order == 2 else b"", "count": pack(counts["train"][hit]) if order == 1 else b""}], ANSWERS)

    n_tasks = max(1, segments.count())
    return numbered(segments).repartition(n_tasks, "segment").mapInArrow(answer, ANSWERS)


class Answers:
    """What the segments told a run, in the order of the run's entries."""

    def __init__(self, table, order: int):
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        self.run = rows[0]
        code = [unpack(r["code"]) for r in rows]
        self.found = np.concatenate([unbits(r["found"], len(c)) for r, c in zip(rows, code)])
        self.code = np.concatenate(code).astype(np.uint8)

        def spaced(name, read, kind):
            out = np.zeros(len(self.found), kind)
            out[self.found] = np.concatenate([read(r[name]) for r in rows])
            return out

        if order < 3:
            self.node, self.target, self.spread = spaced("node", risen, np.uint64), spaced("target", risen, np.int64), spaced("spread", unpack, np.int64)
        if order == 1:
            self.count = spaced("count", unpack, np.uint64)
        if order == 2:
            self.begin = spaced("begin", risen, np.uint64)


def _targets(target: np.ndarray, spread: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The next level's segment of entries whose successor lies at `part` (0 to 1) of its context's."""
    return target + np.minimum((part * spread).astype(np.int64), spread - 1)


class Run:
    """A run's tokens as numbers of its dictionary, and its bigrams and trigrams."""

    def __init__(self, run: dict):
        own = ngram_trie.read(run["file"], run["at"])
        self.n = unpack(own["n"]).astype(np.int64)
        self.ids, self.missing = unpack(own["ids"]).view(np.int64), unbits(own["missing"], len(self.n))
        self.held, self.word = unbits(own["held"], len(self.n)), unpack(own["stream"]).astype(np.int64)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        first = np.cumsum(self.n) - self.n
        self.place = np.arange(len(self.word)) - np.repeat(first, self.n)

    def pairs(self, known: np.ndarray):
        """Tokens whose word before is known; (left word, right word) of distinct such bigrams in
        order, an unknown right word as one past all; and each token's bigram."""
        at = np.flatnonzero((self.place > 0) & np.concatenate([[False], known[self.word[:-1]]]))
        size = len(known)
        key, back = np.unique(self.word[at - 1] * (size + 1) + np.where(known[self.word[at]], self.word[at], size), return_inverse=True)
        return at, key // (size + 1), key % (size + 1), back

    def triples(self, at: np.ndarray, back: np.ndarray, found: np.ndarray):
        """Tokens whose context is a known bigram; (context, bigram of the last two) of distinct such
        trigrams in order, unknown bigrams as one past all; and each token's trigram."""
        pair = np.full(len(self.word), -1)
        pair[at] = back
        mine = np.where(pair >= 0, found[pair], False)
        own = np.flatnonzero((self.place > 1) & np.concatenate([[False], mine[:-1]]))
        size = len(found)
        key, three = np.unique(pair[own - 1] * (size + 1) + np.where(mine[own], pair[own], size), return_inverse=True)
        return own, key // (size + 1), key % (size + 1), three

    def counts(self, at: np.ndarray, back: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(training, other) occurrences of entries."""
        held = self.held[self.text[at]]
        return np.bincount(back[~held], minlength=size), np.bincount(back[held], minlength=size)


def asked_bigrams(told: DataFrame, folder: str, n: int, v: int) -> DataFrame:
    def ask(key, table):
        import pyarrow as pa

        words = Answers(table, 1)
        run = Run(words.run)
        at, left, right, back = run.pairs(words.found)
        state = f"{folder}/state2/{words.run['run']}-{uuid.uuid4().hex}"
        ngram_trie.save_packed(state, {"found": bits(words.found), "count": pack(words.count)})
        number = np.append(words.node, np.uint64(v))
        train, rest = run.counts(at, back, len(left))
        segment = _targets(words.target[left], words.spread[left], number[right].astype(np.float64) / (v + 1))
        lower = np.append(words.code, np.uint8(0))[right]
        return pa.Table.from_batches([_asked(words.run, segment, number[left], number[right], v + 1, train, rest, lower, state)])

    return told.groupBy("run").applyInArrow(ask, ASKED)


def asked_trigrams(told: DataFrame, folder: str, width: int) -> DataFrame:
    def ask(key, table):
        import pyarrow as pa

        pairs = Answers(table, 2)
        run, words = Run(pairs.run), ngram_trie.read(pairs.run["state"], 0)
        count = unpack(words["count"])
        at, left, right, back = run.pairs(unbits(words["found"], len(count)))
        own, context, last, three = run.triples(at, back, pairs.found)
        state = f"{folder}/state3/{pairs.run['run']}-{uuid.uuid4().hex}"
        ngram_trie.save_packed(state, {**words, "pair": bits(pairs.found), "code": pack(pairs.code)})
        relative = np.append(pairs.node - pairs.begin, np.uint64(width - 1))
        train, rest = run.counts(own, three, len(context))
        segment = _targets(pairs.target[context], pairs.spread[context], relative[last].astype(np.float64) / width)
        return pa.Table.from_batches([_asked(pairs.run, segment, pairs.node[context], relative[last], width, train, rest, np.append(pairs.code, np.uint8(0))[last], state)])

    return told.groupBy("run").applyInArrow(ask, ASKED)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def summed(told: DataFrame, n: int, v: int) -> DataFrame:
    """SCORES of every text from the last level's answers and what the levels before left in files."""

    def score(key, table):
        import pyarrow as pa

        trigrams = Answers(table, 3)
        run, state = Run(trigrams.run), ngram_trie.read(trigrams.run["state"], 0)
        count, code = unpack(state["count"]), unpack(state["code"]).astype(np.uint8)
        known, pair = unbits(state["found"], len(count)), unbits(state["pair"], len(code))
        p1 = unigram(count, n, v)
        base = p1[run.word]
        logp = base.copy()
        at, left, right, back = run.pairs(known)
        if len(at):
            logp[at] = (ngram_trie.restore(code) + np.where(pair, 0.0, np.append(p1, unigram(np.zeros(1), n, v))[right]))[back]
        own, context, last, three = run.triples(at, back, pair)
        bare = ngram_trie.restore(trigrams.code)[three]
        logp[own] = np.where(trigrams.found[three], bare, bare + logp[own])
        sums = [np.bincount(run.text, weights=x, minlength=len(run.n)) for x in (known[run.word], base, logp)]
        ids = pa.array(run.ids, pa.int64(), mask=run.missing)
        return pa.table([ids, pa.array(run.held), pa.array(run.n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(run.n), n)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return told.groupBy("run").applyInArrow(score, SCORES)


def score_all(docs: DataFrame, held_out: Column | None = None, keep: str | None = None) -> DataFrame:
    """Learn from docs(doc_id, text, ...) outside the held-out rows (by default the fold of the
    contract) and score every row: SCORES. The trie's files are left in the folder `keep`, if that
    is given, and else deleted.

    A null text is empty: one end token. Repeated rows score alike. Without training rows no token
    is known, and base and score are 0 for each token. Other columns are ignored. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    folder = keep or common.scratch(spark, "trie")
    done = lambda *names: common.settle(spark, *(f"{folder}/{x}" for x in names if not (keep and x.startswith("level"))))
    held = F.coalesce(common.fold_of(F.col("doc_id"), 5) == 1 if held_out is None else held_out, F.lit(False))
    listed = common.written(runs(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text"), folder), "trie-runs")
    entries = listed.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    one = built(asked_words(listed, max(1, -(-entries // SEGMENT_VALUES))), folder, 1)
    done("words")
    n, v = one.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    two = built(asked_bigrams(answers(one, 1, 1, n, v), folder, n, v), folder, 2)
    done("asked1", "level1")
    most = F.greatest(F.max("widest"), F.max("first_all_kinds"), F.max("last_all_kinds"))
    width = 1 + numbered(two).agg(F.coalesce(most, F.lit(0))).first()[0]
    three = built(asked_trigrams(answers(two, 2, v + 1), folder, width), folder, 3)
    done("asked2", "state2", "level2")
    out = common.written(summed(answers(three, 3, width), n, v), "scores")
    done("asked3", "state3", "level3", "runs")
    return out
