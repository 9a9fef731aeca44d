"""Averaged hashed subword embeddings under a linear softmax, trained jointly in numpy.

A text's features are its words and the byte n-grams of its words, with a mark at either end of a
word, of the lower-cased text; whatever is not a letter separates words. Features are hashed into
buckets, each with an embedding; the text's mean embedding goes through a linear layer and a
softmax. As the mean and the layer are linear, a fitted model is one table of class logits per
bucket, and scoring a text is a mean over table rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import common

#: Bytes of text whose features are computed together; longer texts are cut between words.
PIECE_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_SPACED = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _pieces(raw: np.ndarray, most: int):
    """raw (with separators as spaces) cut between words into runs of about `most` bytes."""
    at = 0
    while len(raw) - at > most:
        gaps = np.flatnonzero(raw[at + 1 : at + most] == 32)
        if not len(gaps):
            gaps = np.flatnonzero(raw[at + most :] == 32) + most - 1
            if not len(gaps):
                break
            end = at + 1 + int(gaps[0])
        else:
            end = at + 1 + int(gaps[-1])
        yield raw[at : end + 1]
        at = end
    yield raw[at:]


@dataclass(frozen=True)
class Features:
    sizes: tuple[int, ...]
    bits: int
    words: bool = True

    def buckets(self, texts: list[str | None]):
        """All features of the texts, in pieces: (word, bucket) of each feature, and the text of each word.

        sizes are at least 2. Words are numbered within a piece; a text may be cut into pieces.
        """
        group, size = [], 0
        for i, t in enumerate(texts):
            raw = b" " + (t or "").lower().encode("utf-8", "replace") + b" "
            if len(raw) > PIECE_BYTES:
                for piece in _pieces(_SPACED[np.frombuffer(raw, np.uint8)], PIECE_BYTES):
                    yield from self._run(piece, np.array([0, len(piece)]), np.array([i]))
                continue
            if size + len(raw) > PIECE_BYTES:
                yield from self._group(group)
                group, size = [], 0
            group.append((i, raw))
            size += len(raw)
        yield from self._group(group)

    def _group(self, group):
        if group:
            data = _SPACED[np.frombuffer(b"".join(r for _, r in group), np.uint8)]
            yield from self._run(data, np.cumsum([0, *(len(r) for _, r in group)]), np.array([i for i, _ in group]))

    def _run(self, low: np.ndarray, offsets: np.ndarray, which: np.ndarray):
        n = len(low)
        powers, inverse = common._powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
        gap = low == 32
        gaps = np.zeros(n + 1, np.int32)
        np.cumsum(gap, out=gaps[1:])
        begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        text_of = which[np.searchsorted(offsets, begin, "right") - 1]
        n_begun = np.zeros(n, np.int32)
        n_begun[begin] = 1
        n_begun = np.cumsum(n_begun, dtype=np.int32) - 1
        shift = np.uint64(64 - self.bits)
        words, hashes = [], []
        for k in self.sizes:
            if n < k:
                continue
            inner = gaps[k - 1 : n] - gaps[1 : n - k + 2]
            at = np.flatnonzero(inner == 0) if k > 2 else np.flatnonzero(~(gap[:-1] & gap[1:]))
            hashes.append((total[at + k] - total[at]) * inverse[at] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            words.append(n_begun[at + gap[at]])
        if self.words:
            hashes.append((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            words.append(np.arange(len(begin), dtype=np.int32))
        yield np.concatenate(words), (common.mix64(np.concatenate(hashes)) >> shift).astype(np.int32), text_of

    def seen(self, texts: list[str | None]) -> np.ndarray:
        """How many of the texts have each feature."""
        out = np.zeros(1 << self.bits, np.int32)
        for text in texts:
            out[np.unique(np.concatenate([col for _, col, _ in self.buckets([text])]))] += 1
        return out

    def bag(self, texts: list[str | None], rows_seen: int = 1, of: np.ndarray | None = None):
        """CSR (first, bucket, weight) of the texts' features that rows_seen texts have at least;
        weights are shares of the sum over all of a text's features, each counting as `of` says (1
        by default). Texts are read twice to hold little."""
        seen = self.seen(texts)
        first, cols, weights = [0], [], []
        for text in texts:
            col, count = np.unique(np.concatenate([bucket for _, bucket, _ in self.buckets([text])]), return_counts=True)
            kept = seen[col] >= rows_seen
            cols.append(col[kept].astype(np.int32))
            count = count if of is None else count * of[col]
            weights.append((count[kept] / max(1e-9, count.sum())).astype(np.float32))
            first.append(first[-1] + int(kept.sum()))
        return np.array(first), np.concatenate(cols), np.concatenate(weights), seen


@dataclass
class Model:
    """Class logits by bucket, their bias, a temperature fitted on held-back rows, and the rejection level."""

    features: Features
    classes: list
    table: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    shift: np.ndarray | float = 0.0
    reject_below: float = 0.0
    #: What a bucket counts in a text's mean; 1 without it.
    weight: np.ndarray | None = None

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return self._read(texts)[0]

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and how far a text is like what was learned: the share of its features that
        the fitted rows have, times the probability of its two likeliest classes."""
        z, learned = self._read(texts, (self.table != 0).any(axis=1))
        p = softmax(z * self.slope + self.shift)
        return p, learned * np.sort(p, axis=1)[:, -2:].sum(axis=1)

    def _read(self, texts: list[str | None], learned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the share of features that are learned."""
        out = np.zeros((len(texts), self.table.shape[1]))
        count, n = np.zeros(len(texts)), np.zeros((2, len(texts)))
        for word, bucket, text_of in self.features.buckets(texts):
            row = text_of[word]
            w = None if self.weight is None else self.weight[bucket]
            if learned is not None:
                n += [np.bincount(row, minlength=len(texts)), np.bincount(row, weights=learned[bucket], minlength=len(texts))]
            count += np.bincount(row, weights=w, minlength=len(texts))
            for c in range(out.shape[1]):
                own = self.table[bucket, c]
                out[:, c] += np.bincount(row, weights=own if w is None else own * w, minlength=len(texts))
        return out / np.where(count > 0, count, 1)[:, None] + self.bias, n[1] / np.maximum(n[0], 1)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return softmax(self.logits(texts) * self.slope + self.shift)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def split(n: int, held_back: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(held back, fitted) row numbers."""
    order = np.random.default_rng(seed).permutation(n)
    return tuple(np.split(order, [int(n * held_back)]))


def salience(features: Features, texts: list[str | None], y: np.ndarray) -> np.ndarray:
    """Of two classes, how surely a feature's log odds differ from none (in standard errors, cubed):
    few features tell the classes apart, and in a plain mean all others drown them."""
    seen = [features.seen([t for t, c in zip(texts, y) if c == k]) + 0.5 for k in (0, 1)]
    odds = np.log(seen[1] / ((y == 1).sum() + 1)) - np.log(seen[0] / ((y == 0).sum() + 1))
    return (np.abs(odds) / np.sqrt(1 / seen[0] + 1 / seen[1])) ** 3 + 1e-3


def train(texts: list[str | None], labels: list, features: Features, dim: int = 8, epochs: int = 6, rate: float = 0.5, batch: int = 32, held_back: float = 0.15, rows_seen: int = 3, seed: int = 7, weighed: bool = False, odds: float | None = None) -> Model:
    """Fit embeddings and the linear layer together by stochastic gradient descent (Adagrad steps).

    With weighed (two classes), means are weighted by the fitted rows' salience. odds are those of
    the second class where the model is used, if the rows were drawn otherwise.

    A part of the rows is held back for calibration: a temperature (and with two classes a shift)
    that minimises its log loss. Without rows, or with one class, the model is a constant.
    """
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    if len(classes) < 2:
        return Model(features, classes or [None], np.zeros((1 << features.bits, max(1, len(classes))), np.float32), np.zeros(max(1, len(classes))))
    y = np.searchsorted(classes, labels)
    back, fit = split(len(texts), held_back, seed)
    of = salience(features, [texts[i] for i in fit], y[fit]) if weighed else None
    first, bucket, weight, seen_in = features.bag(texts, rows_seen, of)
    n_class = len(classes)
    size = 1 << features.bits
    e = rng.normal(0, 0.1, (size, dim)).astype(np.float32)
    e_sum = np.full(size, 1e-8, np.float32)
    w = rng.normal(0, 1 / np.sqrt(dim), (dim, n_class)).astype(np.float32)
    w_sum = np.full(w.shape, 1e-6, np.float32)
    b = np.zeros(n_class, np.float32)
    b_sum = np.full(n_class, 1e-6, np.float32)

    def gathered(rows):
        lengths = first[rows + 1] - first[rows]
        at = np.repeat(first[rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.repeat(np.arange(len(rows)), lengths), bucket[at], weight[at]

    def mean(rows, row, col, val):
        return np.stack([np.bincount(row, weights=e[col, d] * val, minlength=len(rows)) for d in range(dim)], axis=1)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(fit)
        for i in range(0, len(fit), batch):
            rows = fit[i : i + batch]
            row, col, val = gathered(rows)
            x = mean(rows, row, col, val)
            g = softmax(x @ w + b)
            g[np.arange(len(rows)), y[rows]] -= 1
            back_x = (g @ w.T).astype(np.float32)
            known, ix = np.unique(col, return_inverse=True)
            ge = np.stack([np.bincount(ix, weights=back_x[row, d] * val, minlength=len(known)) for d in range(dim)], axis=1).astype(np.float32)
            e_sum[known] += (ge * ge).sum(axis=1)
            e[known] -= step * ge / np.sqrt(e_sum[known])[:, None]
            gw, gb = x.T @ g, g.sum(axis=0)
            w_sum += gw * gw
            b_sum += gb * gb
            w -= (step * gw / np.sqrt(w_sum)).astype(np.float32)
            b -= (step * gb / np.sqrt(b_sum)).astype(np.float32)
    e[seen_in < rows_seen] = 0
    model = Model(features, classes, (e @ w).astype(np.float32), b.astype(np.float64), weight=None if of is None else of.astype(np.float32))
    if len(back) and len(set(y[back])) > 1:
        row, col, val = gathered(back)
        z = mean(back, row, col, val) @ w + b
        share = np.ones(len(classes)) if odds is None else np.array([1.0, odds * (y == 0).sum() / max(1, (y == 1).sum())])
        calibrate(model, z, y[back], share[y[back]])
    return model


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, share: np.ndarray) -> None:
    """The temperature, and with two classes the shift, of least log loss on a fixed grid; rows count by share."""
    shifts = [np.array([0.0, s]) for s in np.linspace(-3, 3, 25)] if z.shape[1] == 2 else [np.zeros(z.shape[1])]
    best = (np.inf, 1.0, shifts[0])
    for slope in np.geomspace(0.1, 4, 33):
        for shift in shifts:
            p = softmax(z * slope + shift)[np.arange(len(y)), y]
            best = min(best, (float(-(np.log(np.maximum(p, 1e-12)) * share).sum() / share.sum()), float(slope), shift), key=lambda t: t[0])
    _, model.slope, model.shift = best


def drawn(rows, key, most: int, by=None, count=None):
    """About `most` rows of each class, drawn by a hash of the key: a fraction of most / class size.

    rows has columns `key` and `by`; count overrides the class sizes. The draw is the same in every run.
    """
    from pyspark.sql import functions as F

    sizes = count or {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    u = F.pmod(F.xxhash64(F.lit("draw"), key), F.lit(1 << 30))
    cond = F.lit(False)
    for c, n in sizes.items():
        cond = cond | ((F.col(by) == c) & (u < int((1 << 30) * min(1.0, most / max(n, 1)))))
    return rows.filter(cond)
