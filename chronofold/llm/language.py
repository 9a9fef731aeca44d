"""Language identification by averaged hashed subword embeddings, with calibrated rejection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, subword

FEATURES = subword.Features(sizes=(2, 3, 4), bits=17)
#: Rows of each language that the model is fitted on, at most about (drawn by a hash).
SAMPLE_ROWS = 500
UNKNOWN = "und"
#: Of cuts of held-back rows, in words (and whole), at most this share may be rejected.
CUTS = (1, 2, 3, 5, 10, 20)
REJECTED = 0.005
HELD_BACK = 0.15
SEED = 7


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> subword.Model:
    """Learn from text and lang of docs(doc_id, text, lang, ...) outside the held-out fold."""
    rows = docs.filter("lang is not null and text is not null").filter(common.fold_of(F.col("doc_id"), 4) != 2).select("doc_id", "lang", "text")
    # by id and text, as ids may be null or repeated (a hash leaves nulls out)
    sample = subword.drawn(rows, F.xxhash64("doc_id", "text"), sample_rows, "lang").select("doc_id", "lang", "text")
    sample = sorted((r.lang, r.doc_id is None, r.doc_id or 0, r.text) for r in sample.toLocalIterator() if subword.has_letter(r.text))
    texts, langs = [r[3] for r in sample], [r[0] for r in sample]
    model = subword.train(texts, langs, FEATURES, epochs=5, held_back=HELD_BACK, seed=SEED)
    back, _ = subword.split(len(texts), HELD_BACK, SEED)
    model.reject_below = rejection(model, [texts[i] for i in back])
    return model


def shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters dealt anew: letters and word lengths of a language, but no language."""
    at = [i for i, c in enumerate(text) if c.isalpha()]
    out = list(text)
    for i, j in zip(at, rng.permutation(len(at))):
        out[i] = text[at[j]]
    return "".join(out)


def rejection(model: subword.Model, held_back: list[str]) -> float:
    """The level of evidence under which a text is rejected: half-way between what cuts of held-back
    rows have, but for REJECTED of them, and what the median cut has when its letters are shuffled;
    never above the former. The evidence counts the two likeliest languages, so a text of two
    languages is not rejected, and the share of learned features, so two languages suffice. Of too
    few cuts to tell that share, no level is set and only texts without a letter are rejected."""
    if len(model.classes) < 2 or not held_back:
        return 0.0
    cuts = [c for t in held_back for k in (*CUTS, None) if subword.has_letter(c := " ".join(t.split()[:k]))]
    if len(cuts) * REJECTED < 1:
        return 0.0
    rng = np.random.default_rng(SEED)
    own, other = (model.evidence(x)[1] for x in (cuts, [shuffled(c, rng) for c in cuts if len(c.split()) >= 3] or cuts))
    least = float(np.quantile(own, REJECTED))
    return min(least, (least + float(np.median(other))) / 2)


ADDED = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: subword.Model, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """docs with lang_pred, score and rejected (or other names for these) added.

    A null text, or one without a letter, is 'und' with score 0 and rejected. Otherwise lang_pred
    is the likeliest learned language, score its calibrated probability, and rejected tells that the
    text is less like the learned ones than the model's level. Clashing columns of docs named so are
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]
    docs = docs.select(*[c for c, name in zip(common.columns(docs), docs.columns) if name in own])
    at = own.index("text")

    def run(batches):
        import pyarrow as pa

        model = sent.value
        for batch in batches:
            _, offsets = common.text_buffers(batch.column(at))
            for i, j in common.runs_of(offsets, 1 << 22):
                part = batch.slice(i, j - i)
                texts = part.column(at).to_pylist()
                p, evidence = model.evidence(texts)
                p = np.round(p, 9)
                lettered = np.array([subword.has_letter(t) for t in texts]) & (model.classes[0] is not None)
                best = [model.classes[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), lettered)]
                score = np.where(lettered, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(score), pa.array(~lettered | (evidence < model.reject_below))], [*own, *names])

    added = StructType().add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def identify(docs: DataFrame, model: subword.Model | None = None) -> DataFrame:
    """Fit on docs (unless a model is given) and predict all rows. Empty tables give empty results;
    without labelled rows every text is 'und'. Repeated rows are predicted alike."""
    return predict(docs, model or fit(docs))
