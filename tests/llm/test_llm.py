"""Operators for training data: edge cases, brute-force comparisons, round trips, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import common, components, decontamination, jaccard, language, lm_scoring, metric_join, mixing, ngram_trie, pii, registry, sharding, subword, token_files, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, sid string, score double, own string, n int, cloud string"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, rows):
    """rows: (doc_id, text[, source]); the other columns clash with names that operators use."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 1.0, "y", 7, "z") for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "a b"), (5, "é 😀 ñandú"), (6, "word " * 30_000), (7, "x" * 50_000), (8, "Ünïcödé, tést!")]


@pytest.fixture(autouse=True)
def no_waits(monkeypatch):
    monkeypatch.setattr(common, "SETTLE_S", 0)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- shared parts -------------------------------------------------------------------------


def test_word_hashes_match_regexes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB3 \n\té\x1f.") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "ab", "ab"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for table, pattern in ((common.SPACE_WORD, SPACED), (common.ALNUM_WORD, WORD)):
        w = common.word_hashes(data, offsets, table)
        names = {}
        for i, t in enumerate(texts):
            words = re.findall(pattern, low(t))
            own = w.hashes[w.first[i] : w.first[i + 1]]
            assert len(own) == len(words)
            for word, h in zip(words, own):
                assert names.setdefault(word, h) == h
        assert len(set(names.values())) == len(names)


def test_prefix_sums(spark):
    rows = [("g" if i % 3 else None, i % 5, i, i) for i in range(100)]
    got = common.prefix_sums(spark.createDataFrame(rows, "g string, b int, o int, n bigint"), ["g"], "b", ["o"], "n").collect()
    for g in ("g", None):
        at = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.b, r.o)):
            assert r.before == at
            at += r.n
        assert {r.total for r in got if r.g == g} == {at}


@pytest.mark.parametrize("in_task", [400_000, 0])
def test_components_of_paths_stars_and_loops(spark, monkeypatch, in_task):
    monkeypatch.setattr(components, "MOST_IN_TASK", in_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(200, 200), (None, 3), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("name", ["op3_source_mixing", "op4_pii_boosting", "op5_arrow_token_files", "op9_hash_tree_sharding"])
def test_native_plans_and_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0
    if name[:3] in ("op3", "op4"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- 1: decontamination -------------------------------------------------------------------


def found_by_hand(texts, items, size=13):
    windows = []
    for i, t in items:
        w = re.findall(WORD, low(t))
        n = min(size, len(w))
        windows += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if n else []
    out = []
    for d, t in texts:
        w = re.findall(WORD, low(t))
        hit, seen = set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    seen.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), sorted(seen)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_decontamination_against_brute_force(spark, block_words):
    rng = random.Random(2)
    words = [rng.choice("abcdefg") for _ in range(400)]
    items = [(1, " ".join(words[:30])), (10, "q Q, q"), (2, None), (3, "..."), (10, "q q q"), (None, " ".join(words[50:64])), (4, "the quick brown fox jumps over the lazy dog again and again")]
    texts = ODD + [(20, " ".join(words)), (21, "Q q-q q"), (22, " ".join(words[:12])), (23, "x " + items[6][1].upper() + " y"), (24, " ".join(words[:15]) + " z " + " ".join(words[50:70]))]
    got = decontamination.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"), 13, block_words)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()), key=str) == found_by_hand(texts, items)
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in got.collect()}
    assert all(sum(b - a for a, b in spans[d]) == n for d, _, n, _ in found_by_hand(texts, items) if d not in (None, 4))


def test_decontamination_without_items_and_digest(spark):
    none = decontamination.decontaminate(docs(spark, ODD), spark.createDataFrame([], "item_id bigint, text string"))
    some = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontamination.decontaminate(docs(spark, []), some).count() == 0
    rows = decontamination.digest(none).collect()
    assert len(rows) == len(ODD) and all(r.n_hit == 0 and not r.contaminated and r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)


def test_proximity(spark):
    index = decontamination.build_index(docs(spark, [(1, "a b c d e a x b"), (2, "b b b"), (3, "c z z a"), (4, None)]))
    got = {(r.doc_id, r.start, r.end) for r in decontamination.near(index, ["a", "c"], 3).collect()}
    assert got == {(1, 0, 3)}
    assert {(r.doc_id, r.start, r.end) for r in decontamination.near(index, ["a", "c"], 4).collect()} == {(1, 0, 3), (1, 2, 6), (3, 0, 4)}


# ---- 2 and 7: subword models --------------------------------------------------------------


def test_subword_pieces_do_not_change_scores(monkeypatch):
    features = subword.Features(sizes=(2, 3, 4), bits=12)
    rng = np.random.default_rng(0)
    model = subword.Model(features, ["a", "b"], rng.normal(size=(1 << 12, 2)).astype(np.float32), np.zeros(2))
    texts = ["one two, three " * 50, "", None, "x" * 400, "é ñ"]
    model.weight = rng.random(1 << 12)
    whole = model.logits(texts)
    monkeypatch.setattr(subword, "PIECE_BYTES", 100)
    assert np.allclose(whole, model.logits(texts))


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(table).filter(common.fold_of(F.col("doc_id"), 4) == 2).select("lang", "lang_pred", "score", "rejected").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


@pytest.mark.parametrize("langs", [("en", "de"), ("de", "en", "es", "fr")])
def test_language_rejects_what_was_not_learned(spark, langs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isin(*langs))
    model = language.fit(table)
    rng = random.Random(3)
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(k)) for k in (3, 10, 50, 200) for _ in range(5)]
    junk += ["Zażółć gęślą jaźń, a potem idź do domu i odpocznij trochę", "Быстрая коричневая лиса прыгает через ленивую собаку", "Kissa nukkuu sohvalla ja lapset leikkivät ulkona"]
    texts = {r.lang: r.text for r in table.filter("length(text) > 500").collect()}
    mixed = " ".join(x for l in langs[:2] for x in texts[l].split()[:60])
    rows = {r.doc_id: r for r in language.predict(docs(spark, [*enumerate(junk), (1000, mixed), *((1001 + i, t) for i, t in enumerate(texts.values()))]), model).collect()}
    assert sum(rows[i].rejected for i in range(len(junk))) >= len(junk) - 1
    assert not any(r.rejected for i, r in rows.items() if i >= 1000)


def test_language_reliability(spark):
    """Held out at sf0.1, on cuts of three words: of each band of scores, about so many are right."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text is not null and lang is not null")
    model = language.fit(table)
    held = table.filter(common.fold_of(F.col("doc_id"), 4) == 2).select("doc_id", "lang", F.expr("array_join(slice(split(text, ' '), 1, 3), ' ')").alias("text"))
    rows = [r for r in language.predict(held, model).collect() if r.lang_pred != "und"]
    for low, high in ((0.25, 0.6), (0.6, 0.8), (0.8, 0.95), (0.95, 1.01)):
        own = [r for r in rows if low <= r.score < high]
        right, said = (sum(r.lang == r.lang_pred for r in own) / max(1, len(own)), sum(r.score for r in own) / max(1, len(own)))
        print(low, high, len(own), round(right, 3), round(said, 3))
        assert len(own) < 30 or abs(right - said) <= 0.2
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_language_edges(spark):
    model = subword.train(["the cat and the dog", "the house of the man"] * 20 + ["le chat et le chien", "la maison de la femme"] * 20, ["en"] * 40 + ["fr"] * 40, language.FEATURES, epochs=8)
    got = {(r.doc_id, r.text): r for r in language.predict(docs(spark, ODD + [(9, "123 !"), (10, "the man and the cat"), (11, "la femme et le chat")]), model).collect()}
    assert got[1, None].lang_pred == "und" and got[9, "123 !"].rejected and got[3, " \t\n"].score == 0
    assert got[10, "the man and the cat"].lang_pred == "en" and got[11, "la femme et le chat"].lang_pred == "fr"
    empty = docs(spark, [])
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs(spark, [(1, "a b")]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_fits_on_null_and_repeated_ids(spark):
    rows = ODD + [(4, "the cat"), (None, "the dog")] + [(None, f"the man and the cat {i}") for i in range(2000)]
    assert language.identify(docs(spark, rows)).count() == len(rows)
    named = docs(spark, rows).filter("text is not null")
    drawn = subword.drawn(named, F.xxhash64("doc_id", "text"), 500, "lang").count()
    assert 350 < drawn < 650


def test_toxicity_learns_words_and_unseen_spellings():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    text = lambda bad: " ".join(rng.choice(stems) if rng.random() > 0.05 or not bad else rng.choice(["idiotic", "moronic", "worthless"]) for _ in range(120))
    y = [i % 2 for i in range(500)]
    model = toxicity.train([text(v) for v in y], y)
    test = [i % 2 for i in range(100)]
    p = model.scores([text(v) for v in test])
    assert np.mean((p >= 0.7) == np.array(test)) > 0.95
    spelt = model.scores([text(0) + " worthlesss idiotics " + text(0), text(0) + text(0)])
    assert spelt[0] > spelt[1]


def test_toxicity_held_out_on_labels(spark):
    """sf0.1: about a seventh of the rows marked toxic hold no word that others marked so share."""
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("toxic is not null").select("doc_id", "toxic")
    rows = toxicity.detect(table, labels).filter("held_out").join(known, "doc_id").collect()
    y, p = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    rank = np.argsort(np.argsort(p, kind="stable"))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    flagged = np.array([r.predicted for r in rows]) == 1
    print("auc", auc, "recall", (flagged & (y == 1)).sum(), (y == 1).sum(), "false", (flagged & (y == 0)).sum(), (y == 0).sum())
    assert auc >= 0.93 and (flagged & (y == 1)).sum() >= 0.9 * (y == 1).sum() and (flagged & (y == 0)).sum() <= 0.015 * (y == 0).sum()
    # calibrated: of those scored 0.7 or more nearly all, of those under 0.1 few are toxic
    assert y[p >= 0.7].mean() >= 0.85 and y[p < 0.1].mean() <= 0.05


def test_subword_gradients_against_brute_force():
    """One step of the joint fit equals one by hand, bucket by bucket."""
    texts, labels = ["ab cd ab", "cd ef", "ab", "ef ef"], ["x", "y", "x", "y"]
    features = subword.Features(sizes=(2,), bits=8)
    model = subword.train(texts, labels, features, dim=2, epochs=1, batch=4, held_back=0.0, rows_seen=1, seed=1)
    rng = np.random.default_rng(1)
    e = rng.normal(0, 0.1, (256, 2)).astype(np.float32)
    w = rng.normal(0, 1 / np.sqrt(2), (2, 2)).astype(np.float32)
    b = np.zeros(2)
    bags = [np.concatenate([c for _, c, _ in features.buckets([t])]) for t in texts]
    ge, gw, gb = np.zeros((256, 2)), np.zeros((2, 2)), np.zeros(2)
    for bag, label in zip(bags, labels):
        x = e[bag].mean(axis=0)
        z = np.exp(x @ w + b)
        g = z / z.sum() - np.array([label == "x", label == "y"])
        gw, gb = gw + np.outer(x, g), gb + g
        for k in bag:
            ge[k] += w @ g / len(bag)
    e -= 0.5 * ge / np.sqrt((ge * ge).sum(axis=1) + 1e-8)[:, None]
    w = w - 0.5 * gw / np.sqrt(gw * gw + 1e-6)
    seen = np.unique(np.concatenate(bags))
    assert np.allclose(model.table[seen], (e @ w)[seen], atol=1e-4) and np.allclose(model.bias, -0.5 * gb / np.sqrt(gb * gb + 1e-6), atol=1e-4)


def test_toxicity_edges(spark):
    none = toxicity.detect(docs(spark, ODD), spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert len(none) == len(ODD) and {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}
    labels = spark.createDataFrame([(1, None), (2, 1), (4, 0), (99, 1), (None, 0), (6, 0), (6, 0)], "doc_id bigint, toxic int")
    got = toxicity.detect(docs(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


# ---- 3: mixing ----------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_mixing(spark, block):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["b", "a", None, "hot", "hot", "hot"])) for i in range(300)] + [(1000 + i, "x y z", "tiny") for i in range(2)] + [(7, "q", "a"), (7, "q", "a"), (None, "n n", None), (8, None, "a")]
    got = mixing.mix(docs(spark, rows), block).collect()
    again = mixing.mix(docs(spark, rows).repartition(5), block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
    size, order = {}, sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(SPACED, t or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= 3 * size[s]
        free -= over
    for s in order:
        own = [r for r in got if r.source == s]
        assert math.isclose(own[0].target, target[s], rel_tol=1e-12) and own[0].source_size == size[s]
        assert abs(sum(r.taken for r in own) - target[s]) <= 0.5
        assert all(0 <= r.taken <= 3 * r.size for r in own)


def test_schedule_is_spread_evenly(spark):
    sources = spark.createDataFrame([(0, 100), (1, 1), (2, 899)], "source_ix int, n_slots bigint")
    got = mixing.schedule(sources).collect()
    assert {(r.source_ix, r["rank"]) for r in got} == {(s, k) for s, n in ((0, 100), (1, 1), (2, 899)) for k in range(n)}
    first = sum(r.source_ix == 0 for r in got if r.slot < 200)
    assert 17 <= first <= 23


def test_schedule_of_more_than_a_thousand_million_slots(spark):
    """Only cells of the points that hold small sources' intervals are made, not the whole schedule."""
    n_slots = [1, 1_500_000_000, 1, 2, 700_000_000, 1]
    bits = mixing.bits_for(sum(n_slots))
    assert bits == 32
    sources = spark.createDataFrame(list(enumerate(n_slots)), "source_ix int, n_slots bigint")
    turned = lambda u: int(f"{u:0{bits}b}"[::-1], 2)
    ends = np.cumsum(n_slots).tolist()
    wanted = {turned(u): k for k in (0, 2, 3, 5) for u in range(ends[k] - n_slots[k], ends[k])}
    wanted |= {turned(u): None for u in (ends[-1], (1 << bits) - 1)} | {turned(ends[1] - 1): 1, turned(ends[4] - 1): 4}
    points = spark.createDataFrame([(k,) for k in wanted], "id bigint")
    got = {r.slot: r.source_ix for r in mixing.dealt(points, sources, bits).collect()}
    assert got == {k: v for k, v in wanted.items() if v is not None}
    back = spark.range(1000).select("id", mixing.reversed_bits(mixing.reversed_bits(F.col("id"), 62), 62).alias("x")).filter("id <> x").count()
    assert back == 0


# ---- 4: personal data ---------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn(d) or k == "phone" and 8 <= len(d) <= 15:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_against_brute_force(spark, real):
    odd = ["a@b.com_x@y.z", "1.2.3.4.5.6.7.8 1.2.3.4", "é 4111 1111 1111 1111 😀 +1 (988) 555-2485", "a@b", "x@y.z.", "256.1.1.1 0001.02.03.255", "+1()+22 333 4444-5", "4111-1111-1111-1111-", "@@a@b.c@d.e", "12345678901234567890 4111111111111111 1", "+" * 50 + "1 23456789", "9" * 3000, "a" * 20_000 + "@", "a.b@c.d e.f@g.h.i,j@k.l", "+1 2 "]
    texts = [(r.doc_id, r.text) for r in real.collect()] + [(10_000 + i, t) for i, t in enumerate(odd)] + [(r[0] and r[0] + 100_000, r[1]) for r in ODD]
    got = pii.digest(pii.detect(docs(spark, texts))).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got}
    for i, t in texts:
        want = base_spans(t)
        assert by_id[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(by_id[i].spans.split(",")) | {""} and by_id[i].n_email == sum(x.startswith("email") for x in want)


def test_pii_boosting_adds_like_spans(spark):
    rng = random.Random(5)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"please call me at +1 {number()} today") for i in range(200)] + [(1000 + i, f"code 12-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}x") for i in range(200)] + [(5000, f"please call me at {number()} today")]
    spans = {r.doc_id: r.spans for r in pii.digest(pii.detect(docs(spark, rows))).collect()}
    assert spans[5000] == "phone:18:32" and spans[1000] == ""


@pytest.mark.parametrize("share", [0.1, 0.5])
def test_pii_boosting_adds_common_non_base_spans(spark, share):
    rng = random.Random(6)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    n = int(400 * share)
    rows = [(i, f"please call me at {'' if i < n else '+1 '}{number()} today") for i in range(400)]
    rows += [(1000 + i, f"see order {number()} there") for i in range(40)] + [(2000, "write to jo [at] mail [dot] org")]
    rows += [(3000 + i, f"write to jo{i}@mail.org") for i in range(40)] + [(4000 + i, f"pay 2 @ {i}.50 now") for i in range(40)]
    spans = {r.doc_id: r.spans for r in pii.digest(pii.detect(docs(spark, rows))).collect()}
    assert sum(spans[i].startswith("phone:18:") for i in range(n)) >= 0.9 * n
    assert not any(spans[1000 + i] or spans[4000 + i] for i in range(40))
    assert spans[2000] == "email:9:31"


def test_pii_known_wrong(spark):
    texts = ["4111 1111 1111 1112", "4111.1111.1111.1111", "1[.]2[.]3[.]999", "1[.]2[.]3[.]99", "1,234,567,890", "version 1,2,3,4", "order 212-555-0100", "tel 212-555-0100", "a [at] b [dot] c3", "a [at] b [dot] com", "0171/5551234"]
    found = {r.doc_id: r for r in pii.candidates(docs(spark, list(enumerate(texts)))).filter("not decoy").collect()}
    state = lambda i, k: {"right" if c.y else "wrong" if c.w else "open" for c in found[i][f"loose_{k}"]}
    assert state(0, "card") == {"wrong"} and state(1, "card") == {"open"}
    assert [state(i, "ip") for i in (2, 3, 4, 5)] == [{"wrong"}, {"open"}, {"wrong"}, {"wrong"}]
    assert [state(i, "phone") for i in (6, 7, 10)] == [{"wrong"}, {"open"}, {"open"}]
    assert state(8, "email") == {"wrong"} and state(9, "email") == {"open"}


def test_pii_many_matches_in_one_text(spark):
    n = 12_000
    text, at, ips, emails = [], 0, [], []
    for i in range(n):
        for own, into in ((f"10.{i % 256}.{i // 256}.7", ips), (f"a{i}@b.co", emails)):
            into.append((at, at + len(own)))
            text.append(own)
            at += len(own) + 1
    row = pii.detect(docs(spark, [(1, " ".join(text))])).first()
    assert [(x.s, x.e) for x in row.base_ip] == ips and [(x.s, x.e) for x in row.base_email] == emails


def test_pii_thins_spans_from_the_left(spark):
    rng = random.Random(5)
    spans = sorted({(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 400) for _ in range(300))}, key=lambda x: (x[0], -x[1]))
    want, end = [], 0
    for s, e in spans:
        if s >= end:
            want.append((s, e))
            end = e
    table = spark.createDataFrame([(1, spans), (2, [])], "i int, x array<struct<s:bigint,e:bigint>>")
    found = {r.i: [(x.s, x.e) for x in r.x] for r in table.withColumn("x", pii.thinned(F.col("x"))).collect()}
    assert found == {1: want, 2: []}


def test_pii_coarsens_features_past_the_bound(spark, monkeypatch):
    rng = random.Random(8)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    table = docs(spark, [(i, f"call me at {'' if i % 5 == 0 else '+1 '}{number()} today") for i in range(100)] + [(200 + i, f"{'x' * (i % 9)} code {rng.randint(10, 99)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}x") for i in range(40)])
    found = common.written(pii.candidates(table), "t")
    fine, bits = pii.counted(found)
    assert bits == 0
    monkeypatch.setattr(pii, "MOST_VECTORS", len(fine) - 1)
    coarse, bits = pii.counted(found)
    assert bits > 0 and len(coarse) < len(fine) and sum(r.n for r in coarse) == sum(r.n for r in fine)
    assert pii.refined((0, 1, -1.0, 1.0), 2) == (0, 7, -1.0, 1.0)
    assert pii.digest(pii.detect(table)).filter("n_phone > 0").count() == 80


def test_boosting_fits_counts():
    v = lambda *x: tuple(x) + (0,) * (len(pii.FEATURES) - len(x))
    counts = [(v(a, b), held, (a > 2) != (b > 1), 20) for a in range(5) for b in range(4) for held in (False, True)]
    model = pii.boost(counts)
    assert all((model.margin(x) >= model.threshold) == y for x, held, y, _ in counts)
    assert pii.boost([(v(1), False, True, 5)]).threshold == math.inf


# ---- 5: token files -----------------------------------------------------------------------


def test_token_files_round_trip(spark, real, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(20_000 + i, x) for i, x in enumerate([" a  b", " \n x", "a \nb\n\n c ", "x. y,. z.. ½. 12. 3, <|endoftext|> a<|endoftext|> b", "a , b . c's 'd ,x .y don't.'s", "a b   c", "Ⅷ. a_b. ́x.", "a.\nB c\n\nD.\n E\r\nF, \u00a0g \u2003h \u3000 i", "x <|endoftext|> y<|endoftext|>.Z <|endoftext|", " 'll we'll.\nit's:'s é,\né ñ\nn —\nz", "a\x1c b \x1cc d\x85 e"])]
    rows = [(r.doc_id, r.text) for r in real.collect()] + odd + [(r[0] + 100_000, r[1]) for r in ODD if r[0] is not None]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(docs(spark, rows).repartition(3), sequence=64).collect())
    at, want = 0, []
    for i, x in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_token_file_random_access(tmp_path):
    uri = f"file://{tmp_path}/a.arrow"
    w = token_files.Writer(uri, np.uint16, sequence=8, batch=2)
    ids = np.arange(1, 46, dtype=np.uint16)
    for a, b in ((0, 3), (3, 40), (40, 40), (40, 45)):
        w.add(ids[a:b])
    w.close()
    f = token_files.TokenFile(uri)
    flat = np.concatenate([f.ids(i) for i in range(len(f))])
    mask = np.concatenate([f.mask(i) for i in range(len(f))])
    assert len(f) == 6 and (flat[:45] == ids).all() and mask[:45].all() and not mask[45:].any()
    assert not f.ids(0).flags.owndata and (f.tokens(14, 20) == ids[14:34]).all()


# ---- 6: Jaccard join ----------------------------------------------------------------------


def components_by_hand(rows, linked):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and linked(rows[i], rows[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [least[root(i)] for i in range(len(rows))]


def shingle_set(text, size=4):
    w = re.findall(SPACED, low(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize("small,chunk", [(16, 4096), (2, 16)])
def test_jaccard_against_brute_force(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "CHUNK_NODES", chunk)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 20_000)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    shared, rows = [word() for _ in range(60)], []
    for base in range(6):
        text = [word() for _ in range(rng.choice([4, 9, 30, 100, 400]))]
        for _ in range(25):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, " ".join(shared + [word() for _ in range(rng.randint(5, 90))])) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  B"), (2004, "b a"), (2005, " \n")]
    sets = {i: shingle_set(t) for i, t in rows}

    def near(x, y):
        a, b = sets[x[0]], sets[y[0]]
        return bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)

    want = components_by_hand(rows, near)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, rows)).collect()}
    assert got == {r[0]: (len(sets[r[0]]), c) for r, c in zip(rows, want)}
    assert len(set(want)) < len(rows) - 60


def test_unlike_large_sets_form_no_group():
    """Of 3,000 shingles the 1,024-bit sketches of any two sets passed the Hamming test."""
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3000, 2900, 2500, 2000)]
    like = np.unique(np.concatenate([sets[0][:2800], sets[1][:200]]))
    test = lambda x, y: bool(jaccard.near_enough(*(jaccard.narrowed([jaccard.folded(s)], min(len(jaccard.folded(x)), len(jaccard.folded(y))) // 8) for s in (x, y)), len(x), len(y), 80)[0])
    assert not any(test(x, y) for x in sets for y in sets if x is not y)
    assert jaccard.linked(sets[0], like, 80) and test(sets[0], like)


def test_jaccard_copies_of_a_large_group_meet_in_no_tile(spark, monkeypatch):
    """Near copies of one text are one part after a comparison each; their sets go into no tile."""
    rows = [(i, " ".join(f"w{k if k != i else k + 1000}" for k in range(300))) for i in range(200)]
    dealt, tiled = [], jaccard._tiled
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(jaccard, "_tiled", lambda r, chunk, near, exact: (dealt.append((exact, r.count())), tiled(r, chunk, near, exact))[1])
    got = jaccard.join(docs(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and [c for exact, c in dealt if exact] == [0]


def test_jaccard_edges(spark):
    got = jaccard.join(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id == 4} == {4}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.join(docs(spark, [])).count() == 0


def test_sketch_blocks_find_all_near_sets():
    rng, ends = np.random.default_rng(7), jaccard.bands()
    for n in (3, 7, 14, 40, 173, 900):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
            drop = rng.integers(0, int(jaccard.most_apart(2 * n)) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[: max(1, len(a) - drop)], rng.integers(0, 1 << 63, drop // 2, np.uint64)]))
            if jaccard.linked(a, b, 85) and not np.array_equal(a, b):
                assert np.intersect1d(jaccard.block_keys(a, ends), jaccard.block_keys(b, ends)).size
            x, y = (np.frombuffer(jaccard.folded(s), np.uint64) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


# ---- 8: language model --------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
@pytest.mark.parametrize("spread", [1, 40, 1 << 40])
def test_elias_fano(n, spread):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, n * spread + 1, n).astype(np.uint64))
    s = ngram_trie.Sequence(ngram_trie.encode(values))
    assert np.array_equal(s.decode(), values)
    q = np.concatenate([values, rng.integers(0, n * spread + 100, 500).astype(np.uint64)])
    rank, found = s.search(q)
    assert np.array_equal(rank, np.searchsorted(values, q)) and np.array_equal(found, np.isin(q, values))


@pytest.mark.parametrize("segment,run", [(1_000_000, 1 << 20), (3_000, 100_000), (70, 100_000)])
def test_lm_against_brute_force(spark, monkeypatch, real, segment, run):
    monkeypatch.setattr(lm_scoring, "SEGMENT_VALUES", segment)
    monkeypatch.setattr(lm_scoring, "RUN_BYTES", run)
    rows = [(r.doc_id, r.text) for r in real.collect()] + [r for r in ODD if r[0] not in (None, 4)]
    rows = [(i + 1000 * (k >= 200), t) for k, (i, t) in enumerate(rows)]
    if segment == 70:  # words and contexts split over several segments
        rows = rows[190:]
    from collections import Counter

    token = {i: [*re.findall(SPACED, low(t)), None] for i, t in rows}
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, w in token.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c1.update(w), c2.update(zip(w, w[1:])), c3.update(zip(w, w[1:], w[2:]))
    n, v, d = sum(c1.values()), len(c1), lm_scoring.DISCOUNT
    k1, k2 = Counter(a for a, _ in c2), Counter((a, b) for a, b, _ in c3)
    p1 = lambda w: (c1[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda a, w: max(c2[a, w] - d, 0) / c1[a] + d * k1[a] / c1[a] * p1(w) if k1[a] else p1(w)
    p3 = lambda a, b, w: max(c3[a, b, w] - d, 0) / c2[a, b] + d * k2[a, b] / c2[a, b] * p2(b, w) if k2[a, b] else p2(b, w)
    got = {r.doc_id: r for r in lm_scoring.score_all(docs(spark, rows)).collect()}
    for i, w in token.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c1[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10(p1(x)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        exact = sum(math.log10(p1(x) if j == 0 else p2(w[j - 1], x) if j == 1 else p3(w[j - 2], w[j - 1], x)) for j, x in enumerate(w))
        assert abs(r.score - exact) <= 0.12 * len(w)
    held = [r for r in got.values() if r.held_out]
    assert segment == 70 or sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_counts_beyond_32_bits(spark, tmp_path):
    v, big = np.array([5, 9], np.uint64), np.array([1 << 33, 7], np.uint64)
    none = np.zeros(2, np.uint64)
    rows = [lm_scoring._asked({"run": k, "file": "f", "at": 0}, none, none, v, 0, big, none, none).to_pylist()[0] for k in (0, 1)]
    asked = spark.createDataFrame([tuple(r.values()) for r in rows], lm_scoring.ASKED)
    got = lm_scoring.built(asked, f"file://{tmp_path}", 1).first()
    assert (got["size"], got.total) == (2, 2 * (1 << 33) + 14)
    assert lm_scoring.unpack(ngram_trie.read(f"{got.uri}.counts", 0)["train"]).tolist() == [1 << 34, 14]


def test_lm_packing():
    for x in (np.zeros(0, np.uint64), np.array([0, 255, 256, 1 << 63], np.uint64), np.arange(70_000)):
        assert np.array_equal(lm_scoring.unpack(lm_scoring.pack(x)), x)
    up = np.array([3, 3, 1 << 40, (1 << 64) - 1], np.uint64)
    assert np.array_equal(lm_scoring.risen(lm_scoring.rising(up)), up)


def test_lm_edges(spark):
    assert lm_scoring.score_all(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm_scoring.score_all(docs(spark, [(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


# ---- 9: sharding --------------------------------------------------------------------------


def test_sharding(spark, real):
    rows = [(r.doc_id, r.text) for r in real.collect()] + [(r[0] and r[0] + 100_000, r[1]) for r in ODD]
    got = sharding.shard(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sizes = {i: len((t or "").encode()) + 1 for i, t in rows}
    assert all(r.size == sizes[r.doc_id] for r in got)
    crc = {i: zlib.crc32((t or "").encode()) for i, t in rows}
    assert all(r.text_crc32 == crc[r.doc_id] for r in got)
    again = sharding.shard(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_placement_by_an_independent_tree(spark):
    """The law recomputed: two regions of two racks of four shards, least draw at each level."""
    def draw(key, path, weight):
        return -math.log((int(hashlib.md5(f"{key}|{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight

    def descend(key, grown):
        tops = [("r0", 8.0), ("r1", 8.0)] + ([("r2", 1.0)] if grown else [])
        r = min(tops, key=lambda t: draw(key, f"/{t[0]}", t[1]))[0]
        if r == "r2":
            return 16
        k = min(("k0", "k1"), key=lambda k: draw(key, f"/{r}/{k}", 4.0))
        first = 8 * int(r[1]) + 4 * int(k[1])
        return min(range(first, first + 4), key=lambda s: draw(key, f"/{r}/{k}/s{s}", 1.0))

    rows = sharding.shard(docs(spark, [(i, "x") for i in range(500)] + [(None, "y")])).collect()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (descend(key, False), descend(key, True))


def test_weights_move_only_what_they_must(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    a = sharding.balanced(8, weights=[1.0] * 8)
    b = sharding.balanced(8, weights=[1.0] * 7 + [3.0])
    rows = keys.select(sharding.place(F.col("k"), a).alias("a"), sharding.place(F.col("k"), b).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    # shard 7 lies in region 1, rack 1: nothing leaves that rack, and within it only 7 gains
    assert all(not (x in (6, 7) and y not in (6, 7)) for x, y in moved)
    assert all(y == 7 for x, y in moved if x == 6)
    share = sum(r.b == 7 for r in rows) / len(rows)
    assert abs(share - 0.3) < 0.02
    with pytest.raises(ValueError):
        sharding.place(F.lit("x"), sharding.balanced(4, weights=[0.0] * 4))


# ---- 10: metric join ----------------------------------------------------------------------


def test_metric_pivots_prune_clusters_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 50)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 16))
    rows = [(k, (base[k % 20] + rng.normal(0, 0.02, 16)).tolist(), 0) for k in range(1000)]
    points = common.written(metric_join.nodes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")), "t")
    told = metric_join.replication(metric_join.celled(points, float(np.sqrt(2 - 2 * 0.93)))).first()
    assert told.vectors == 1000 and told.cells > 5 and told.compared < 0.25
    huge = spark.createDataFrame([(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [1e200, -1e200], 0)], "vec_id bigint, embedding array<double>, label int")
    assert sorted((r.vec_id, r.component_id) for r in metric_join.near_duplicates(huge).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert metric_join.near_duplicates(huge.limit(0)).count() == 0


@pytest.mark.parametrize("cell,chunk", [(4000, 4096), (20, 16)])
def test_metric_join_against_brute_force(spark, monkeypatch, cell, chunk):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=6)
            rows += [(len(rows) + k, (base + rng.normal(0, 0.18, 6)).tolist(), label) for k in range(rng.integers(1, 12))]
    twin = rows[0][1]
    rows += [(900 + k, twin, 0) for k in range(5)] + [(910, None, 0), (911, [0.0] * 6, 0), (912, [float("nan")] * 6, 0), (913, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (914, [], 0), (915, [1.0, 2.0], 0), (916, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (917, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (918, [float("inf")] + [0.0] * 5, 0), (None, twin, 0)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, v string, n int")
    data = {r.vec_id: (r.label, r.embedding) for r in frame.collect() if r.vec_id is not None}

    def usable(x):
        return x is not None and len(x) > 0 and all(c is not None and math.isfinite(c) for c in x) and any(c != 0 for c in x)

    def near(p, q):
        (la, a), (lb, b) = data[p], data[q]
        if la is None or la != lb or not usable(a) or not usable(b) or len(a) != len(b):
            return False
        a, b = np.array(a, float), np.array(b, float)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93

    ids = sorted(data)
    want = components_by_hand([(i,) for i in ids], lambda x, y: near(x[0], y[0]))
    links = {i: sum(near(i, j) for j in ids if j != i) for i in ids}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_duplicates(frame).collect()}
    assert len(got) == len(rows) and got.pop(None) == (0, None, False)
    # the row without an id is a copy of a vector, yet links with nothing
    assert got == {i: (links[i], c, i == c) for i, c in zip(ids, want)}


# ---- the pipeline -------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = spark.createDataFrame([(10**6, "123 ...", "en", "src1", 7), (10**6 + 1, items.first().text, "en", "src1", 9), (10**6 + 2, None, None, None, None)], docs_.schema)
    sf = str(tmp_path)
    docs_.unionByName(extra).write.parquet(f"{sf}/documents.parquet")
    items.write.parquet(f"{sf}/benchmark.parquet")
    table, kept = common.documents(spark, sf), {}
    for name, stage in p.STAGES:
        out = common.written(stage(spark, table, sf), "t")
        if name != "sharding":
            assert sorted(out.columns) == sorted(p.COLUMNS)
        kept[name], table = [r.doc_id for r in out.collect()], out
    assert not {10**6, 10**6 + 2} & set(kept["language"]) and 10**6 + 1 in kept["near_duplicates"]
    assert 10**6 + 1 not in kept["decontamination"]
    texts = {r.doc_id: r.text for r in docs_.unionByName(extra).collect()}
    sets = {i: shingle_set(texts[i], 5) for i in kept["language"]}
    rows = [(i,) for i in sorted(sets)]
    want = components_by_hand(rows, lambda x, y: bool(sets[x[0]]) and bool(sets[y[0]]) and 100 * len(sets[x[0]] & sets[y[0]]) >= 80 * len(sets[x[0]] | sets[y[0]]))
    assert sorted(kept["near_duplicates"]) == sorted(set(want))
    bad = {d for d, n, h, _ in found_by_hand([(i, texts[i]) for i in kept["near_duplicates"]], [(r.item_id, r.text) for r in items.collect()]) if h and 20 * h >= n}
    assert sorted(kept["decontamination"]) == sorted(set(kept["near_duplicates"]) - bad)
    assert max(map(kept["mixing"].count, set(kept["mixing"]))) <= 3 and sorted(kept["mixing"]) == sorted(kept["sharding"])
    assert p.run(spark, sf).count() == len(kept["sharding"])


def test_stages_keep_extra_columns_and_judge_rows_by_their_texts(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    bad, x, y, z = words(40), words(60), words(60), words(60)
    spark.createDataFrame([(1, bad)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(7, x), (7, y), (3, x), (None, z), (None, z + " more"), (None, bad), (5, bad + " " + words(5)), (5, words(50)), (9, None), (9, "")] + [(100 + i, words(30)) for i in range(30)]
    extra = "_id string, _times int, _copy int, score string, key string, twin int, times string, copy string, rejected int, `group` int, id string, `a b` int, Doc_key int"
    rows = [(i, t, "en" if k % 2 else "fr", "src", None, "i", 1, 2, "s", "k", 3, "t", "c", 4, 5, "id", 6, k) for k, (i, t) in enumerate(texts)]
    table = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
    kept = {}
    for name, stage in p.STAGES[:-1]:
        out = common.written(stage(spark, table, str(tmp_path)), "t")
        assert out.schema == table.schema or [f.name for f in out.schema] == [f.name for f in table.schema]
        got = out.collect()
        assert all((r["score"], r["_id"], r["_times"], r["rejected"], r["a b"]) == ("s", "i", 1, 4, 6) for r in got)
        kept[name], table = [(r.doc_id, r.text) for r in got], out
    assert not any(t is None or t == "" for _, t in kept["language"])
    near = kept["near_duplicates"]
    assert (7, y) in near and (3, x) in near and (7, x) not in near and len(near) == len(set(near))
    assert sum(t.startswith(z) for _, t in near) == 1 and sum(t.startswith(bad) for _, t in near) == 1
    assert not any(t.startswith(bad) for _, t in kept["decontamination"]) and len(kept["decontamination"]) == len(near) - 1
    empty = table.limit(0)
    for name, stage in p.STAGES:
        assert common.written(stage(spark, empty, str(tmp_path)), "t").count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
