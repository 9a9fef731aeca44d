"""Personal data by candidate gradient boosting. DataFrame functions only.

Base patterns give spans that always stay. High-recall generators propose further, overlapping
spans of looser formats. Boosted trees score them by format and context. They learn from the base
spans without being told what made these valid: a candidate that overlaps a valid base span of its
kind is right; one that fails a check of its kind (Luhn, octets, length, domain), stands in a decoy
context or lies on a valid span of another kind is wrong; any other is unlabelled. Only right and
wrong ones are fitted and calibrated on, and unlabelled ones over the threshold are added, so how
common they are does not matter. The features leave out the checks. Features are small integers, so the training data are counts by distinct feature vector: Spark
counts them over all candidates of all documents, the driver boosts on that bounded table, and the
trees go back into the plan as CASE expressions. Thresholds come from documents held back.

Patterns are written so that a search is linear in the text: a run of characters is entered only
at its beginning or where the last match ended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
#: Base formats: leftmost matches, with possessive repeats where what follows can't need them back.
BASE = {
    "email": _LOCAL + "@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Generators: wider formats, each with its own bounded repeats.
LOOSE = {
    "email": ["(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+[\\x20]?(?:@|[(\\[]at[)\\]])[\\x20]?[A-Za-z0-9-]{1,63}+(?:[\\x20]?(?:\\.|[(\\[]dot[)\\]])[\\x20]?[A-Za-z0-9-]{1,63}+){1,8}",
              "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\\x20at\\x20[A-Za-z0-9-]{1,63}+(?:\\x20dot\\x20[A-Za-z0-9-]{1,63}+){1,8}"],
    "ip": ["(?<![0-9.])[0-9]{1,5}+(?:[.,\\[\\]]{1,3}[0-9]{1,5}+){3}(?![0-9])",
           "(?<![0-9.])[0-9]{1,5}+(?:\\x20?[(\\[](?:dot|\\.)[)\\]]\\x20?[0-9]{1,5}+){3}(?![0-9])"],
    "card": ["(?<![0-9])[0-9](?:[\\x20.-]?[0-9]){11,18}(?![0-9])",
             "(?<![0-9])[0-9]{4}(?:[\\x20._/-]{1,2}[0-9]{4}){3}(?![0-9])"],
    "phone": ["(?<![0-9])\\(?[0-9]{2,4}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}(?![0-9])",
              "(?<![0-9])\\([0-9]{2,5}\\)\\x20?[0-9]{3,4}[\\x20.-]?[0-9]{3,4}(?![0-9])",
              "(?<![0-9])0[0-9]{1,4}[\\x20/.-][0-9]{2,4}(?:[\\x20.-]?[0-9]{2,4}){1,3}(?![0-9])"],
}
#: A cheap test that a kind's patterns can match at all.
NEEDS = {"email": "@|[(\\[]at[)\\]]|\\x20dot\\x20", "ip": "[0-9][.,\\[]|[0-9]\\x20?[(\\[]", "card": "[0-9][\\x20.-]?[0-9]", "phone": "[0-9]"}
#: Words before a span that tell its kind: fixed values.
HINTS = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|credit|pay", "phone": "tel|phone|call|fax|mobile"}
#: The last word before a span that is no personal data.
DECOY = "(?i)(?:^|[^\\p{L}])(?:version|ver|v|rev|build|release|section|chapter|order|invoice|isbn|issn|serial|sku|part|code|ref|item|lot|batch|model|article|id|no)[^\\p{L}]*$"
#: Candidates known to be wrong that are counted beside a corpus's own, which may have none.
DECOYS = (
    "take 2 @ 3.50 or 12 @ 10.75", "300 @ 1.25.00", "section 10.300.2.999 and 1,234,567,890", "version 2.500.3.700, build 10.20.300.4000",
    "order 1234 5678 9012 3456, serial 9876543210987654", "isbn 9780306406157x", "part 212-555-0100x, code 12-345-6789x", "serial 000 000 0000, ref (000) 000-0000a",
)
FEATURES = ("digits", "length", "separators", "brackets", "letters", "before", "after", "hint", "repeats", "first")
ROUNDS, RATE, DEPTH, BINS = 40, 0.3, 3, 6
#: Share of right spans above a threshold, on documents held back; distinct feature vectors on the
#: driver at most: past it, features are halved until they fit. Three times leaves 2**7 * 2 vectors.
PRECISION = 0.98
MOST_VECTORS = 200_000
CONTEXT = 24


def located(text: Column, pattern: str) -> Column:
    """Matches of pattern: array of (s, e, m, b, a), with the text before and the character after."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pieces = F.transform(between, lambda p: F.struct(F.char_length(p).cast("bigint").alias("n"), F.right(p, F.lit(CONTEXT)).alias("b"), F.left(p, F.lit(1)).alias("a")))
    return F.struct(found.alias("m"), pieces.alias("p"))


def items(found: Column) -> Column:
    """Matches of what located() returned: array of (n, l, m, b, a), n the characters since the last one."""
    n = F.size(found["m"])
    left = F.zip_with(found["m"], F.slice(found["p"], 1, n), lambda m, p: F.struct(m.alias("m"), p["n"].alias("n"), p["b"].alias("b")))
    return F.zip_with(left, F.slice(found["p"], 2, n), lambda x, q: F.struct(x["n"].alias("n"), F.char_length(x["m"]).cast("bigint").alias("l"), x["m"].alias("m"), x["b"].alias("b"), q["a"].alias("a")))


def blocks(xs: Column) -> Column:
    """The array column xs cut into arrays of the root of its length: what goes over the blocks and
    then into them takes n ** 1.5 steps at most, not n ** 2. xs has to be a column of its own, as a
    lambda would compute an expression anew for each block."""
    n = F.size(xs)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1, step)).otherwise(F.array().cast("array<int>")), lambda at: F.slice(xs, at + 1, step))


def scanned(xs: Column, out: str, step) -> Column:
    """Runs through the array column xs with a whole number, 0 at first: step(number, x) gives the
    next number and an array of results, which are appended to those (of type `out`) before."""
    begin = lambda at: F.struct(at.alias("at"), F.array().cast(f"array<{out}>").alias("out"))

    def one(acc, x):
        at, found = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], found).alias("out"))

    def block(acc, part):
        own = F.array(F.aggregate(part, begin(acc["at"]), one))
        return F.get(F.transform(own, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out"))), F.lit(0))

    return F.aggregate(blocks(xs), begin(F.lit(0).cast("bigint")), block, lambda acc: acc["out"])


def placed(xs: Column) -> Column:
    """Spans (s, e, m, b, a) of a column of items()."""
    def step(at, x):
        s = at + x["n"]
        return s + x["l"], F.array(F.struct(s.alias("s"), (s + x["l"]).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a")))

    return scanned(xs, "struct<s:bigint,e:bigint,m:string,b:string,a:string>", step)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.get(doubled, c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The base formats' own checks."""
    if kind == "ip":
        parts = F.transform(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    d = digits_of(m)
    n = F.char_length(d)
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _before(kind: str, c: Column) -> Column:
    """The text before a candidate. What stands just there may be the part that makes a wider base
    span: it is looked past."""
    return F.regexp_replace(c["b"], "\\+[0-9]{0,3}[\\x20.-]?$", "") if kind == "phone" else c["b"]


def _vector(kind: str, c: Column) -> Column:
    """A candidate's features: integers from 0 to 9."""
    m = c["m"]
    n, kept = F.char_length(m), lambda pattern: F.char_length(F.regexp_replace(m, pattern, ""))
    group = lambda x: F.when(x.isNull() | (x == ""), 0).when(x.rlike("^[\\x20\\t]$"), 1).when(x.rlike("^[.,;:!?]$"), 2).when(x.rlike("^[\\r\\n]$"), 3).when(x.rlike("^[0-9+]$"), 4).when(x.rlike("^\\p{L}$"), 5).otherwise(6)
    before = _before(kind, c)
    values = {
        "digits": F.least(F.floor(kept("[^0-9]") / 2), F.lit(9)),
        "length": F.least(F.floor(n / 4), F.lit(9)),
        "separators": F.least(n - kept("[\\x20.,-]"), F.lit(9)),
        "brackets": F.least(n - kept("[()\\[\\]]"), F.lit(9)),
        "letters": F.least(F.floor((n - kept("[A-Za-z]")) / 4), F.lit(9)),
        "before": group(F.right(before, F.lit(1))),
        "after": group(c["a"]),
        "hint": F.lower(before).rlike(HINTS[kind]).cast("int"),
        "repeats": F.least(F.size(F.array_distinct(F.split(digits_of(m), ""))), F.lit(9)),
        "first": F.least(F.coalesce(F.substring(digits_of(m), 1, 1).try_cast("int"), F.lit(0)), F.lit(9)),
    }
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


def known_wrong(kind: str, c: Column) -> Column:
    """Whether a candidate that overlaps no base span of its kind fails a check or stands in a decoy context."""
    m, d = c["m"], digits_of(c["m"])
    if kind == "email":
        domain = F.lower(m).rlike("(?:\\.|dot)[)\\]]?\\x20?(?:[a-z]{2,63}|xn--[a-z0-9-]+)$")
        return ~domain | m.rlike("^\\.|\\.\\.|\\.[\\x20]?(?:@|[(\\[]at[)\\]])")
    before = _before(kind, c)
    decoy = F.regexp_replace(before, "[\\x20(]+$", "").rlike(DECOY) | F.right(before, F.lit(1)).rlike("\\p{L}") | c["a"].rlike("^\\p{L}") | d.rlike("^([0-9])\\1+$")
    n = F.char_length(d)
    if kind == "card":
        return decoy | ~n.between(12, 19) | ~luhn(d)
    if kind == "phone":
        return decoy | ~n.between(7, 15)
    octets = F.filter(F.split(m, "[^0-9]+"), lambda p: p != "")
    return decoy | m.rlike("^[0-9]{1,3}(?:,[0-9]{3}){3}$") | ~F.forall(octets, lambda p: p.cast("int") <= 255)


def with_decoys(docs: DataFrame) -> DataFrame:
    """doc_id, text and fold of docs, and rows of DECOYS, ten of each, with a fold under 0 or (held back) of 0 and decoy set."""
    own = docs.select("doc_id", "text", common.fold_of(F.col("doc_id"), 5).cast("int").alias("fold"), F.lit(False).alias("decoy"))
    texts, n = F.array(*map(F.lit, DECOYS)), len(DECOYS)
    more = docs.sparkSession.range(0, 10 * n, 1, 1).select(
        F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.get(texts, (F.col("id") % n).cast("int")).alias("text"),
        F.when(F.col("id") < 2 * n, 0).otherwise(-1).alias("fold"), F.lit(True).alias("decoy"),
    )
    return own.unionByName(more)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, fold, decoy, and per kind: base_<kind> (valid spans) and loose_<kind> (candidates with
    features f, y where they overlap a valid base span, and w where they are known to be wrong)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_decoys(docs).withColumn("text", text)
    columns = {}
    for kind in KINDS:
        usable = F.when(F.col("text").rlike(NEEDS[kind]), F.col("text")).otherwise(F.lit(""))
        columns[f"t_{kind}"] = usable
    rows = rows.withColumns(columns).drop("text")
    rows = rows.withColumns({f"b_{k}": located(F.col(f"t_{k}"), BASE[k]) for k in KINDS} | {f"l_{k}{i}": located(F.col(f"t_{k}"), p) for k in KINDS for i, p in enumerate(LOOSE[k])}).drop(*columns)
    each = [f"b_{k}" for k in KINDS] + [f"l_{k}{i}" for k in KINDS for i in range(len(LOOSE[k]))]
    rows = rows.withColumns({c: items(F.col(c)) for c in each})
    rows = rows.withColumns({c: placed(F.col(c)) for c in each})

    def checked(k):
        return F.transform(F.filter(F.col(f"b_{k}"), lambda c: valid(k, c["m"])), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))

    rows = rows.withColumns({f"base_{k}": checked(k) for k in KINDS})
    # base spans are in order and apart, so a block of them reaches from its first to its last
    reach = lambda g: F.struct(F.element_at(g, 1)["s"].alias("s"), F.element_at(g, -1)["e"].alias("e"), g.alias("own"))
    rows = rows.withColumns({f"g_{k}": F.transform(blocks(F.col(f"base_{k}")), reach) for k in KINDS})

    def judged(k):
        every = F.concat(*[F.col(f"l_{k}{i}") for i in range(len(LOOSE[k]))])
        meets = lambda b, c: (b["s"] < c["e"]) & (c["s"] < b["e"])
        on = lambda kind, c: F.exists(F.col(f"g_{kind}"), lambda g: meets(g, c) & F.exists(g["own"], lambda b: meets(b, c)))

        def one(c):
            wrong = known_wrong(k, c)
            for other in KINDS:
                wrong = wrong | on(other, c) if other != k else wrong
            right = on(k, c)
            return F.struct(c["s"].alias("s"), c["e"].alias("e"), _vector(k, c).alias("f"), right.alias("y"), (~right & wrong).alias("w"))

        return F.array_sort(F.transform(every, one))

    def distinct(k):  # of a sorted array; array_distinct compares all pairs of structs
        c = F.col(f"loose_{k}")
        return F.filter(c, lambda x, i: (i == 0) | (x != F.get(c, i - 1)))

    own = ["doc_id", "fold", "decoy", *[f"base_{k}" for k in KINDS]]
    rows = rows.select(*own, *[judged(k).alias(f"loose_{k}") for k in KINDS])
    return rows.select(*own, *[distinct(k).alias(f"loose_{k}") for k in KINDS])


def counted(found: DataFrame) -> tuple[list, int]:
    """(kind, held, y, f..., n): right and wrong candidates of all documents by feature vector, and
    by how many bits features are coarsened: the least that gives at most MOST_VECTORS rows."""
    parts = None
    for k in KINDS:
        own = found.select(F.lit(k).alias("kind"), (F.col("fold") == 0).alias("held"), F.explode(f"loose_{k}").alias("c")).filter("c.y or c.w").select("kind", "held", F.col("c.y").alias("y"), "c.f.*")
        parts = own if parts is None else parts.unionByName(own)
    for bits in range(4):
        coarse = [F.shiftright(f, bits).alias(f) if f != "hint" else F.col(f) for f in FEATURES]
        rows = parts.select("kind", "held", "y", *coarse).groupBy("kind", "held", "y", *FEATURES).agg(F.count("*").alias("n"))
        out = rows.orderBy(F.desc("n"), "kind", "held", "y", *FEATURES).limit(MOST_VECTORS + 1).collect()
        if len(out) <= MOST_VECTORS:
            break
    return out, bits


# ---- boosting on counts -------------------------------------------------------------------


def grow(rows: list[tuple[tuple, float, float]], depth: int, least: float = 1.0):
    """A regression tree by gain over (vector, gradient, hessian): a leaf value, or (feature, upto, left, right)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = -g / (h + 1.0)
    if depth == 0 or h < 2 * least:
        return leaf
    best = (1e-6, None)
    for f in range(len(FEATURES)):
        by: dict[int, list[float]] = {}
        for v, gr, he in rows:
            x = by.setdefault(v[f], [0.0, 0.0])
            x[0] += gr
            x[1] += he
        gl = hl = 0.0
        for value in sorted(by)[:-1]:
            gl, hl = gl + by[value][0], hl + by[value][1]
            if hl >= least and h - hl >= least:
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, value))
    if best[1] is None:
        return leaf
    f, upto = best[1]
    return f, upto, grow([r for r in rows if r[0][f] <= upto], depth - 1, least), grow([r for r in rows if r[0][f] > upto], depth - 1, least)


def value(tree, v: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
    return tree


def refined(tree, bits: int):
    """A tree over features coarsened by bits as one over the features themselves."""
    if not isinstance(tree, tuple):
        return tree
    f, upto, left, right = tree
    return f, upto if FEATURES[f] == "hint" else ((upto + 1) << bits) - 1, refined(left, bits), refined(right, bits)


class Booster:
    """Boosted trees of one kind with a calibrated threshold; margin() in Python, column() in SQL."""

    def __init__(self, start: float, trees: list, threshold: float):
        self.start, self.trees, self.threshold = start, trees, threshold

    def margin(self, v: tuple) -> float:
        return self.start + RATE * sum(value(t, v) for t in self.trees)

    def column(self, f: Column) -> Column:
        def of(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(f[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        out = F.lit(float(self.start))
        for t in self.trees:
            out = out + F.lit(RATE) * of(t)
        return out


def boost(counts: list[tuple[tuple, bool, bool, int]]) -> Booster:
    """Fit on (vector, held, y, n). Without both labels nothing is selected."""
    fit: dict[tuple, list[float]] = {}
    held: dict[tuple, list[float]] = {}
    for v, back, y, n in counts:
        into = (held if back else fit).setdefault(v, [0.0, 0.0])
        into[int(y)] += n
    pos, neg = sum(x[1] for x in fit.values()), sum(x[0] for x in fit.values())
    if pos == 0 or neg == 0:
        return Booster(0.0, [], math.inf)
    model = Booster(math.log(pos / neg), [], math.inf)
    margins = {v: model.start for v in fit}
    for _ in range(ROUNDS):
        rows = []
        for v, (a, b) in sorted(fit.items()):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, margins[v]))))
            rows.append((v, (a + b) * p - b, (a + b) * p * (1 - p)))
        tree = grow(rows, DEPTH)
        model.trees.append(tree)
        for v in margins:
            margins[v] += RATE * value(tree, v)
    ranked = sorted(((model.margin(v), v) for v in (held or fit)), reverse=True)
    good = bad = 0.0
    for i, (m, v) in enumerate(ranked):
        a, b = (held or fit)[v]
        good, bad = good + b, bad + a
        if (i + 1 == len(ranked) or ranked[i + 1][0] < m) and good >= PRECISION * (good + bad):
            model.threshold = round(m, 9) - 1e-9
    return model


def fit(found: DataFrame) -> dict[str, Booster]:
    rows, bits = counted(found)
    models = {k: boost([(tuple(r[f] for f in FEATURES), r.held, r.y, r.n) for r in rows if r.kind == k]) for k in KINDS}
    for model in models.values():
        model.trees = [refined(t, bits) for t in model.trees]
    return models


def chosen(kind: str, model: Booster) -> Column:
    """Unlabelled candidates above the threshold, by start, the longest first."""
    if math.isinf(model.threshold):
        return F.array().cast("array<struct<s:bigint,e:bigint>>")
    own = F.filter(F.col(f"loose_{kind}"), lambda c: ~c["y"] & ~c["w"] & (model.column(c["f"]) >= model.threshold))
    ordered = F.array_sort(F.transform(own, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("e"))))
    return F.transform(ordered, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("e")))


def thinned(spans: Column) -> Column:
    """Of a column of spans in order, those that begin where the ones taken before have ended."""
    def step(end, c):
        past = end <= c["s"]
        return F.when(past, c["e"]).otherwise(end), F.when(past, F.array(c)).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))

    return scanned(spans, "struct<s:bigint,e:bigint>", step)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _kinds(column: str) -> Column:
    def of(k):
        return F.transform(F.array_sort(F.col(f"{column}_{k}")), lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    return F.concat(*map(of, KINDS))


def detect(docs: DataFrame) -> DataFrame:
    """Spans of every row of docs(doc_id, text, ...): doc_id, base (array of kind, start, end) and all.

    Positions are code points, the end exclusive. A null text is empty and has no spans; repeated
    rows get equal results; an empty table gives an empty result. Other columns are ignored.
    """
    found = common.written(candidates(docs), "candidates")
    models = fit(found)
    found = found.filter("not decoy").withColumns({f"extra_{k}": chosen(k, models[k]) for k in KINDS})
    found = found.withColumns({f"extra_{k}": thinned(F.col(f"extra_{k}")) for k in KINDS})
    found = found.withColumns({f"both_{k}": F.concat(f"base_{k}", f"extra_{k}") for k in KINDS})
    return found.select("doc_id", *[f"base_{k}" for k in KINDS], _kinds("base").alias("base"), _kinds("both").alias("all"))


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns: counts and digest of base spans, and all spans."""
    return spans.select("doc_id", *[F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
