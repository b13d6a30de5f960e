"""Personal data in texts: fixed patterns, and boosted trees over the spans that wider patterns propose.

Every proposed span becomes a vector of whole numbers from its format and its surroundings. Labelled windows of documents
and rule-made sentences are counted by vector with Spark; for each kind, symmetric trees are grown on a part of the counts,
their threshold is set on a second and their errors are measured on a third. The trees are arrays of features, limits and
leaves, so scoring is a sum of lookups inside the query.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import let, spread, stash, uniform
from quantloom.llm.spans import apart, listed, matches, named, replaced

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds, written so that no text takes more than linear time: a search can only begin where a
#: run begins or the last match ended, and runs are not given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider patterns: what they find is only proposed.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]\x20?(?i:at)\x20?[\])]\x20?|\x20(?i:at)\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?i:dot)\x20?[\])]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.|\x20?[\[(]\.[\])])[0-9]{1,3}+(?:\.|\x20?[\[(]\.[\])])[0-9]{1,3}+(?:\.|\x20?[\[(]\.[\])])[0-9]{1,3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}([\x20./-]?)[0-9]{4,6}+\1[0-9]{4,5}+(?:\1[0-9]{1,4}+)?(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Fixed words of the surroundings.
HINTS = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|addr|login|client",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": r"phone|\btel|call|mobile|\bfax|ruf|llam|appel",
}
DECOYS = "order|invoice|isbn|serial|version|part|ticket|ref|sku|tracking|build|total"
#: Bounds of the labelled sample: rule-made sentences, and expected number of documents whose windows are labelled.
SENTENCES, DOCS = 3000, 4000
#: Characters of a window on each side of a span, and those on each side that features look at.
AROUND, BEFORE, AFTER = 60, 32, 12
#: Trees of a kind, their step and depth, most limits tried for a feature.
ROUNDS, RATE, DEPTH, LIMITS = 30, 0.3, 3, 12
#: Of five parts of the labelled windows, by a hash, one sets the thresholds, one measures the errors, the others are learned.
FOLDS, SETS_LIMIT, MEASURES = 5, 0, 1
#: Features of a proposed span: lengths and counts, whether its format is right, the distance from a hint's and a decoy's word
#: (FAR: none), what it is glued to, and the tenths of digits and letters around.
FEATURES = ("length", "digits", "right", "kinds_of_digits", "separators", "brackets", "prefix", "hint", "decoy", "glued", "digits_around", "letters_around")
FAR = 99


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(s), ""), lambda c: c != ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def octets(s: Column) -> Column:
    """Whether all numbers in a string are 255 at most."""
    parts = F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))
    return F.forall(parts, lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(F.when(F.length(q) <= 3, q).try_cast("int"), F.lit(0)) <= 255)))


def base(text: Column) -> dict[str, Column]:
    """Arrays of the base kinds' spans; failing matches are dropped and the search goes on after them."""
    n = lambda m: F.length(digits(m["s"]))
    return {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP), lambda m: octets(m["s"])),
        "card": F.filter(matches(text, CARD), lambda m: n(m).between(13, 19) & luhn(digits(m["s"]))),
        "phone": F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda m: n(m).between(9, 15)),
    }


def _features(text: Column, kind: str, m: Column) -> Column:
    """FEATURES of a proposed span, as an array of whole numbers."""

    def vector(x):
        s, before, after, d = x["s"], x["before"], x["after"], x["d"]
        n = F.length(d)
        if kind == "email":
            right = s.rlike(r"(?i)(?:\.|dot[\])\x20]*)[a-z]{2,}$")
        elif kind == "ip":
            right = octets(s)
        elif kind == "card":
            right = n.between(13, 19) & luhn(d)
        else:
            right = n.between(10, 13)
        since = lambda words: F.when(before.rlike(f"(?i){words}"), F.length(F.regexp_extract(before, f"(?i)^.*(?:{words})(.*)$", 1))).otherwise(F.lit(FAR))
        share = lambda pattern: F.floor(10 * F.regexp_count(F.concat(before, after), F.lit(pattern)) / F.greatest(F.length(before) + F.length(after), F.lit(1)))
        glued = before.rlike(r"[A-Za-z0-9_#$/=.-]$").cast("int") + after.rlike(r"^[A-Za-z0-9_/=-]").cast("int")
        numbers = [
            F.length(s), n, right.cast("int"), F.size(F.array_distinct(F.split(d, ""))), F.regexp_count(s, F.lit(r"[\x20./-]")), F.regexp_count(s, F.lit(r"[(\[]")), s.rlike(r"^\+|^00").cast("int"),
            since(HINTS[kind]), since(DECOYS), glued, share("[0-9]"), share(r"\p{L}"),
        ]
        return F.array(*(F.coalesce(c.cast("int"), F.lit(0)) for c in numbers))

    start = F.greatest(m["start"] - BEFORE, F.lit(0))
    flat = F.translate(F.substring(text, start + 1, m["start"] - start), "\r\n", "  ")
    around = F.struct(m["s"].alias("s"), flat.alias("before"), F.substring(text, m["end"] + 1, F.lit(AFTER)).alias("after"), digits(m["s"]).alias("d"))
    return let(around, vector)


def proposed(text: Column) -> Column:
    """All proposed spans with kind and features; they may overlap. They have digits, or the word `at`."""
    digit, at = text.rlike("[0-9]"), text.rlike(r"(?i)[\x20(\[]at[\x20)\]]")

    def of(i: int, kind: str) -> Column:
        found = matches(text, WIDE[kind], (at if kind == "email" else digit) & text.rlike(WIDE[kind]))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(i).alias("rank"), _features(text, kind, m).alias("x")))

    return F.concat(*(of(i, kind) for i, kind in enumerate(KINDS)))


@dataclass
class Trees:
    """Symmetric trees: each asks DEPTH questions, feature over limit, whose answers are the bits of its leaf's number."""

    feature: list[int] = field(default_factory=lambda: [0] * (ROUNDS * DEPTH))
    limit: list[int] = field(default_factory=lambda: [0] * (ROUNDS * DEPTH))
    leaf: list[float] = field(default_factory=lambda: [0.0] * (ROUNDS << DEPTH))

    def odds(self, x: list[int]) -> float:
        return sum(self.leaf[(t << DEPTH) + sum((x[self.feature[t * DEPTH + q]] > self.limit[t * DEPTH + q]) << q for q in range(DEPTH))] for t in range(ROUNDS))


@dataclass
class Model:
    """trees and threshold (of the log-odds) by kind; precision and recall, measured among proposed spans that neither the
    trees nor the thresholds have seen; None where there are none."""

    trees: dict[str, Trees]
    threshold: dict[str, float]
    precision: dict[str, float | None]
    recall: dict[str, float | None]


def grow(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> Trees:
    """Trees by gradient boosting on counts of (positive, negative) by vector; every level takes the question of most gain."""
    trees = Trees()
    if not len(x):
        return Trees(leaf=[-1.0] * (ROUNDS << DEPTH))
    n, score = (yes + no).astype(float), np.zeros(len(x))
    questions = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        cuts = values[:-1] if len(values) <= LIMITS else np.unique(np.quantile(x[:, f], np.linspace(0, 1, LIMITS + 2)[1:-1]).astype(int))
        questions += [(f, int(c), (x[:, f] > c).astype(np.int64)) for c in cuts]
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = yes - p * n, p * (1 - p) * n
        at = np.zeros(len(x), np.int64)
        for q in range(DEPTH):
            size = 2 << q
            gains = []
            for _, _, bit in questions:
                to = at + (bit << q)
                gains.append(float((np.bincount(to, g, size) ** 2 / (np.bincount(to, h, size) + 1)).sum()))
            if questions:
                f, cut, bit = questions[int(np.argmax(gains))]
                trees.feature[t * DEPTH + q], trees.limit[t * DEPTH + q] = f, cut
                at = at + (bit << q)
            else:
                trees.limit[t * DEPTH + q] = 1 << 30
        leaf = RATE * np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + 1)
        trees.leaf[t << DEPTH : (t + 1) << DEPTH] = [round(float(v), 6) for v in leaf]
        score += np.array(trees.leaf[t << DEPTH : (t + 1) << DEPTH])[at]
    return trees


def odds(model: Model, rank: Column, x: Column) -> Column:
    """The log-odds of a vector by the trees of its kind."""
    array = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    every = [model.trees[k] for k in KINDS]
    feature, limit, leaf = array([f for t in every for f in t.feature], "int"), array([v for t in every for v in t.limit], "int"), array([v for t in every for v in t.leaf], "double")

    def answered(acc, t):
        bits = F.lit(0)
        for q in range(DEPTH):
            bits = bits + F.when(F.element_at(x, F.element_at(feature, t * DEPTH + q + 1) + 1) > F.element_at(limit, t * DEPTH + q + 1), 1 << q).otherwise(0)
        return acc + F.element_at(leaf, t * (1 << DEPTH) + bits + 1)

    return F.aggregate(F.sequence(rank * ROUNDS, rank * ROUNDS + ROUNDS - 1), F.lit(0.0), answered)


def train(labelled: DataFrame, precision: float = 0.98) -> Model:
    """From windows: text, and truth as an array of kind, start, end. A proposed span is right if it is in truth.

    A kind's threshold is the lowest log-odds over which precision is reached in a part of the windows that the trees
    haven't seen; errors are measured on another part.
    """
    found = labelled.select(F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold"), "truth", F.explode(proposed(F.col("text"))).alias("c"))
    right = F.exists("truth", lambda t: (t["kind"] == F.col("c.kind")) & (t["start"] == F.col("c.start")) & (t["end"] == F.col("c.end")))
    part = F.when(F.col("fold").isin(SETS_LIMIT, MEASURES), F.col("fold")).otherwise(-1).alias("part")
    # a row for each different vector of the labelled sample, whose size is a parameter
    counts = found.groupBy(part, F.col("c.kind").alias("kind"), F.col("c.x").alias("x")).agg(F.sum(right.cast("long")).alias("yes"), F.sum((~right).cast("long")).alias("no")).collect()
    model = Model({}, {}, {}, {})
    for kind in KINDS:
        own = sorted((r["part"], tuple(r["x"]), r["yes"], r["no"]) for r in counts if r["kind"] == kind)
        seen = [r for r in own if r[0] == -1]
        trees = grow(np.array([r[1] for r in seen]), np.array([r[2] for r in seen]), np.array([r[3] for r in seen]))
        least, yes, no = math.inf, 0, 0
        for p, y, n in sorted(((trees.odds(r[1]), r[2], r[3]) for r in own if r[0] == SETS_LIMIT), reverse=True):
            yes, no = yes + y, no + n
            if yes / max(1, yes + no) >= precision and p > 0:
                least = p - 1e-6
        judged = [(trees.odds(r[1]) > least, r[2], r[3]) for r in own if r[0] == MEASURES]
        hits, wrong, all_yes = sum(y for o, y, _ in judged if o), sum(n for o, _, n in judged if o), sum(y for _, y, _ in judged)
        model.trees[kind], model.threshold[kind] = trees, least
        model.precision[kind], model.recall[kind] = (hits / (hits + wrong) if hits + wrong else None), (hits / all_yes if all_yes else None)
    return model


def windows(docs: DataFrame, n_docs: int = DOCS) -> DataFrame:
    """text, truth from about n_docs documents, drawn by a hash: what surrounds their spans, labelled by the spans' proof.

    A base span has proved its kind. Its window comes with the span as it is and in a format that no base pattern finds,
    labelled as that kind; a proposed span that overlaps no base one comes with its window and no label.
    """
    n = max(1, docs.count())
    drawn = docs.where(F.col("text").isNotNull() & (uniform(F.lit(6), F.length("text"), F.substring("text", 1, 200)) < n_docs / n)).select("text")
    text, kinds = F.col("text"), base(F.col("text"))
    other = {
        "email": lambda s: F.regexp_replace(F.replace(s, F.lit("@"), F.lit(" at ")), r"\.(?=[A-Za-z0-9-]+$)", " dot "),
        "ip": lambda s: F.replace(s, F.lit("."), F.lit("[.]")),
        "card": lambda s: F.regexp_replace(digits(s), r"^([0-9]{4})([0-9]{4})([0-9]{4})([0-9]+)$", r"$1.$2.$3.$4"),
        "phone": lambda s: F.regexp_replace(s, r"^\+[0-9]{1,2}\x20?", ""),
    }

    def window(s, kind: str | None):
        """A function from a span to its window: before, the span as s tells it, after, kind."""
        before = lambda m: F.substring(text, F.greatest(m["start"] - AROUND, F.lit(0)) + 1, F.least(m["start"], F.lit(AROUND)))
        return lambda m: F.struct(before(m).alias("a"), s(m).alias("s"), F.substring(text, m["end"] + 1, F.lit(AROUND)).alias("b"), F.lit(kind).cast("string").alias("kind"))

    def rewritten(kind: str):
        return lambda m: other[kind](m["s"])

    made = [F.transform(F.col(f"__{kind}"), window(s, kind)) for kind in KINDS for s in (lambda m: m["s"], rewritten(kind))]
    rest = apart(F.transform(proposed(text), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))), F.concat(*(F.col(f"__{k}") for k in KINDS)))
    plain = F.transform(rest, window(lambda m: F.substring(text, m["start"] + 1, m["end"] - m["start"]), None))
    rows = drawn.withColumns({f"__{k}": v for k, v in kinds.items()}).select(F.explode(F.concat(*made, plain)).alias("w")).select("w.*")
    truth = F.array(F.struct(F.col("kind"), F.length("a").alias("start"), (F.length("a") + F.length("s")).alias("end")))
    return rows.select(F.concat("a", "s", "b").alias("text"), F.when(F.col("kind").isNotNull(), truth).otherwise(F.slice(truth, 1, 0)).alias("truth"))


def learn(docs: DataFrame) -> Model:
    """A model from windows of docs (a column text) and rule-made sentences, so that there is one whatever docs hold."""
    made = sentences(docs.sparkSession).select("text", F.col("truth").cast("array<struct<kind:string,start:int,end:int>>").alias("truth"))
    return train(stash(windows(docs).select("text", F.col("truth").cast("array<struct<kind:string,start:int,end:int>>").alias("truth")).unionByName(made), "pii_labelled"))


def sentences(spark: SparkSession, n: int = SENTENCES, seed: int = 11) -> DataFrame:
    """n labelled sentences, made by rule: personal data in several formats and numbers that only look alike."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "the", "re", "ing", "ou", "er", "on", "st", "ti", "ed", "la", "ch", "en")) for _ in range(r.randrange(1, 4)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + number(14)
        total = sum((d if i % 2 else d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, body)))
        return body + str(-total % 10)

    def item() -> tuple[str, str | None, str]:
        """What comes before, kind (None: not personal), text."""
        k = r.randrange(11)
        if k == 0:
            return r.choice(("mail ", "contact ", "", "write to ")), "email", f"{word()}{r.choice((' at ', ' (at) ', ' [at] ', '(at)'))}{word()}{r.choice((' dot ', '.', ' (dot) '))}{r.choice(('com', 'org', 'de'))}"
        if k == 1:
            return "", None, f"{word()} at {word()}.{number(2)}"
        if k == 2:
            return r.choice(("", "host ", "ip ", "from ")), "ip", r.choice((".", "[.]")).join(str(r.randrange(256)) for _ in range(4))
        if k == 3:
            return r.choice(("version ", "build ", "part ")), None, ".".join(str(r.randrange(900)) for _ in range(4))
        if k == 4:
            c, sep = card(), r.choice(("", " ", "-"))
            return r.choice(("", "card ", "visa ", "payment ")), "card", sep.join(c[i : i + 4] for i in range(0, 16, 4))
        if k == 5:
            return r.choice(("order ", "serial ", "tracking ", "")), None, number(16)
        if k in (6, 7):
            a, b, c, f = number(3), number(3), number(4), r.randrange(4)
            return r.choice(("", "call ", "phone ", "tel ")), "phone", (f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+49 {a} {b} {c}", f"{a}-{b}-{c}")[f]
        if k == 8:
            return r.choice(("order ", "part ", "ref ", "isbn ")), None, f"{number(3)}-{number(3)}-{number(4)}"
        if k == 9:
            return r.choice(("total ", "")), None, f"{number(3)}.{number(3)} {number(4)}"
        return "", None, number(r.randrange(2, 30))

    rows = []
    for _ in range(n):
        text, truth = "", []
        for _ in range(r.randrange(1, 4)):
            text += " ".join(word() for _ in range(r.randrange(1, 6))) + " "
            before, kind, found = item()
            text += before
            if kind:
                truth.append({"kind": kind, "start": len(text), "end": len(text) + len(found)})
            text += found + r.choice((" ", ". ", ", ", "; "))
        rows.append({"text": text, "truth": truth})
    made = F.from_json(F.lit(json.dumps(rows)), "array<struct<text:string,truth:array<struct<kind:string,start:int,end:int>>>>")
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def find(docs: DataFrame, model: Model, into: str = "personal") -> DataFrame:
    """docs with a struct column of email, ip, card, phone (arrays of start, end, s) and added (named spans). docs has text.

    Null and empty texts have none; texts of any length are searched whole; repeated rows and ids are each searched for
    itself; an empty table gives no rows. A column of docs that is named as into is replaced, others stay, whatever their
    names. A proposed span over its kind's threshold is added if it overlaps no base span of any kind; added spans of
    different kinds may overlap.
    """
    own = {k: f"__{into}_{k}" for k in (*KINDS, "added")}
    rest = [F.col(f"`{c}`") for c in docs.columns if c != into]
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.withColumns({own[k]: v for k, v in base(text).items()})
    least = F.split(F.lit(",".join(str(min(model.threshold[k], 1e9)) for k in KINDS)), ",").cast("array<double>")
    free = apart(proposed(text), F.concat(*(own[k] for k in KINDS)))
    over = F.filter(free, lambda c: odds(model, c["rank"], c["x"]) > F.element_at(least, c["rank"] + 1))
    chosen = F.transform(over, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.concat(F.lit("likely_"), c["kind"]).alias("kind"), (c["rank"] + len(KINDS)).alias("rank")))
    return x.withColumn(own["added"], chosen).select(*rest, F.struct(*(F.col(v).alias(k) for k, v in own.items())).alias(into))


def spans(into: str = "personal") -> tuple[Column, Column]:
    """All base spans, and all spans, named."""
    own = F.concat(*(named(F.col(f"{into}.{k}"), k, i) for i, k in enumerate(KINDS)))
    return own, F.concat(own, F.col(f"{into}.added"))


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every found span of text replaced by its kind in angle brackets; other texts stay as they are."""
    into = "__found"
    found = find(docs, model, into).withColumn("text", replaced(F.col("text"), spans(into)[1]))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(spread(docs), learn(docs))
    own, every = spans()
    counts = (F.size(f"personal.{k}").cast("long").alias(f"n_{k}") for k in KINDS)
    more = F.size("personal.added").cast("long").alias("n_added"), F.size(every).cast("long").alias("n_all")
    return found.select("doc_id", *counts, F.sha2(listed(own, "rank", "start"), 256).alias("base_sha256"), listed(every, "rank", "start").alias("spans"), *more)
