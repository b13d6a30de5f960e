"""Secrets in texts: fixed patterns, and random strings by two Markov models' log-likelihood ratio."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import let, spread, stash, uniform
from quantloom.llm.spans import apart, listed, matches, named

#: Fixed patterns of the base kinds. A failing match is dropped and the search goes on after it; where a minimum length is
#: in the pattern, no other match can come of that.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Strings that the models judge: whole runs of these characters, of LEAST or more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
#: Bounds of the labelled samples: random strings, and expected number of documents whose words make identifiers.
RANDOM, DOCS = 6000, 600
#: Of five parts of the labelled tokens, by a hash, one sets the threshold, one measures the errors, the others are learned.
FOLDS, SETS_LIMIT, MEASURES = 5, 0, 1
KINDS = ("assign", "access", "hex", "random")


@dataclass
class Model:
    """ratio: for each pair of characters, the log-probability of the second among secrets less that among identifiers.

    wrong, missed: the shares of identifiers over the threshold and of secrets not over it, among tokens that neither the
    counts nor the threshold have seen; None where there are none.
    """

    ratio: list[float]
    threshold: float
    wrong: float | None = None
    missed: float | None = None


def _codes(token: Column) -> Column:
    """Places in ALPHABET of a token's characters."""
    places = F.split(F.lit(",".join(str(ALPHABET.find(chr(i))) for i in range(128))), ",").cast("array<int>")
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.element_at(places, F.ascii(c) + 1))


def _pairs(token: Column) -> Column:
    n = len(ALPHABET)
    return let(_codes(token), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * n + b))


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's pairs; the token has ALPHABET's characters only, two or more."""
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    return let(_pairs(token), lambda p: F.aggregate(p, F.lit(0.0), lambda a, i: a + F.element_at(values, i + 1)) / F.size(p))


def train(labelled: DataFrame) -> Model:
    """From token, secret (boolean). Pairs are counted by Spark; the driver gets a count for each pair of characters.

    Tokens that are null or hold other characters than ALPHABET's, or fewer than two, are left out. The threshold lies
    halfway between the ratios that one of 1000 identifiers exceeds and that one of 200 secrets falls short of, or at the
    latter if that is lower, among tokens that aren't counted; the errors are measured on others again.
    """
    n = len(ALPHABET)
    fold = F.pmod(F.xxhash64("token"), F.lit(FOLDS)).alias("fold")
    rows = stash(labelled.where(F.col("token").rlike(r"^[A-Za-z0-9+/_=-]{2,}$")).select("token", "secret", fold), "secrets_labelled")
    counts = [[1.0] * (n * n) for _ in range(2)]  # one of each beforehand
    learned = rows.where(~F.col("fold").isin(SETS_LIMIT, MEASURES))
    for r in learned.select("secret", F.explode(_pairs(F.col("token"))).alias("p")).groupBy("secret", "p").count().collect():
        counts[bool(r["secret"])][r["p"]] += r["count"]
    logs = []
    for c in counts:
        firsts = [sum(c[a * n : (a + 1) * n]) for a in range(n)]
        logs.append([math.log(c[i] / firsts[i // n]) for i in range(n * n)])
    table = [s - o for s, o in zip(logs[1], logs[0], strict=True)]
    judged = rows.where((F.length("token") >= LEAST) & F.col("fold").isin(SETS_LIMIT, MEASURES)).select("secret", "fold", ratio(F.col("token"), table).alias("x"))
    judged = stash(judged, "secrets_judged")
    sets = judged.where(F.col("fold") == SETS_LIMIT)
    ends = sets.agg(F.percentile(F.when(~F.col("secret"), F.col("x")), 0.999).alias("plain"), F.percentile(F.when(F.col("secret"), F.col("x")), 0.005).alias("low")).first()
    if ends["low"] is None:
        return Model(table, math.inf)
    plain = ends["plain"] if ends["plain"] is not None else 0.0
    threshold = max(0.25, min(ends["low"], (plain + ends["low"]) / 2))
    over = (F.col("x") > threshold).cast("double")
    errors = judged.where(F.col("fold") == MEASURES).agg(F.avg(F.when(~F.col("secret"), over)).alias("wrong"), F.avg(F.when(F.col("secret"), 1 - over)).alias("missed")).first()
    return Model(table, threshold, errors["wrong"], errors["missed"])


def random_strings(spark: SparkSession, n: int = RANDOM) -> DataFrame:
    """token, secret: hexadecimal, base 64, upper-case and mixed strings of 16 to 64 characters, by digests of numbers."""
    digest = F.sha2(F.col("id").cast("string"), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), r"[\r\n=]", "")
    size = (16 + F.floor(uniform("id") * 49)).cast("int")
    kind = F.col("id") % 4
    token = F.when(kind == 0, digest).when(kind == 1, b64).when(kind == 2, F.upper(F.regexp_replace(b64, "[+/]", ""))).otherwise(F.regexp_replace(b64, "[+/]", ""))
    return spark.range(n).select(F.substring(token, F.lit(1), size).alias("token"), F.lit(True).alias("secret"))


def identifiers(docs: DataFrame, n_docs: int = DOCS) -> DataFrame:
    """token, secret: words of about n_docs texts as they are, in upper case, and joined to longer names.

    The texts are drawn by a hash of doc_id and length; what the base patterns find in them is taken out before.
    """
    n = max(1, docs.count())
    drawn = docs.where(uniform(F.lit(5), "doc_id", F.length("text")) < n_docs / n)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(clean, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_/-]{2,}+(?![0-9+=])"), F.lit(0))
    rows = drawn.select(words.alias("w")).where(F.size("w") > 0)
    three = lambda sep: F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(3)), lambda i: F.array_join(F.slice("w", i, F.lit(3)), sep))
    names = F.transform(three(" "), lambda s: F.translate(F.initcap(s), " ", ""))
    each = F.concat("w", F.transform("w", F.upper), three("_"), three("-"), three("/"), names, F.transform(three("_"), F.upper), F.transform(F.array_distinct("w"), lambda w: F.concat(w, w, w, w)))
    return rows.select(F.explode(each).alias("token"), F.lit(False).alias("secret"))


def find(docs: DataFrame, model: Model, into: str = "secrets") -> DataFrame:
    """docs with a struct column of arrays assign, access, hex, random, each of start, end, s. docs has a column text.

    Null and empty texts have no secrets; texts of any length are searched whole; repeated rows and ids are each searched
    for itself; an empty table gives no rows. A column of docs that is named as into is replaced, others stay, whatever
    their names. A random span is a candidate over the model's threshold that overlaps no base one; mere numbers are none.
    """
    own = {k: f"__{into}_{k}" for k in KINDS}
    rest = [F.col(f"`{c}`") for c in docs.columns if c != into]
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["s"], ASSIGN, 1)) >= 6)
    x = docs.withColumns({own["assign"]: assign, own["access"]: matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), own["hex"]: matches(text, HEX)})
    base = F.concat(own["assign"], own["access"], own["hex"])
    candidates = F.filter(apart(matches(text, CANDIDATE), base), lambda m: m["s"].rlike("[A-Za-z]") & (ratio(m["s"], model.ratio) > model.threshold))
    return x.withColumn(own["random"], candidates).select(*rest, F.struct(*(F.col(v).alias(k) for k, v in own.items())).alias(into))


def spans(into: str = "secrets") -> tuple[Column, Column]:
    """All base spans, and all spans, named."""
    base = F.concat(*(named(F.col(f"{into}.{k}"), k, i) for i, k in enumerate(KINDS[:3])))
    return base, F.concat(base, named(F.col(f"{into}.random"), "random", 3))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(spread(docs), train(random_strings(spark).unionByName(identifiers(docs))))
    base, every = spans()
    counts = [F.size(f"secrets.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(listed(base, "start", "rank"), 256).alias("base_sha256"), listed(every, "start", "rank").alias("spans"), counts[3])
