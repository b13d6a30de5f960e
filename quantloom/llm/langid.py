"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased, anything else counts as one gap. A model holds the n-grams of all languages in sorted arrays of
64-bit keys, four 16-bit symbols each, with a column of log-probabilities for each language; contexts' weights for unseen
n-grams are kept likewise. A text gets the language of the lowest cross-entropy per symbol. It is rejected if that exceeds
what labelled texts set aside for calibration reach in that language.
"""

from __future__ import annotations

import sys
import unicodedata  # noqa: F401  isalpha() and lower() use the same tables
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import freed, spread

ORDER = 4
#: Expected number of texts of each language from which n-grams are counted, and of those for calibration.
TRAIN, CALIBRATE = 1500, 400
#: Symbols that are scored at once.
CHUNK = 1 << 17
SEED = 77
#: Rejection: so many times the largest calibrated excess of cross-entropy, of the languages' the median one.
MARGIN = 3.5
#: Languages that are learned at most: the most frequent ones, so that stray values of lang don't make the tables grow.
LANGS = 256


@cache
def _folding() -> np.ndarray:
    """Symbol of each code point: the lower-case letter, 1 for letters beyond 16 bits, 0 for anything else."""
    out = np.zeros(sys.maxunicode + 1, np.uint16)
    for i in range(sys.maxunicode + 1):
        if chr(i).isalpha():
            low = ord(chr(i).lower()[0])
            out[i] = low if 1 < low < 0x10000 else 1
    return out


def symbols(text: str) -> np.ndarray:
    """Symbols of a text, runs of gaps as one, after ORDER - 1 gaps of context."""
    x = _folding()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if len(x):
        keep = x != 0
        keep[1:] |= x[:-1] != 0
        x = x[keep]
        x = x[1:] if len(x) and x[0] == 0 else x
    return np.concatenate([np.zeros(ORDER - 1, np.uint16), x])


def keys(x: np.ndarray) -> np.ndarray:
    """The key of each symbol after the context, with the symbols before it."""
    x = x.astype(np.uint64)
    out = np.zeros(max(0, len(x) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | x[k : k + len(out)]
    return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return at, (table[at] == wanted if len(table) else np.zeros(len(wanted), bool))


def _low(n: int) -> np.uint64:
    return np.uint64((1 << 16 * n) - 1)


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray]  # by order from 1: sorted keys
    logp: list[np.ndarray]  # by order: log-probability for each key and language
    contexts: list[np.ndarray]  # by order: sorted keys of the symbols before
    weight: list[np.ndarray]  # by order: log-weight of the next lower order after each context
    floor: float
    scale: float = 1.0
    usual: np.ndarray | None = None
    excess: np.ndarray | None = None

    def scores(self, wanted: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log-probabilities of keys of n symbols, a column for each language."""
        if n == 0:
            return np.full((len(wanted), len(self.langs)), self.floor, np.float32)
        at, hit = _find(self.grams[n - 1], wanted)
        out = self.logp[n - 1][at]
        if not hit.all():
            miss = wanted[~hit]
            back = self.scores(miss & _low(n - 1), n - 1)
            where, known = _find(self.contexts[n - 1], miss >> np.uint64(16))
            out[~hit] = back + np.where(known[:, None], self.weight[n - 1][where], 0)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of symbols and cross-entropy per symbol in each language for every text."""
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                got = self.scores(np.concatenate([k for _, k in held]))
                at = 0
                for i, k in held:
                    total[i] -= got[at : at + len(k)].sum(0, dtype=np.float64)
                    at += len(k)
                held.clear()

        size = 0
        for i, text in enumerate(texts):
            x = symbols(text)
            count[i] = len(x) - ORDER + 1
            for a in range(0, int(count[i]), CHUNK):
                k = keys(x[a : a + CHUNK + ORDER - 1])
                if size + len(k) > CHUNK:
                    flush()
                    size = 0
                held.append((i, k))
                size += len(k)
        flush()
        return count, total / np.maximum(count, 1)[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text; `und`, 0 and rejected without letters or languages."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        count, h = self.entropies(texts)
        best = h.argmin(1)
        lowest = h[np.arange(len(texts)), best]
        with np.errstate(under="ignore"):
            score = 1 / np.exp(-self.scale * np.sqrt(count)[:, None] * (h - lowest[:, None])).sum(1)
        over = np.zeros(len(texts), bool) if self.usual is None else (lowest - self.usual[best]) * np.sqrt(np.minimum(count, 400)) > MARGIN * self.excess[best]
        none = count == 0
        return [("und" if n else self.langs[b]) for n, b in zip(none, best, strict=True)], np.where(none, 0.0, score), over | none


def fit(langs: list[str], grams: np.ndarray, lang: np.ndarray, counts: np.ndarray) -> Model:
    """A model from the keys of ORDER symbols, their language's index and counts."""
    n_langs = len(langs)
    table = np.unique(grams)
    c = np.zeros((len(table), n_langs))
    np.add.at(c, (np.searchsorted(table, grams), lang), counts)
    tables, sums = [table], [c]
    for n in range(ORDER - 1, 0, -1):  # a lower order counts the different symbols before an n-gram
        low = tables[0] & _low(n)
        table, inverse = np.unique(low, return_inverse=True)
        c = np.zeros((len(table), n_langs))
        np.add.at(c, inverse, sums[0] > 0)
        tables.insert(0, table)
        sums.insert(0, c)
    vocabulary = len(tables[0]) + 1
    p = np.full((1, n_langs), 1 / vocabulary)
    model = Model(langs, tables, [], [], [], float(-np.log(vocabulary)))
    for n in range(1, ORDER + 1):
        table, c = tables[n - 1], sums[n - 1]
        contexts, inverse = np.unique(table >> np.uint64(16), return_inverse=True)
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        d = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
        total, kinds = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs))
        np.add.at(total, inverse, c)
        np.add.at(kinds, inverse, c > 0)
        weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        lower = p[np.searchsorted(tables[n - 2], table & _low(n - 1))] if n > 1 else p
        p = np.maximum(c - d, 0) / np.maximum(total, 1)[inverse] + weight[inverse] * lower
        model.logp.append(np.log(p).astype(np.float32))
        model.contexts.append(contexts)
        model.weight.append(np.log(weight).astype(np.float32))
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(keys(symbols(text)))
        for lang, parts in by.items():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "gram": pa.array(found.view(np.int64)), "n": pa.array(n, pa.int64())})


def train(labelled: DataFrame, train_docs: int = TRAIN, calibrate_docs: int = CALIBRATE) -> Model:
    """A model from doc_id, text, lang; rows of null text or lang are left out.

    n-grams are counted on about train_docs texts of each language, drawn by a hash of doc_id, and calibrated on about
    calibrate_docs others, of those the ones whose language is found again. Those bounds are the parameters; what comes to
    the driver grows with them alone. Rows without a doc_id are drawn all together or not at all.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [], [], [], [], 0.0)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11) / float(1 << 53)).alias("u")
    n = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, float(v))]), F.col("lang"))
    drawn = rows.select("text", "lang", u, n.alias("n")).where(F.col("n").isNotNull())
    edge = F.least(F.col("n") * 0.8, F.lit(float(train_docs))) / F.col("n")
    grams = drawn.where(F.col("u") < edge).select("text", "lang").mapInArrow(freed(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    index = {k: i for i, k in enumerate(langs)}
    model = fit(langs, grams["gram"].to_numpy().view(np.uint64), np.array([index[k] for k in grams["lang"].to_pylist()], np.int64), grams["n"].to_numpy().astype(float))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, h = shared.value.entropies(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "n": pa.array(count), "h": pa.array(h.tolist(), pa.list_(pa.float64()))})

    more = F.least(F.lit(1.0), edge + calibrate_docs / F.col("n"))
    kept = drawn.where((F.col("u") >= edge) & (F.col("u") < more)).select("text", "lang").mapInArrow(freed(measured), "lang string, n long, h array<double>").toPandas()
    kept = kept[kept.n > 0]
    model.usual, model.excess = np.full(len(langs), np.inf), np.full(len(langs), np.inf)
    if len(kept):
        h, own, count = np.stack(kept.h.to_list()), kept.lang.map(index).to_numpy(), kept.n.to_numpy()
        right = h.argmin(1) == own  # a wrong label tells nothing about its language
        for i in range(len(langs)):
            if (at := right & (own == i)).sum() >= 20:
                mine = h[at, i]
                model.usual[i] = np.median(mine)
                model.excess[i] = max(0.5, ((mine - model.usual[i]) * np.sqrt(np.minimum(count[at], 400))).max())
        if np.isfinite(model.excess).any():  # one odd text doesn't set a language's limit
            model.excess[np.isfinite(model.excess)] = np.median(model.excess[np.isfinite(model.excess)])

        def loss(scale: float) -> float:
            x = -scale * np.sqrt(count)[:, None] * h
            x -= x.max(1, keepdims=True)
            return float(-(x[np.arange(len(own)), own] - np.log(np.exp(x).sum(1))).mean())

        model.scale = min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0), key=loss)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs with lang_pred, score and rejected; docs has text. Columns of docs by those three names are
    replaced, others stay.

    A null text, an empty one and one without a letter get `und`, score 0, rejected. A model without languages gives that
    to every text. Very long texts are scored whole; equal scores go to the first language by name; repeated rows come
    repeated; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, score, rejected = shared.value.predict([t or "" for t in part.column("text").to_pylist()])
                columns = [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(freed(run), f"{fields}, lang_pred string, score double, rejected boolean")


def held_out():
    """Whether a row's doc_id falls into the fifth that is never learned from; a null one doesn't."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify(spread(docs.select("doc_id", "text", held_out().alias("held_out"))), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
