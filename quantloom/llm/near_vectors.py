"""Links between vectors of a cosine or more, by spherical-cap filters.

Filters are directions of structured random codes: the concatenation of one codeword from each block of dimensions, taken
after a random rotation and, for each code, in an order of its own. A vector is in every filter whose direction exceeds a
threshold with it; those are listed block by block, dropping beginnings that can't reach the threshold any more. Threshold
and number of filters follow from the sphere's caps, so that a pair at the least cosine shares as many for any number of
vectors. Vectors are joined on filters, pairs verified in double precision, and a pair is counted only in the first filter
that holds both. Vectors in too few filters, and those of few dimensions, are compared with all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.components import components
from quantloom.llm.shared import small, stash
from quantloom.llm.vectors import keyed, stacked

#: Expected number of filters that a pair at the least cosine shares, and of vectors in a filter.
SHARED, HELD = 20, 64
#: Codes over the rotated dimensions: the more, the less a vector's number of filters varies.
CODES = 32
#: Vectors in fewer filters, or of fewer dimensions, are compared with all others.
SCARCE, FLAT = 10, 16
#: Rows of a task's group; a filter with more is split into blocks of so many, and its pairs of blocks are groups.
GROUP, BLOCK = 40_000, 4096
HEAVY_BROADCAST = 200_000
SEED = 4242


@dataclass(frozen=True)
class Code:
    """CODES codes of words codewords in each of blocks blocks; a filter holds the vectors that exceed threshold with it."""

    dim: int
    blocks: int
    words: int
    threshold: float

    @property
    def each(self) -> int:
        return self.words**self.blocks

    @staticmethod
    @cache
    def fitting(n: int, dim: int, cosine: float) -> Code:
        """For n vectors: the more, the rarer a filter holds one, and the more filters there are."""
        share = min(0.25, HELD / max(1, n))
        at, tail = _caps(dim)
        threshold = float(np.interp(-share, -tail, at))
        filters = SHARED / (share * _kept(threshold, dim, cosine)) / CODES
        blocks = 2 if filters < 1e7 else 3
        return Code(dim, blocks, max(2, math.ceil(filters ** (1 / blocks))), threshold)


@cache
def _caps(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Heights, and the share of the sphere above each."""
    at = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - at * at, 0) ** ((dim - 3) / 2)
    tail = np.concatenate([np.cumsum(((density[1:] + density[:-1]) / 2)[::-1])[::-1], [0]])
    return at, tail / tail[0]


def _kept(threshold: float, dim: int, cosine: float) -> float:
    """Of the vectors in a filter, the share whose partner at this cosine is in it too."""
    if cosine >= 1:
        return 1.0
    u = np.linspace(threshold, 1, 2001)[:-1]
    density = (1 - u * u) ** ((dim - 3) / 2)
    least = (threshold - cosine * u) / np.sqrt((1 - cosine * cosine) * (1 - u * u))
    return float((density * np.interp(least, *_caps(dim - 1))).sum() / density.sum())


@cache
def _words(code: Code) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[np.ndarray, list[np.ndarray]]]]:
    """The rotation, the blocks' edges, and for each code the order of dimensions and the words of each block."""
    dim = code.dim
    edges = [round(i * dim / code.blocks) for i in range(code.blocks + 1)]
    cuts = list(zip(edges, edges[1:], strict=False))
    r = np.random.default_rng([SEED, dim, code.blocks, code.words])
    rotation = np.linalg.qr(r.standard_normal((dim, dim)))[0]
    out = []
    for _ in range(CODES):
        own = []
        for a, b in cuts:
            w = r.standard_normal((code.words, b - a))
            own.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt((b - a) / dim))
        out.append((r.permutation(dim), own))
    return rotation, cuts, out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by a power of two first, which is exact, so that no square is too large or small."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def decode(x: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every filter that holds a row of x, unit vectors; rows ascend."""
    rotation, cuts, codes = _words(code)
    rows, filters = [], []
    for at in range(0, len(x), 1024):
        turned = x[at : at + 1024] @ rotation
        row_of, number_of = [], []
        for k, (order, words) in enumerate(codes):
            part = turned[:, order]
            scores = [part[:, a:b] @ w.T for (a, b), w in zip(cuts, words, strict=True)]
            rest = np.zeros(len(part))
            rests = [rest]
            for s in reversed(scores[1:]):
                rest = rest + s.max(1)
                rests.insert(0, rest)
            row, number, total = np.arange(len(part)), np.full(len(part), k, np.int64), np.zeros(len(part))
            for s, rest in zip(scores, rests, strict=True):
                reach = total[:, None] + s[row] + rest[row][:, None]
                i, w = np.nonzero(reach >= code.threshold)
                total = total[i] + s[row[i], w]
                row, number = row[i], number[i] * code.words + w
            row_of.append(row)
            number_of.append(number)
        row, number = np.concatenate(row_of), np.concatenate(number_of)
        by = np.argsort(row, kind="stable")
        rows.append(row[by] + at)
        filters.append(number[by])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(filters)


MEMBERS = "filter long, class long, n long, vector binary"
#: In place of a filter's number: scarce vectors among themselves, and with the others. Both come before all filters.
AMONG, WITH = -1, -2


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        size = np.diff(batch.column("vector").offsets.to_numpy())
        for dim in np.unique(size):
            part = batch.filter(pa.array(size == dim))
            yield int(dim), part, stacked(part.column("vector"))


def _named(number: np.ndarray, dim: int) -> pa.Array:
    return pa.array(number * 100_003 + dim)


def _packed(x: np.ndarray) -> list[bytes]:
    return [v.tobytes() for v in x.astype(np.float32 if x.dtype == np.float32 else np.float64)]


def _scarce(batches: Iterator[pa.RecordBatch], n: int, least: float, fewest: int) -> Iterator[pa.RecordBatch]:
    """The vectors that are compared with all others, in the filter AMONG."""
    for dim, part, x in _by_dim(batches):
        if dim < FLAT:
            few = np.arange(len(x))
        else:
            code = Code.fitting(n, dim, least)
            held = [np.bincount(decode(unit(x[at : at + 2048]), code)[0], minlength=min(2048, len(x) - at)) for at in range(0, len(x), 2048)]
            few = np.flatnonzero(np.concatenate(held) < fewest)
        own = part.take(pa.array(few))
        yield pa.RecordBatch.from_pydict({"filter": _named(np.full(len(few), AMONG), dim), "class": own.column("class"), "n": own.column("n"), "vector": pa.array(_packed(x[few]), pa.binary())})


def _filters(batches: Iterator[pa.RecordBatch], n: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in _members(batches, n, least, False):
        yield batch.select(["filter"])


def _members(batches: Iterator[pa.RecordBatch], total: int, least: float, vectors: bool = True) -> Iterator[pa.RecordBatch]:
    for dim, part, x in _by_dim(batches):
        code = Code.fitting(total, dim, least)
        classes, n = part.column("class").to_numpy(), part.column("n").to_numpy()
        raw = _packed(x)
        for at in range(0, len(x), 2048):
            row, number = decode(unit(x[at : at + 2048]), code)
            row = row + at
            yield pa.RecordBatch.from_pydict({
                "filter": _named(number, dim), "class": pa.array(classes[row]), "n": pa.array(n[row]), "vector": pa.array([raw[i] for i in row] if vectors else [None] * len(row), pa.binary()),
            })


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector in the filter WITH."""
    for dim, part, x in _by_dim(batches):
        yield pa.RecordBatch.from_pydict({"filter": _named(np.full(len(x), WITH), dim), "class": part.column("class"), "n": part.column("n"), "vector": pa.array(_packed(x), pa.binary())})


class _Union:
    """Disjoint sets of a group's rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


FOUND = "a long, b long, n long"


def _linked(group: pa.Table, least: float, total: int, wide: bool) -> pa.Table:
    """For each class, the rows of other classes linked with it here first; links that span what is linked here."""
    number, classes, n = (group.column(c).to_numpy() for c in ("filter", "class", "n"))
    side = group.column("side").to_numpy()
    raw = group.column("vector").to_pylist()
    a_out, b_out, n_out = [], [], []
    order = np.argsort(number, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
        if len(own) < 2:
            continue
        x = unit(np.frombuffer(b"".join(raw[i] for i in own), np.float64 if wide else np.float32).reshape(len(own), -1))
        here = number[own[0]] // 100_003
        across = side[own].min() != side[own].max()  # a pair of different blocks: only pairs between them
        one, two = (np.flatnonzero(side[own] == 0), np.flatnonzero(side[own] == 1)) if across else (np.arange(len(own)),) * 2
        near = x[one] @ x[two].T >= least
        if not across:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        p, q = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near = near[np.ix_(p, q)]
        one, two = one[p], two[q]
        both = np.union1d(one, two)
        row, filters = decode(x[both], Code.fitting(total, x.shape[1], least)) if here >= 0 else (np.zeros(0, np.int64),) * 2
        early = filters < here
        row, filters = row[early], filters[early]
        names, columns = np.unique(filters, return_inverse=True)
        place = np.zeros(len(own), np.int64)
        place[both] = np.arange(len(both))
        for k in range(0, len(names), 512):  # pairs that an earlier filter holds count there
            if not near.any():
                break
            pick = (columns >= k) & (columns < k + 512)
            held = np.zeros((len(both), 512), np.float32)
            held[row[pick], columns[pick] - k] = 1
            near &= held[place[one]] @ held[place[two]].T == 0
        weight = n[own]
        sums = [(one, near @ weight[two].astype(np.float64))] + ([(two, weight[one].astype(np.float64) @ near)] if across else [])
        for rows, more in sums:
            some = np.flatnonzero(more)
            a_out.append(classes[own[rows[some]]])
            b_out.append(classes[own[rows[some]]])
            n_out.append(more[some].astype(np.int64))
        sets, kept = _Union(len(own)), []
        for i, js in ((i, np.flatnonzero(near[i])) for i in range(len(one)) if near[i].any()):
            kept += [(one[i], two[j]) for j in js if sets.join(int(one[i]), int(two[j]))]
        if kept:
            i, j = np.array(kept).T
            a_out.append(classes[own[i]])
            b_out.append(classes[own[j]])
            n_out.append(np.zeros(len(i), np.int64))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.table({"a": pa.array(join(a_out)), "b": pa.array(join(b_out)), "n": pa.array(join(n_out))})


def _crossed(scarce: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every block of scarce vectors with every block of the other vectors of their length, as groups of two sides."""
    few = scarce.withColumn("filter", F.col("filter") + (WITH - AMONG) * 100_003)
    rest = vectors.mapInArrow(_whole, MEMBERS)
    blocks = lambda rows, name: rows.groupBy("filter").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    counts = small(stash(blocks(few, "few").join(blocks(rest, "rest"), "filter"), "near_crossed"), HEAVY_BROADCAST)
    own = lambda name: F.pmod(F.xxhash64("class", F.lit(SEED)), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    few = few.join(counts, "filter").withColumn("i", own("few")).withColumn("j", each("rest")).withColumn("side", F.lit(0))
    rest = rest.join(counts, "filter").withColumn("j", own("rest")).withColumn("i", each("few")).withColumn("side", F.lit(1))
    return few.unionByName(rest).select("filter", "class", "n", "vector", F.struct(F.col("filter").alias("f"), "i", "j").alias("g"), "side")


def near(rows: DataFrame, id_column: str, vector: str, least: float = 0.95) -> DataFrame:
    """id, n_links, component_id, kept for each row.

    Equal vectors are one class, whose copies aren't expanded into pairs: they link with each other and with all copies of
    linked classes. Vectors that are null, zero, or hold null or non-finite components link with nothing; so do those of
    other lengths. A cosine of just least links, as double precision tells it. Repeated rows count each; an empty table gives
    no rows; other columns are not looked at.
    """
    base = stash(keyed(rows, id_column, vector), "near_vectors")
    classes = stash(base.where(F.col("class").isNotNull()).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.first("vector").alias("vector")), "near_classes")
    total = classes.count()
    wide = "double" in dict(classes.dtypes)["vector"]
    vectors = classes.select("class", "n", "vector")
    fewest = SCARCE
    scarce = stash(vectors.mapInArrow(lambda b: _scarce(b, total, least, fewest), MEMBERS), "near_scarce")
    some = scarce.limit(1).count() > 0
    if some:
        vectors = vectors.join(small(scarce.select("class"), HEAVY_BROADCAST), "class", "left_anti").select("class", "n", "vector")
    members = vectors.mapInArrow(lambda b: _members(b, total, least), MEMBERS).unionByName(scarce)
    named = vectors.mapInArrow(lambda b: _filters(b, total, least), "filter long").unionByName(scarce.select("filter"))
    sizes = stash(named.groupBy("filter").agg(F.count(F.lit(1)).alias("count")), "near_filters")
    heavy = sizes.where(F.col("count") > BLOCK).select("filter", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    heavy = small(heavy, HEAVY_BROADCAST)
    parts = max(1, (sizes.agg(F.sum("count")).first()[0] or 0) // GROUP)
    split = members.join(heavy, "filter", "left")
    block = F.pmod(F.xxhash64("class", F.lit(SEED)), F.col("blocks")).cast("int")
    # a row of a heavy filter goes to each pair of blocks with its own
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = split.withColumn("own", block).withColumn("other", F.explode(others))
    group = F.when(F.col("blocks").isNull(), F.struct(F.lit(-1).cast("long").alias("f"), F.pmod(F.xxhash64("filter"), F.lit(parts)).cast("int").alias("i"), F.lit(-1).alias("j"))).otherwise(
        F.struct(F.col("filter").alias("f"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    placed = placed.select("filter", "class", "n", "vector", group.alias("g"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    if some:
        placed = placed.unionByName(_crossed(scarce, vectors))
    found = stash(placed.groupBy("g").applyInArrow(lambda t: _linked(t, least, total, wide), FOUND), "near_links")
    linked = found.where("a = b").groupBy("a").agg(F.sum("n").alias("more"))
    graph = stash(components(found.where("a <> b")), "near_components")
    known = classes.select("class", "n", "first").join(linked, F.col("class") == F.col("a"), "left").join(graph, F.col("class") == F.col("id"), "left")
    known = known.select("class", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "class").alias("root"), "first")
    known = stash(known, "near_known")
    roots = stash(known.groupBy("root").agg(F.min("first").alias("component_id")), "near_roots")
    known = stash(known.join(roots, "root").select("class", "links", "component_id"), "near_classes_known")
    out = base.select("id", "class").join(known, "class", "left").select(F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_column)))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked by a cosine of 0.95 or more."""
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
