"""Nearest neighbours by a hierarchical navigable small-world graph for each shard.

Different vectors are dealt to shards by a hash; equal ones are one node with the smallest ids of its rows. A shard's graph
is built in batches: all of a batch find the nearest of the nodes so far together, then get their links. Vectors, links and levels are
flat arrays, a row of a table for each shard. Queries stream past each shard's graph, which a task loads once; the shards'
results, measured again in double precision on the original vectors, are merged by rank. A graph's vectors are scaled by one
power of two; where magnitudes lie too far apart for squares in single precision, a query is compared with all of the shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import freed, freed_group, small, stash
from quantloom.llm.vectors import keyed, stacked

#: Nodes of a shard, about: a SHARES-th of all, between two bounds. Queries that stream past one copy of a shard's graph.
SHARD, SHARES, LARGEST, QUERIES = 8192, 64, 65_536, 100_000
#: Queries that are searched together, and open nodes of each that a step expands.
TOGETHER, WIDE = 256, 4
#: Links of a node (twice as many on the ground level), candidates when building and when searching.
LINKS, BUILD, SEARCH = 16, 96, 160
BATCH = 512
#: Largest ratio of magnitudes whose squares single precision holds.
RANGE = 1e15
SEED = 99


@dataclass
class Graph:
    """x: vectors; links: one flat neighbour array for each level (-1: none); entry: the start."""

    x: np.ndarray
    links: list[np.ndarray]
    entry: int


def _search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the best found, nearest first, for all queries together; -1 and inf where there are fewer.

    starts: nodes for each query, -1 for none. Each step expands every query's WIDE nearest nodes that aren't expanded yet.
    """
    n_q, beam = len(queries), max(width, starts.shape[1])
    ids, far = np.full((n_q, beam), -1, np.int64), np.full((n_q, beam), np.inf)
    k = starts.shape[1]
    ids[:, :k] = starts
    far[:, :k] = np.where(starts >= 0, ((x[np.maximum(starts, 0)] - queries[:, None]) ** 2).sum(2), np.inf)
    done, seen = ids < 0, np.zeros((n_q, len(x)), bool)
    q, c = np.nonzero(ids >= 0)
    seen[q, ids[q, c]] = True
    active, step = np.arange(n_q), min(WIDE, beam)
    while len(active):
        open_far = np.where(done[active], np.inf, far[active])
        best = np.argpartition(open_far, step - 1, axis=1)[:, :step]
        usable = np.isfinite(np.take_along_axis(open_far, best, 1))
        going = usable.any(1)
        active, best, usable = active[going], best[going], usable[going]
        if not len(active):
            break
        done[active[:, None], best] = True
        new = links[np.where(usable, ids[active[:, None], best], 0)]
        new = np.where(usable[:, :, None], new, -1).reshape(len(active), -1)
        rows, cols = np.nonzero((new >= 0) & ~seen[active[:, None], np.maximum(new, 0)])
        if not len(rows):
            continue
        _, once = np.unique(rows * len(x) + new[rows, cols], return_index=True)
        rows, found = rows[once], new[rows, cols][once]
        seen[active[rows], found] = True
        diff = x[found] - queries[active[rows]]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        more = int(place.max()) + 1
        new_ids, new_far = np.full((len(active), more), -1, np.int64), np.full((len(active), more), np.inf)
        new_ids[rows, place], new_far[rows, place] = found, np.einsum("ij,ij->i", diff, diff)
        all_ids, all_far = np.concatenate([ids[active], new_ids], 1), np.concatenate([far[active], new_far], 1)
        all_done = np.concatenate([done[active], new_ids < 0], 1)
        keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        ids[active], far[active], done[active] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_far, all_done))
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1)[:, :width], np.take_along_axis(far, order, 1)[:, :width]
    return np.where(np.isfinite(far), ids, -1), far


def _diverse(x: np.ndarray, node: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Up to most links for each node from candidates (-1: none): those nearer to it than to a chosen one, nearest first, then
    the nearest others."""
    out = np.full((len(node), most), -1, np.int64)
    for at in range(0, len(node) if ids.shape[1] else 0, 128):
        own, own_ids = node[at : at + 128], np.sort(ids[at : at + 128], axis=1)
        bad = (own_ids < 0) | (own_ids == own[:, None])
        bad[:, 1:] |= own_ids[:, 1:] == own_ids[:, :-1]
        v = x[np.maximum(own_ids, 0)] - x[own][:, None]
        size = np.einsum("ijk,ijk->ij", v, v)
        by = np.argsort(np.where(bad, np.inf, size), axis=1, kind="stable")
        own_ids, size, valid = np.take_along_axis(own_ids, by, 1), np.take_along_axis(size, by, 1), ~np.take_along_axis(bad, by, 1)
        v = np.take_along_axis(v, by[:, :, None], 1)
        gap = size[:, :, None] + size[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        free, chosen, r = valid.copy(), np.zeros_like(valid), np.arange(len(own))
        for _ in range(most):
            i = free.argmax(1)
            has = free[r, i]
            if not has.any():
                break
            chosen[r[has], i[has]] = True
            free &= (gap[r, i] >= size) | ~has[:, None]
            free[r, i] = False
        rank = np.where(chosen, 0, np.where(valid, 1, 2))
        keep = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out[at : at + 128, : keep.shape[1]] = np.where(np.take_along_axis(rank, keep, 1) < 2, np.take_along_axis(own_ids, keep, 1), -1)
    return out


def build(x: np.ndarray, names: np.ndarray) -> Graph:
    """The graph of a shard's vectors; levels are drawn by names, so that it is the same again for the same vectors."""
    n = len(x)
    draw = np.random.default_rng(SEED).random(n) if not n else ((names.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / (1 << 53)
    top = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int), 6)
    order = np.argsort(-top, kind="stable")  # from the top level down, so that every batch finds the levels above complete
    levels = int(top.max(initial=0)) + 1
    links = [np.full((n, LINKS * 2 if lv == 0 else LINKS), -1, np.int64) for lv in range(levels)]
    entry = int(order[0]) if n else -1
    for lv in range(levels - 1, -1, -1):
        own = order[top[order] >= lv]
        at = 0
        while at < len(own):  # the first nodes link with each other directly
            part = own[at : at + min(BATCH, max(64, at))]
            ids, far = _nearest_of(x, part, own[:at], BUILD)
            inner = ((x[part][:, None] - x[part][None]) ** 2).sum(2) if len(part) <= 64 else _squared(x[part])
            np.fill_diagonal(inner, np.inf)
            k = min(BUILD, len(part) - 1)
            near = np.argsort(inner, axis=1, kind="stable")[:, :k]
            ids = np.concatenate([ids, part[near]], 1)
            far = np.concatenate([far, np.take_along_axis(inner, near, 1)], 1)
            by = np.argsort(far, axis=1, kind="stable")[:, :BUILD]
            chosen = _diverse(x, part, np.take_along_axis(ids, by, 1), LINKS)
            links[lv][part, :LINKS] = chosen
            _back(x, links[lv], part, chosen)
            at += len(part)
    return Graph(x, links, entry)


def _squared(v: np.ndarray) -> np.ndarray:
    s = (v * v).sum(1)
    return np.maximum(np.add.outer(s, s) - 2 * v @ v.T, 0)


def _nearest_of(x: np.ndarray, part: np.ndarray, others: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most nearest of others to each node of part, in no order, and squared distances: by matrix products, since a shard is
    small enough for that to cost less than searching its graph."""
    k = min(most, len(others))
    ids, far = np.zeros((len(part), k), np.int64), np.zeros((len(part), k))
    if not k:
        return ids, far
    v, size = x[others], (x[others] ** 2).sum(1)
    for at in range(0, len(part), 128):
        own = x[part[at : at + 128]]
        d = np.maximum((own**2).sum(1)[:, None] + size - 2 * own @ v.T, 0)
        best = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(others) else np.broadcast_to(np.arange(k), d.shape)
        ids[at : at + 128], far[at : at + 128] = others[best], np.take_along_axis(d, best, 1)
    return ids, far


def _back(x: np.ndarray, links: np.ndarray, part: np.ndarray, chosen: np.ndarray) -> None:
    """Link the chosen nodes back, thinning those with too many; a node gets its new links by as many as it may have."""
    source, target = np.repeat(part, chosen.shape[1]), chosen.reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    most = links.shape[1]
    turn = np.arange(len(target)) - np.searchsorted(target, target)
    for first in range(0, int(turn.max(initial=-1)) + 1, most):
        now = (turn >= first) & (turn < first + most)
        node, row = np.unique(target[now], return_inverse=True)
        new = np.full((len(node), most), -1, np.int64)
        new[row, turn[now] - first] = source[now]
        links[node] = _diverse(x, node, np.concatenate([links[node], new], 1), most)


def nearest(graph: Graph, queries: np.ndarray, k: int, width: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of each query's k nearest found."""
    if not len(graph.x):
        return np.full((len(queries), 0), -1, np.int64), np.zeros((len(queries), 0))
    starts = np.full((len(queries), 1), graph.entry, np.int64)
    for level in range(len(graph.links) - 1, 0, -1):
        starts, _ = _search(graph.x, graph.links[level], queries, starts, 8)
    ids, far = _search(graph.x, graph.links[0], queries, starts, max(width, k))
    return ids[:, :k], far[:, :k]


def _exponent(x: np.ndarray) -> int:
    """Of the power of two over the largest magnitude."""
    return int(np.frexp(np.abs(x).max(initial=0))[1])


def _distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each row of x to v, in double precision without overflow or underflow of squares; inf if beyond a double itself."""
    with np.errstate(over="ignore"):
        gap, twice = np.abs(x - v), 1.0
        if not np.isfinite(gap).all():
            gap, twice = np.abs(x / 2 - v / 2), 2.0
        most = gap.max(1, initial=0)
        power = np.where((most > 0) & ((most < 1e-140) | (most > 1e140)), np.frexp(most)[1], 0)
        return np.ldexp(np.sqrt((np.ldexp(gap, -power[:, None]) ** 2).sum(1)), power) * twice


#: A shard's graph. Its nodes' rows are flat too: their number for each node, then their ids and rows.
INDEX = "dim int, shard int, copies binary, ids binary, rows binary, vectors binary, levels int, links binary, entry long"


def _index(group: pa.Table) -> pa.Table:
    group = group.sort_by("class").combine_chunks()
    x = stacked(group.column("vector").combine_chunks())
    g = build(np.ldexp(x, -_exponent(x)).astype(np.float32), group.column("class").to_numpy())
    same = group.column("same").combine_chunks()
    both = same.flatten()
    flat = {
        "copies": np.diff(same.offsets.to_numpy()).astype(np.int32), "ids": both.field("id").to_numpy(), "rows": both.field("row").to_numpy(), "vectors": x.astype(np.float64),
        "links": np.concatenate([lv.astype(np.int32).reshape(-1) for lv in g.links]),
    }
    return pa.table({"dim": group.column("dim")[:1], "shard": group.column("shard")[:1], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in flat.items()}, "levels": pa.array([len(g.links)], pa.int32()), "entry": pa.array([g.entry], pa.int64())}).select([f.split()[0] for f in INDEX.split(", ")])


@dataclass
class Shard:
    """A graph, its vectors as they are, their exponent, and the ids and rows of each node from start on."""

    graph: Graph
    exact: np.ndarray
    scale: int
    start: np.ndarray
    ids: np.ndarray
    rows: np.ndarray

    @staticmethod
    def load(row: dict) -> Shard:
        x = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
        flat, at, links = np.frombuffer(row["links"], np.int32), 0, []
        for lv in range(row["levels"]):
            width = LINKS * 2 if lv == 0 else LINKS
            links.append(flat[at : at + len(x) * width].reshape(len(x), width))
            at += len(x) * width
        scale = -_exponent(x)
        start = np.concatenate([[0], np.cumsum(np.frombuffer(row["copies"], np.int32))])
        return Shard(Graph(np.ldexp(x, scale).astype(np.float32), links, row["entry"]), x, scale, start, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64))

    def found(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[list[tuple[float, int, int]]]:
        """For each query, the row own, distance, id and row of its k nearest others, by distance, then id."""
        apart = np.ldexp(np.abs(self.exact).max(1), self.scale).min() < 1 / RANGE
        with np.errstate(over="ignore"):
            scaled = np.ldexp(queries, self.scale)
        every = apart | (np.abs(scaled).max(1) > RANGE)
        nodes, _ = nearest(self.graph, np.where(every[:, None], 0, scaled).astype(np.float32), k + 1)
        for q, near, v, whole in zip(own.tolist(), nodes, queries, every, strict=True):
            near = np.arange(len(self.exact)) if whole else near[near >= 0]
            d = _distances(self.exact[near], v)
            if whole:
                at = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                near, d = near[at], d[at]
            spans = [(e, range(self.start[i], self.start[i + 1])) for e, i in zip(d.tolist(), near, strict=True)]
            yield sorted((e, int(self.ids[j]), int(self.rows[j])) for e, js in spans for j in js if self.rows[j] != q)[:k]


def _smallest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of each class in a task, the vector and the most smallest ids; so a class held by a third of all rows stays small."""
    held: dict[int, list] = {}
    same = pa.list_(pa.struct([("id", pa.int64()), ("row", pa.int64())]))

    def out() -> pa.RecordBatch:
        names = list(held)
        ids = [[{"id": i, "row": r} for i, r in sorted(held[c][1])[:most]] for c in names]
        batch = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, same), pa.array([held[c][0] for c in names], pa.list_(pa.float64()))], ["class", "same", "vector"])
        held.clear()
        return batch

    for batch in batches:
        for i, r, c, v in zip(*(batch.column(n).to_pylist() for n in ("id", "row", "class")), batch.column("vector"), strict=True):
            if c not in held:
                held[c] = [v.as_py(), [(i, r)]]
            else:
                own = held[c][1]
                own.append((i, r))
                if len(own) > 8 * most:
                    held[c][1] = sorted(own)[:most]
        if len(held) >= 20_000:
            yield out()
    if held:
        yield out()


def index(base: DataFrame, most: int, shard_rows: int | None = None) -> DataFrame:
    """The table of graphs over keyed rows (id, row, class, vector), for results of up to most - 1 rows."""
    rows = base.where(F.col("class").isNotNull() & F.col("id").isNotNull()).select("id", "row", "class", F.col("vector").cast("array<double>").alias("vector"))
    parts = rows.mapInArrow(freed(lambda b: _smallest(b, most)), "class long, same array<struct<id:long,row:long>>, vector array<double>")
    nodes = parts.groupBy("class").agg(F.slice(F.sort_array(F.flatten(F.collect_list("same"))), 1, most).alias("same"), F.first("vector").alias("vector"))
    nodes = stash(nodes, "hnsw_nodes")
    n = nodes.count()
    shards = max(1, -(-n // (shard_rows or min(LARGEST, max(SHARD, n // SHARES)))))
    placed = nodes.select("class", "same", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int").alias("shard"))
    return stash(placed.groupBy("dim", "shard").applyInArrow(freed_group(_index), INDEX), "hnsw_index")


FOUND = "query_row long, query_id long, vec_id long, vec_row long, score double"


def _streamed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Results of queries, each of which follows the graph that it meets; a graph is held until the next one comes."""
    shard: Shard | None = None
    kinds = [pa.int64()] * 4 + [pa.float64()]
    names = [f.split()[0] for f in FOUND.split(", ")]
    for batch in batches:
        graphs = np.flatnonzero(batch.column("kind").to_numpy() == 0)
        edges = sorted({0, *graphs.tolist(), batch.num_rows})
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            if a in graphs:
                shard, part = Shard.load(part.slice(0, 1).to_pylist()[0]), part.slice(1)
            for at in range(0, part.num_rows, TOGETHER):
                own = part.slice(at, TOGETHER)
                rows, ids = own.column("query_row").to_numpy(), own.column("query_id").to_pylist()
                best = list(shard.found(stacked(own.column("vector")), rows, k))
                out = [(int(r), i, v, w, d) for r, i, found in zip(rows, ids, best, strict=True) for d, v, w in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def search(rows: DataFrame, id_column: str, vector: str, every: int = 100, k: int = 10, shard_rows: int | None = None, queries_of: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by every.

    Rows with a null id, and vectors that are null, zero or hold null or non-finite components, take no part; vectors meet
    those of their length only. Equal distances rank by id. Of repeated ids each row is a query and a candidate of the
    others. An empty table, or one without a query, gives no rows; other columns are not looked at.
    """
    base = stash(keyed(rows, id_column, vector).withColumn("row", F.monotonically_increasing_id()), "hnsw_rows")
    graphs = index(base, k + 1, shard_rows)
    queries = base.where(F.col("class").isNotNull() & (F.col("id") % every == 0)).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))
    queries = stash(queries, "hnsw_queries")
    # every query meets every shard of its length; a graph comes once for so many queries, before them
    n_blocks = max(1, -(-queries.count() // queries_of))
    shards = small(graphs.groupBy("dim").agg(F.max("shard").alias("last")), 1000)
    asked = queries.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(n_blocks)).cast("int")).drop("last").withColumn("kind", F.lit(1))
    sent = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("kind", F.lit(0))
    by = ("dim", "shard", "block")
    met = sent.unionByName(asked, allowMissingColumns=True).repartition(*by).sortWithinPartitions(*by, "kind").mapInArrow(freed(lambda b: _streamed(b, k)), FOUND)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "vec_row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings of those whose vec_id is divisible by 100."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
