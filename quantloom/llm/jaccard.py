"""Links between texts whose sets of word n-grams have a Jaccard similarity of 0.75 or more, by signature trees.

A set is its shingles' 64-bit hashes; texts with equal sets are one class and are compared once. Sets that may be linked
meet in buckets. In each, a signature tree is built: a node holds its sets' token bitmaps combined by OR, the range of
their sizes and their components. Two nodes are traversed together only while the largest possible overlap of their sets
reaches what their sizes need, and they aren't all of one component already.

Buckets come twice. First the sets' two smallest hashes: large buckets are split into blocks, whose components meet again by
one set each, so a group of near copies becomes one component in linear time. Then, for completeness, every hash of a
set's prefix, the part that two linked sets can't both have without a common hash; of those only the buckets that still
hold several components are traversed. Which sets come first there is the hashes' order, frequent ones last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.components import components
from quantloom.llm.shared import freed, freed_group, parts_for, spread, stash, tidy

WORDS, LEAST = 5, 75
#: Bytes of a stored hash; sizes are counted on all eight.
TOKEN = 6
KEYS = 2
#: Classes that a task remembers, so as to send their sets once; beyond it a set may be sent again.
SEEN = 200_000
#: Sets in a leaf of a tree, children of a node; sets in a block of a bucket; rows of a task's group.
LEAF, FAN, BLOCK, GROUP = 16, 8, 1024, 2000
#: A Bloom filter over hashes or classes that take part: bits for each, and at most so many, which only saves shuffling.
BLOOM, BLOOM_MOST = 16, 1 << 27
#: Frequent hashes, taken from about so many sets: those in so many of them or more, the most frequent first.
SAMPLE, FREQUENT, FREQUENT_MOST = 10_000, 8, 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64; those that most texts need are kept."""

    KEPT = 1 << 16
    up = down = np.ones(1, np.uint64)

    @staticmethod
    def of(base: np.uint64, n: int) -> np.ndarray:
        ones = np.full(n, base, np.uint64)
        ones[:1] = 1
        return np.cumprod(ones, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.KEPT:
            return cls.of(_BASE, n), cls.of(_UNBASE, n)
        if len(cls.up) < cls.KEPT:
            cls.up, cls.down = cls.of(_BASE, cls.KEPT), cls.of(_UNBASE, cls.KEPT)
        return cls.up[:n], cls.down[:n]


def word_hashes(text: bytes) -> np.ndarray:
    x = _LOWER[np.frombuffer(text, np.uint8)]
    word = ~_SPACE[x]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    starts, ends = edge[::2], edge[1::2]
    up, down = _Powers.to(len(x) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEPS[0])


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; of all words as one if there are fewer than that."""
    w = word_hashes((text or "").encode("utf-8", "replace"))
    if not len(w):
        return w
    k = min(words, len(w))
    steps = np.resize(_STEPS, k) + np.arange(k, dtype=np.uint64) * np.uint64(2)
    h = np.full(len(w) - k + 1, k, np.uint64) * _BASE
    for i in range(k):
        h = h + w[i : i + len(h)] * steps[i]
    return np.unique(_mix(h))


def pack(tokens: np.ndarray) -> bytes:
    """The upper TOKEN bytes of each sorted hash."""
    return (tokens >> np.uint64(64 - 8 * TOKEN)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // TOKEN, 8), np.uint8)
    out[:, :TOKEN] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN)
    return out.reshape(-1).view("<u8")


def need(n: np.ndarray | int, least: int = LEAST):
    """Common tokens that a set of n needs with any linked one."""
    return -(-n * least // 100)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bits of a set's tokens, twice to four times as many; powers of 2, so that narrower bitmaps are foldings of wider ones."""
    width = max(64, 1 << int(2 * max(1, len(tokens)) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class Node:
    """Sets of a part of a tree: combined bitmap, sizes' range, most tokens that share a bit with others of their set."""

    __slots__ = ("bits", "children", "excess", "high", "low", "n", "rows", "sets")

    def __init__(self, rows=None, sets=None, n=None, children=()):
        self.rows, self.sets, self.n, self.children = rows, sets, n, children

    @staticmethod
    def leaf(rows: np.ndarray, sizes: np.ndarray, bitmaps: list[np.ndarray]) -> Node:
        words = min(len(bitmaps[i]) for i in rows)
        node = Node(rows, np.stack([folded(bitmaps[i], words) for i in rows]), sizes[rows])
        node.bits = np.bitwise_or.reduce(node.sets, axis=0)
        node.low, node.high = int(node.n.min()), int(node.n.max())
        node.excess = {words: int((node.n - np.bitwise_count(node.sets).sum(1)).max())}
        return node

    @staticmethod
    def over(children: list[Node]) -> Node:
        node = Node(children=children)
        words = min(len(c.bits) for c in children)
        node.bits = reduce(np.bitwise_or, (folded(c.bits, words) for c in children))
        node.low, node.high = min(c.low for c in children), max(c.high for c in children)
        node.excess = {}
        node.excess_at(words)
        return node

    def excess_at(self, words: int) -> int:
        """The most tokens of a set here that share a bit with others of it, in bitmaps folded to so many words."""
        if words not in self.excess:
            if self.rows is None:
                self.excess[words] = max(c.excess_at(words) for c in self.children)
            else:
                self.excess[words] = int((self.n - np.bitwise_count(folded(self.sets, words)).sum(1)).max())
        return self.excess[words]

    def most(self, other: Node) -> int:
        """The largest overlap that a set here and one there can have: common bits, and tokens that share one."""
        words = min(len(self.bits), len(other.bits))
        common = int(np.bitwise_count(folded(self.bits, words) & folded(other.bits, words)).sum())
        return common + min(self.excess_at(words), other.excess_at(words))


def tree(sizes: np.ndarray, bitmaps: list[np.ndarray], order: np.ndarray) -> Node | None:
    nodes = [Node.leaf(order[i : i + LEAF], sizes, bitmaps) for i in range(0, len(order), LEAF)]
    while len(nodes) > 1:
        nodes = [Node.over(nodes[i : i + FAN]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), FAN)]
    return nodes[0] if nodes else None


class Sets:
    """Disjoint sets of rows, some joined from the start by equal components."""

    def __init__(self, component: np.ndarray):
        _, first, inverse = np.unique(component, return_index=True, return_inverse=True)
        self.up = first[inverse].tolist()

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def traverse(one: Node, two: Node, sizes: np.ndarray, sets: Sets, least: int, viable=None) -> Iterator[tuple[int, int]]:
    """Pairs of rows of different components that the bitmaps allow to be linked; a join of sets takes effect at once.

    viable: of two arrays of rows, which pairs may be linked for other reasons.
    """

    def components_of(node: Node) -> set[int]:
        if node.rows is not None:
            return {sets.root(int(i)) for i in node.rows}
        out: set[int] = set()
        for c in node.children:
            out |= components_of(c)
            if len(out) > 1:
                break
        return out

    def apart(a: Node, b: Node) -> bool:
        if a.high * 100 < b.low * least or b.high * 100 < a.low * least:
            return True
        if a.most(b) * (100 + least) < least * (a.low + b.low):
            return True
        both = components_of(a)
        return len(both) == 1 and both == components_of(b)

    stack = [(one, two)]
    while stack:
        a, b = stack.pop()
        if apart(a, b):
            continue
        if a.rows is None or b.rows is None:
            if a is b:
                stack += [(c, d) for i, c in enumerate(a.children) for d in a.children[i:]]
            elif b.rows is not None or a.rows is None and len(a.bits) >= len(b.bits):
                stack += [(c, b) for c in a.children]
            else:
                stack += [(a, c) for c in b.children]
            continue
        words = min(a.sets.shape[1], b.sets.shape[1])
        x, y = folded(a.sets, words), folded(b.sets, words)
        n, m = sizes[a.rows], sizes[b.rows]
        common = np.bitwise_count(x[:, None] & y[None]).sum(2)
        excess = np.minimum((n - np.bitwise_count(x).sum(1))[:, None], (m - np.bitwise_count(y).sum(1))[None])
        most = np.minimum(common + excess, np.minimum(n[:, None], m[None]))
        may = most * (100 + least) >= least * (n[:, None] + m[None])
        if viable is not None and may.any():
            may &= viable(a.rows[:, None], b.rows[None])
        for i, j in zip(*np.nonzero(may), strict=True):
            i, j = int(a.rows[i]), int(b.rows[j])
            if (a is not b or i < j) and sets.root(i) != sets.root(j):
                yield i, j


def _linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= least * (len(a) + len(b) - common)


SETS = "n long, class long, tokens binary, keys array<long>"


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row a text; the first of each class in a task has its tokens."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            out: list[tuple] = []
            for text in part.column("text"):
                t = shingles(text.as_py(), words)
                if not len(t):
                    out.append((0, None, None, None))
                    continue
                h = _mix(t + _STEPS[3])
                both = np.array([h.sum(dtype=np.uint64)]) + np.bitwise_xor.reduce(h * _STEPS[4])
                name = int(_mix(both)[0].view(np.int64))
                if name in seen:
                    out.append((len(t), name, None, None))
                else:
                    if len(seen) < SEEN:
                        seen.add(name)
                    out.append((len(t), name, pack(t), (t[:KEYS] >> np.uint64(64 - 8 * TOKEN)).astype(np.int64).tolist()))
            n, name, tokens, keys = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(tokens, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "class", "tokens", "keys"]
            )


def _places(x: np.ndarray, bits: int) -> list[np.ndarray]:
    return [_mix(x.astype(np.int64).view(np.uint64) + s) & np.uint64(bits - 1) for s in _STEPS[:2]]


class Bloom:
    """A Bloom filter of bounded size over a column of longs, filled by Spark in parts."""

    def __init__(self, values: DataFrame, n: int):
        self.bits = bits = min(BLOOM_MOST, max(1 << 16, 1 << (BLOOM * max(1, n) - 1).bit_length()))

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = np.concatenate(_places(batch.column(0).to_numpy(), bits)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"word": pa.array(p >> 6), "bit": pa.array(np.left_shift(np.int64(1), p & 63))})

        with tidy(values.sparkSession):
            got = values.mapInArrow(freed(words), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        table = np.zeros(bits >> 6, np.int64)
        table[got["word"].to_numpy()] = got["bit"].to_numpy()
        self.shared = values.sparkSession.sparkContext.broadcast(table)

    def may(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for p in _places(x, self.bits):
            p = p.astype(np.int64)
            out &= (self.shared.value[p >> 6] >> (p & 63)) & 1 == 1
        return out

    def __getstate__(self):
        return {"bits": self.bits, "shared": self.shared}


def _only(batches: Iterator[pa.RecordBatch], bloom: Bloom, column: str, as_bitmap: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.filter(pa.array(bloom.may(batch.column(column).to_numpy()))) if batch.num_rows else batch
        if as_bitmap:
            maps = [bitmap(unpack(t.as_py())).tobytes() for t in kept.column("tokens")]
            kept = kept.set_column(kept.schema.get_field_index("tokens"), "tokens", pa.array(maps, pa.binary()))
        yield kept


def with_sets(rows: DataFrame, sets: DataFrame, as_bitmap: bool = False) -> DataFrame:
    """rows, which have a column class, with the class's tokens (or their bitmap) and size n; some rows may come twice."""
    wanted = rows.select("class").distinct()
    bloom = Bloom(wanted, rows.count())
    found = sets.where(F.col("tokens").isNotNull()).select("class", "n", "tokens").mapInArrow(freed(lambda b: _only(b, bloom, "class", as_bitmap)), "class long, n long, tokens binary")
    return rows.join(found, "class")


def _bucket_links(group: pa.Table, least: int) -> pa.Table:
    """Verified links that span each bucket's components."""
    group = group.sort_by([("key", "ascending"), ("block", "ascending"), ("class", "ascending")])
    key, block, classes = (group.column(c).to_numpy() for c in ("key", "block", "class"))
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (classes[1:] != classes[:-1])
    rows = np.flatnonzero(first)
    cuts = np.flatnonzero((key[rows][1:] != key[rows][:-1]) | (block[rows][1:] != block[rows][:-1])) + 1
    tokens = group.column("tokens")
    component = group.column("component").to_numpy()
    out: list[tuple[int, int]] = []
    for own in np.split(rows, cuts):
        if len(own) < 2:
            continue
        held = [unpack(tokens[int(i)].as_py()) for i in own]
        sizes = np.array([len(t) for t in held])
        joined = Sets(component[own])
        root = tree(sizes, [bitmap(t) for t in held], np.argsort(sizes, kind="stable"))
        for i, j in traverse(root, root, sizes, joined, least):
            if _linked(held[i], held[j], least):
                joined.join(i, j)
                out.append((int(classes[own[i]]), int(classes[own[j]])))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _bucket_pairs(group: pa.Table, sets: pa.Table, least: int) -> pa.Table:
    """Pairs of classes of different components that the signature trees of a bucket's blocks allow.

    A bucket's hash has a place in each set's order (pos). If it is the first that a pair has in common, no more than what
    follows it can be common. And beyond the prefix that ends first in the order (last), no more than the rest of that set
    can be, besides hashes of both prefixes, of which a set has shared ones at most. A bucket of a leaf's size is a tree of one
    leaf; the pairs of all such leaves are compared together.
    """
    group = group.sort_by([("token", "ascending"), ("i", "ascending"), ("j", "ascending"), ("side", "ascending"), ("class", "ascending")])
    columns = [group.column(c).to_numpy() for c in ("token", "i", "j", "side", "class")]
    changed = lambda cs: reduce(np.logical_or, (c[1:] != c[:-1] for c in cs))
    first = np.ones(group.num_rows, bool)
    first[1:] = changed(columns)
    rows = np.flatnonzero(first)
    i_block, j_block, side, classes = (c[rows] for c in columns[1:])
    component, n, pos, last, shared = (group.column(c).to_numpy()[rows] for c in ("component", "size", "pos", "last", "shared"))
    start = np.ones(len(rows), bool)
    start[1:] = changed([c[rows] for c in columns[:3]])
    bucket = np.cumsum(start) - 1
    size = np.bincount(bucket)
    maps = {c: np.frombuffer(m, np.uint64) for c, m in zip(sets.column("class").to_pylist(), sets.column("tokens").to_pylist(), strict=True)}
    bits = lambda r: maps[int(classes[r])]

    def viable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = n[a], n[b]
        needed = -(-least * (x + y) // (100 + least))
        after = np.minimum(x - pos[a], y - pos[b])
        rest = np.where(last[a] < last[b], need(x, least), np.where(last[b] < last[a], need(y, least), np.minimum(need(x, least), need(y, least)))) - 1
        apart = (component[a] != component[b]) & ((side[a] != side[b]) | (i_block[a] == j_block[a]))
        return apart & (np.minimum(x, y) * 100 >= least * np.maximum(x, y)) & (after >= needed) & (np.minimum(shared[a], shared[b]) + rest >= needed)

    out: set[tuple[int, int]] = set()
    keep = lambda a, b: out.add((int(min(classes[a], classes[b])), int(max(classes[a], classes[b]))))
    in_small = np.flatnonzero(size[bucket] <= LEAF)
    for step in range(1, LEAF):
        a = in_small[in_small + step < len(rows)]
        a = a[bucket[a] == bucket[a + step]]
        for x in a[viable(a, a + step)] if len(a) else ():
            one, two = bits(x), bits(x + step)
            words = min(len(one), len(two))
            one, two = folded(one, words), folded(two, words)
            excess = min(n[x] - np.bitwise_count(one).sum(), n[x + step] - np.bitwise_count(two).sum())
            if (np.bitwise_count(one & two).sum() + excess) * (100 + least) >= least * (n[x] + n[x + step]):
                keep(x, x + step)
    large = np.flatnonzero(size[bucket] > LEAF)
    for own in np.split(large, np.flatnonzero(np.diff(bucket[large])) + 1) if len(large) else ():
        order = np.lexsort((component[own], n[own]))
        held = [bits(r) for r in own]
        joined = Sets(component[own])
        left = tree(n[own], held, order[side[own][order] == 0])
        right = tree(n[own], held, order[side[own][order] == 1]) if i_block[own[0]] != j_block[own[0]] else left
        for i, j in traverse(left, right, n[own], joined, least, lambda a, b, own=own: viable(own[a], own[b])) if left and right else ():
            keep(own[i], own[j])
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _copied_links(sets: DataFrame, least: int, few: int) -> DataFrame:
    """Links within the buckets of the sets' smallest hashes: large ones by blocks, then by a set of each component."""
    rows = sets.where(F.col("tokens").isNotNull()).select(F.explode("keys").alias("key"), "class")
    rows = stash(rows, "jaccard_keys", few)
    shared = rows.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    rows = stash(rows.join(shared, "key").distinct().withColumn("component", F.col("class")), "jaccard_shared", few)
    links: list[DataFrame] = []
    while True:
        sizes = stash(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (BLOCK // 2)).cast("int").alias("blocks")), "jaccard_sizes", few)
        placed = stash(rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).drop("blocks"), "jaccard_placed", few)
        parts = max(1, placed.count() // GROUP)
        group = F.pmod(F.xxhash64("key", "block"), F.lit(parts))
        met = with_sets(placed, sets).withColumn("g", group).groupBy("g").applyInArrow(freed_group(lambda t: _bucket_links(t, least)), "a long, b long")
        links.append(stash(met, "jaccard_links"))
        large = sizes.where("blocks > 1").select("key")
        if not large.limit(1).count():
            return reduce(DataFrame.unionByName, links)
        graph = components(reduce(DataFrame.unionByName, links))
        named = rows.drop("component").join(large, "key").join(graph, F.col("class") == F.col("id"), "left").select("key", "class", F.coalesce("component", "class").alias("component"))
        fewer = stash(named.groupBy("key", "component").agg(F.min("class").alias("class")), "jaccard_fewer", few)
        if fewer.count() >= rows.join(large, "key").count():  # blocks that link nothing: the prefix's buckets see to them
            return reduce(DataFrame.unionByName, links)
        rows = fewer


def _frequent(sets: DataFrame) -> np.ndarray:
    """Sorted frequent tokens. They decide the order of tokens alone; the result is the same with any."""
    whole = sets.where(F.col("tokens").isNotNull())
    every = max(1, whole.count() // SAMPLE)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [unpack(t.as_py()) for t in batch.column("tokens")]
            token, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_pydict({"token": pa.array(token.astype(np.int64)), "n": pa.array(n)})

    drawn = whole.where(F.pmod("class", F.lit(every)) == 0).select("tokens").mapInArrow(freed(counted), "token long, n long")
    most = drawn.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST)
    return np.sort(most.toArrow()["token"].to_numpy().astype(np.uint64))


def _prefixes(batches: Iterator[pa.RecordBatch], frequent, least: int) -> Iterator[pa.RecordBatch]:
    """class, size, prefix: as many tokens, frequent ones last, as a linked set can't lack altogether; last: its last one's place in the order."""
    late = frequent.value
    for batch in batches:
        size, prefix, last = [], [], []
        for raw in batch.column("tokens"):
            t = unpack(raw.as_py())
            flag = np.zeros(len(t), bool)
            if len(late):
                flag = late[np.minimum(np.searchsorted(late, t), len(late) - 1)] == t
                order = np.argsort(flag, kind="stable")
                t, flag = t[order], flag[order]
            k = len(t) - need(len(t), least) + 1
            size.append(len(t))
            prefix.append(t[:k].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes())
            last.append((int(flag[k - 1]) << 48) | int(t[k - 1]))
        yield pa.RecordBatch.from_pydict({"class": batch.column("class"), "size": pa.array(size, pa.int64()), "last": pa.array(last, pa.int64()), "prefix": pa.array(prefix, pa.binary())})


def _exploded(batches: Iterator[pa.RecordBatch], bloom: Bloom | None) -> Iterator[pa.RecordBatch]:
    names = ["component"] if bloom is None else ["class", "component", "size", "last"]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            held = [unpack(p.as_py()) for p in part.column("prefix")]
            lengths = np.array([len(h) for h in held])
            token, row = np.concatenate(held).astype(np.int64), np.repeat(np.arange(len(held)), lengths)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            if bloom is not None:
                may = bloom.may(token)
                token, row, pos = token[may], row[may], pos[may]
            columns = {"token": token, **({"pos": pos} if bloom else {}), **{c: part.column(c).to_numpy()[row] for c in names}}
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})


def _remaining_links(sets: DataFrame, graph: DataFrame, least: int, few: int) -> DataFrame:
    """Links between components, from the buckets of all prefix tokens that hold several of them."""
    frequent = sets.sparkSession.sparkContext.broadcast(_frequent(sets))
    prefixes = sets.where(F.col("tokens").isNotNull()).select("class", "tokens").mapInArrow(freed(lambda b: _prefixes(b, frequent, least)), "class long, size long, last long, prefix binary")
    prefixes = prefixes.join(graph, F.col("class") == F.col("id"), "left").select("class", F.coalesce("component", "class").alias("component"), "size", "last", "prefix")
    prefixes = stash(prefixes, "jaccard_prefixes")
    tokens = prefixes.mapInArrow(freed(lambda b: _exploded(b, None)), "token long, component long")
    mixed = tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token", "low")
    mixed = stash(mixed, "jaccard_mixed")
    bloom = Bloom(mixed.select("token"), mixed.count())
    members = prefixes.mapInArrow(freed(lambda b: _exploded(b, bloom)), "token long, pos long, class long, component long, size long, last long")
    members = stash(members.join(mixed, "token").distinct(), "jaccard_members")
    sizes = stash(members.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "jaccard_member_sizes", few)
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    members = members.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("class")))
    met = members.join(sizes, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("token", "pos", "class", "component", "size", "last", "shared", "low", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    # buckets that begin with the same component mostly hold the same classes: they share a group, so a class's bitmap is sent there once
    parts = max(1, members.count() // (5 * GROUP))
    met = stash(met.withColumn("g", F.pmod(F.xxhash64("low", "i", "j"), F.lit(parts))).drop("low"), "jaccard_met")
    maps = with_sets(stash(met.select("g", "class").distinct(), "jaccard_maps"), sets, as_bitmap=True)
    pairs = met.groupBy("g").cogroup(maps.groupBy("g")).applyInArrow(freed_group(lambda m, t: _bucket_pairs(m, t, least)), "a long, b long")
    pairs = stash(pairs.distinct(), "jaccard_pairs", few)
    return _verified(pairs, sets, least, few)


def _verified(pairs: DataFrame, sets: DataFrame, least: int, few: int) -> DataFrame:
    """The pairs that are linked. Pairs that hang together are verified in one place, to which each set is sent once; a large
    family of them is split into pairs of blocks."""
    families = components(pairs)
    sizes = families.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    at = families.join(sizes, "component").select(F.col("id").alias("class"), "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))
    at = stash(at, "jaccard_families", few)
    parts = max(1, at.count() // GROUP)
    place = lambda x, y: F.pmod(F.xxhash64("component", F.least(x, y), F.greatest(x, y)), F.lit(parts))
    sent = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("class", place("own", "other").alias("g")).distinct()
    sent = with_sets(stash(sent, "jaccard_sent", few), sets).select("g", "class", "tokens")
    one, two = at.select(F.col("class").alias("a"), "component", F.col("own").alias("own_a")), at.select(F.col("class").alias("b"), F.col("own").alias("own_b"))
    asked = pairs.join(one, "a").join(two, "b").select("a", "b", place("own_a", "own_b").alias("g"))

    def judged(asked: pa.Table, sets: pa.Table) -> pa.Table:
        raw, held = dict(zip(sets.column("class").to_pylist(), sets.column("tokens"), strict=True)), {}

        def tokens(c: int) -> np.ndarray:
            if c not in held:
                held[c] = unpack(raw[c].as_py())
            return held[c]

        asked = asked.sort_by("a")
        right = [_linked(tokens(a), tokens(b), least) for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True)]
        return asked.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    return stash(asked.groupBy("g").cogroup(sent.groupBy("g")).applyInArrow(freed_group(judged), "a long, b long"), "jaccard_more_links", few)


def join(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of doc_id, text. doc_id may be of any type that has an order.

    Texts that are null, empty or without words have no shingles and are their own component. Texts with equal sets are in
    one component; repeated rows give repeated rows; an empty table gives none; other columns are not looked at. Sizes count
    64-bit hashes, classes are named by one and sets are compared on 48 bits of each, so two different shingles
    of a pair of sets of 20,000 are taken for one in about one of a million pairs.
    """
    rows = docs.select("doc_id", "text")
    sets = stash(rows.mapInArrow(freed(lambda b: _sets(b, words)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SETS}"), "jaccard_sets")
    few = parts_for(sets.count())
    graph = stash(components(_copied_links(sets, least, few)), "jaccard_graph", few)
    more = _remaining_links(sets, graph, least, few)
    if more.limit(1).count():  # what is known already is stars by now
        graph = stash(components(graph.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "jaccard_graph", few)
    classes = sets.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first"))
    known = stash(classes.join(graph, F.col("class") == F.col("id"), "left").select("class", "first", F.coalesce("component", "class").alias("root")), "jaccard_classes", few)
    roots = stash(known.groupBy("root").agg(F.min("first").alias("component_id")), "jaccard_roots", few)
    known = stash(known.join(roots, "root").select("class", "component_id"), "jaccard_known", few)
    return sets.select("doc_id", F.col("n").alias("n_shingles"), "class").join(known, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked by 0.75 or more of their 5-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return join(spread(docs))
