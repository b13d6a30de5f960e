"""BPE encoding and decoding of whole texts, equal to the tokenizers library's.

A chunk between white space is encoded once and kept in a bounded cache, since no token reaches over white space. Long
texts are cut into halves of halves, which are encoded in parallel, and concatenated as a tree: a window around each join
is encoded again and grows until it agrees with both sides, so that the result is that of the unsplit text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import freed, freed_group, spread, stash

#: Characters beyond which a text is cut in halves.
LEAF = 1 << 15
#: Entries of each of a cache's two generations, and the longest text in it.
CACHE, CACHED_CHARS = 100_000, 40
#: Characters on each side of a join that are encoded again at first.
WINDOW = 64

# For these characters and without "<|", which may begin a special token: lower-casing keeps lengths, NFC changes nothing,
# str.split() splits at the tokenizer's white space, and the pattern finds its pre-tokens. Other texts go to the library.
_ODD = re.compile("[^\x00-\x1b\x20-įı-ſ‐-‧‰-⁞€]|<\\|")
_LETTER, _NUMBER, _SPACE = "a-zA-Zªµºß-öø-ſÀ-ÖØ-Þ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")

Word = tuple[int, int, tuple[int, ...]]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Encoder:
    """Encodes and decodes with one tokenizer file; keeps what it has encoded."""

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.letters = _byte_letters()
        self.known: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        #: Each id as text, and decoded.
        self.told = [(str(i), self.library.decode([i], skip_special_tokens=False)) for i in range(max(self.library.get_vocab().values(), default=-1) + 1)]

    def word_ids(self, word: str) -> list[int]:
        # printable ASCII characters stand for themselves
        letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        return [t.id for t in self.library.model.tokenize(letters)]

    def _word(self, word: str) -> tuple[int, str, str]:
        return self.known.get(word) or self._kept(word, self.old.get(word) or self._of_word(word))

    def _of_word(self, word: str) -> tuple[int, str, str]:
        told = [self.told[i] for i in self.word_ids(word)]
        return len(told), " ".join([t[0] for t in told]), " ".join([t[1] for t in told])

    def _kept(self, text: str, found: tuple[int, str, str]) -> tuple[int, str, str]:
        """found, remembered; when a generation is full it becomes the old one, from which what is met again comes back."""
        if len(text) <= CACHED_CHARS:
            if len(self.known) >= CACHE:
                self.old, self.known = self.known, {}
            self.known[text] = found
        return found

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        if found := self.known.get(chunk):
            return found
        if found := self.old.get(chunk):
            return self._kept(chunk, found)
        words = _PRE.findall(chunk)
        if len(words) == 1:
            return self._kept(chunk, self._of_word(words[0]))
        parts = [self._word(w) for w in words]
        return self._kept(chunk, (sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])))

    def encoded(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids joined by a space, decoded text."""
        if _ODD.search(text):
            e = self.library.encode(text, add_special_tokens=False)
            return len(e.ids), " ".join(map(str, e.ids)), self.library.decode(e.ids, skip_special_tokens=False)
        get, chunk = self.known.get, self._chunk
        parts = [get(c) or chunk(c) for c in text.lower().split()]
        n, ids, decoded = zip(*parts, strict=True) if parts else ((), (), ())
        return sum(n), " ".join(ids), " ".join(decoded)

    def spans(self, text: str, at: int = 0) -> list[Word]:
        """Pre-tokens with their places, from at on, and ids."""
        if not _ODD.search(text):
            own: dict[str, tuple[int, ...]] = {}
            out: list[Word] = []
            for m in _PRE.finditer(text.lower()):
                if (ids := own.get(m[0])) is None:
                    ids = own[m[0]] = tuple(map(int, self._word(m[0])[1].split()))
                out.append((at + m.start(), at + m.end(), ids))
            return out
        e = self.library.encode(text, add_special_tokens=False)
        found: list[list] = []
        last: object = None
        for i, (a, b), w in zip(e.ids, e.offsets, e.word_ids, strict=True):
            if w is not None and w == last and found and a <= found[-1][1]:
                found[-1][1] = max(found[-1][1], at + b)
                found[-1][2].append(i)
            else:
                found.append([at + a, at + b, [i]])
            last = w
        return [(a, b, tuple(ids)) for a, b, ids in found]

    def joined(self, text: str, left: list[Word], right: list[Word], cut: int, start: int = 0, end: int | None = None) -> list[Word]:
        """Pre-tokens of text[start:end] from those of its parts before and after cut."""
        end, reach = len(text) if end is None else end, WINDOW
        lefts, rights = [w[0] for w in left], [w[1] for w in right]
        while True:
            i = bisect_right(lefts, cut - reach) - 1
            j = bisect_left(rights, cut + reach)
            a, b = (left[i][0] if i >= 0 else start), (right[j][1] if j < len(right) else end)
            window = self.spans(text[a:b], a)
            if (i < 0 or window[:1] == left[i : i + 1]) and (j >= len(right) or window[-1:] == right[j : j + 1]) and (len(window) > 2 or i < 0 and j >= len(right)):
                return [*left[: max(i, 0)], *window, *right[j + 1 :]]
            reach *= 2

    def tree(self, text: str, leaf: int = LEAF, leaves: list[list[Word]] | None = None) -> list[Word]:
        """Pre-tokens of the text by tree concatenation; leaves: those of text[i * leaf : (i + 1) * leaf], if known."""
        n = max(1, -(-len(text) // leaf))

        def over(i: int, j: int) -> list[Word]:
            if j - i == 1:
                return leaves[i] if leaves else self.spans(text[i * leaf : j * leaf], i * leaf)
            m = (i + j) // 2
            return self.joined(text, over(i, m), over(m, j), m * leaf, i * leaf, min(j * leaf, len(text)))

        return over(0, n)

    def flat(self, words: list[Word]) -> tuple[int, str, str]:
        ids = [i for w in words for i in w[2]]
        return len(ids), " ".join(map(str, ids)), self.library.decode(ids, skip_special_tokens=False)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file that every node has."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(found: tuple[int, str, str]) -> tuple[int, str, str]:
    return found[0], _sha(found[1]), _sha(found[2])


def _digests(found: list[tuple[int, str, str]]) -> dict[str, pa.Array]:
    return {"n_tokens": pa.array([f[0] for f in found], pa.int64()), "ids_sha256": pa.array([f[1] for f in found], pa.string()), "decoded_sha256": pa.array([f[2] for f in found], pa.string())}


def _short(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for batch in batches:  # one text at a time is held as Python objects
        out = _digests([_digest(e.encoded(t.as_py() or "")) for t in batch.column("text")])
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out})


def _pieces(path: str, leaf: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens of each piece as three flat lists: starts, ends, and ids with a -1 after each pre-token."""
    e = encoder(path)
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            spans = e.spans(row.column("piece")[0].as_py(), row.column("k")[0].as_py() * leaf)
            lists = ([[w[0] for w in spans]], pa.int64()), ([[w[1] for w in spans]], pa.int64()), ([[i for w in spans for i in (*w[2], -1)]], pa.int32())
            columns = [row.column(c) for c in ("row", "doc_id", "k", "piece")] + [pa.array(v, pa.list_(t)) for v, t in lists]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "k", "piece", "starts", "ends", "ids"])


def _concatenated(path: str, leaf: int, group: pa.Table) -> pa.Table:
    e, rows = encoder(path), group.sort_by("k").to_pydict()
    leaves = []
    for starts, ends, ids in zip(rows["starts"], rows["ends"], rows["ids"], strict=True):
        words, own = [], iter(ids)
        for a, b in zip(starts, ends, strict=True):
            words.append((a, b, tuple(iter(lambda: next(own), -1))))  # noqa: B023
        leaves.append(words)
    found = e.flat(e.tree("".join(rows["piece"]), leaf, leaves))
    return pa.table({"doc_id": pa.array(rows["doc_id"][:1], pa.int64()), **_digests([_digest(found)])})


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of doc_id, text.

    Null and empty texts have no tokens; repeated rows give repeated rows; an empty table gives none. Texts up to leaf
    characters are encoded where they lie. Of longer ones, each piece is a task's row, and their joins follow by document:
    a task holds one text with its pre-tokens.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = docs.where(~long).mapInArrow(freed(lambda batches: _short(path, batches)), f"doc_id long, {RESULT}")
    kept = stash(docs.where(long).withColumn("row", F.monotonically_increasing_id()), "bpe_long")
    # one pass cuts a text, however long: each match is the next piece
    cut = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{leaf}}}"), F.lit(0))
    pieces = kept.select("row", "doc_id", F.posexplode(cut).alias("k", "piece"))
    encoded = pieces.mapInArrow(freed(lambda batches: _pieces(path, leaf, batches)), "row long, doc_id long, k int, piece string, starts array<long>, ends array<long>, ids array<int>")
    joined = encoded.groupBy("row").applyInArrow(freed_group(lambda group: _concatenated(path, leaf, group)), f"doc_id long, {RESULT}")
    return short.unionByName(joined)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), tokenizer_path())
