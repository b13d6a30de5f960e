"""The registered queries themselves, on a folder of small tables with the contract's edge rows, against plain versions."""

import base64
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quantloom.llm import bpe, queries
from tests.llm.test_operators import PRIVATE, SECRETS, expected_spans, level, luhn, plain_jaccard, plain_map

R = random.Random(21)
PARTS = {"en": ("the", "and", "ing", "was", "er"), "de": ("der", "und", "ung", "ist", "zu"), "fr": ("les", "que", "eau", "est", "ou")}
WORD = r"[^\x20\x09-\x0D]+"


def text(lang, n):
    return " ".join("".join(R.choice(PARTS[lang]) for _ in range(R.randrange(1, 4))) for _ in range(n))


def luhn_number():
    body = "4" + "".join(R.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if luhn(body + c))


def documents():
    rows = [[i, text(lang, R.randrange(8, 90)), lang if i % 11 else R.choice(list(PARTS)), R.choice(["a", "b", "ä", None])] for i, lang in enumerate(list(PARTS) * 70)]
    more = [f"mail x.y{R.randrange(99)}@m.example.com now", f"host {R.randrange(256)}.7.{R.randrange(256)}.9 and 300.1.1.1", f"card {luhn_number()} not 4111111111111112", "call +1 (269) 555-3296 today", 'token = "' + hashlib.sha1(b"x").hexdigest() + '"', "AKIA" + "Q7" * 8 + " key", "password: hunter22!", "<|endoftext|> é😀   x"]
    for i in range(0, 200, 5):
        rows[i][1] += " " + R.choice(more)
    for i in range(160, 180):
        rows[i][1] = rows[i - 160][1] if i % 2 else rows[i - 160][1] + " more"
    rows += [[300, None, None, None], [301, "", "en", "a"], [302, " \t\n", "de", "b"], [303, "12 $$", None, None], [None, text("fr", 30), "fr", None], [None, text("fr", 30), None, "a"], [7, text("en", 12), "en", "a"], [3, *rows[3][1:]], [304, text("de", 12_000), "de", "empty"], [305, "x" * 50_000, None, "b"]]
    return [(*r, len(r[1] or "")) for r in rows]


DOCS = documents()
VECTORS = np.random.default_rng(3).standard_normal((420, 64)).astype(np.float32)
VECTORS[40:60] = VECTORS[0] + 0.1 * VECTORS[40:60]
VECTORS[60:70] = VECTORS[1]
VECTOR_ROWS = [(i, [float(v) for v in x], 0) for i, x in enumerate(VECTORS)] + [(900, None, 0), (1000, [0.0] * 64, 1), (1100, [float("nan")] * 64, 1), (1200, [None] + [1.0] * 63, 0), (100, [float(v) for v in VECTORS[5]], 2)]
PAGES = [(i, f"http://h/{i}", h) for i, h in enumerate(["<p>a</p>", "", None, "é" * 9000, "<p>a</p>", "b\r\n\r\nWARC/1.1"] * 6)] + [(None, None, "<p>a</p>"), (500, None, "only")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    clash = {"row": F.lit(1), "class": F.lit("clash"), "size": F.lit("clash"), "hex": F.lit("clash")}
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(VECTOR_ROWS, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("clash")).write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).write.parquet(f"{at}/pages.parquet")
    return at


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, folder):
    got = run(spark, folder, "op1_mixing")
    size = lambda t: len(re.findall(WORD, t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, size(t)) for d, t, *_ in DOCS)
    sources = sorted({s for *_, s, _ in DOCS}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, _, s, _ in DOCS if s == own) for own in sources]
    want = dict(zip(sources, zip(sizes, level(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]), strict=True), strict=True))
    for r in got:
        assert (r.source_size, round(r.target, 4)) == (want[r.source][0], round(want[r.source][1], 4)) and 0 <= r.taken <= 2 * r.size
    for s in sources:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s][1]) <= max(r.size for r in got if r.source == s)
    assert sorted(map(str, got)) == sorted(map(str, run(spark, folder, "op1_mixing")))


def spans_of(kinds, text, order):
    rank = {k: i for i, (k, *_) in enumerate(kinds)}
    found = expected_spans(kinds, text)
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: order(rank[x[0]], x[1]))), found


@pytest.mark.parametrize(("name", "kinds", "order"), [("op2_secrets", SECRETS, lambda k, a: (a, k)), ("op5_pii", PRIVATE, lambda k, a: (k, a))])
def test_spans(spark, folder, name, kinds, order):
    got = run(spark, folder, name)
    want = sorted((d or -1, sha(spans_of(kinds, t, order)[0]), *(sum(k == kind for k, *_ in spans_of(kinds, t, order)[1]) for kind, *_ in kinds)) for d, t, *_ in DOCS)
    assert sorted((r.doc_id or -1, r.base_sha256, *(r[f"n_{kind}"] for kind, *_ in kinds)) for r in got) == want
    assert all(f"{k}:{a}:{b}" in r.spans.split(",") for r in got for d, t, *_ in DOCS if d == r.doc_id and d not in (3, 7, None) for k, a, b in expected_spans(kinds, t))


def test_op3(spark, folder):
    got = {r.page_id: r for r in run(spark, folder, "op3_warc")}
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first.setdefault(h or "", i)
    assert len(got) == len(PAGES)
    for i, _, h in PAGES:
        data, revisit = (h or "").encode(), i is not None and first[h or ""] != i
        assert tuple(got[i])[:5] == (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None)


def test_op4(spark, folder):
    got = run(spark, folder, "op4_language_id")
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    assert sorted((r.doc_id or -1, r.held_out) for r in got) == sorted((d or -1, out(d)) for d, *_ in DOCS)
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got} == {"en", "de", "fr", "und"}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {300, 301, 302, 303}
    own = {i: k for i, k in enumerate(list(PARTS) * 70) if not 160 <= i < 180}
    assert np.mean([r.lang_pred == own[r.doc_id] for r in got if r.held_out and r.doc_id in own and r.doc_id not in (3, 7)]) > 0.97


def test_op6(spark, folder):
    got = run(spark, folder, "op6_jaccard")
    rows = [(i, t) for i, (_, t, *_) in enumerate(DOCS)]
    group = {i: (n, g) for i, n, g in plain_jaccard(rows)}
    least = {}
    for i, (d, *_) in enumerate(DOCS):
        if d is not None:
            least[group[i][1]] = min(d, least.get(group[i][1], d))
    want = sorted(str((d, group[i][0], least.get(group[i][1]))) for i, (d, *_) in enumerate(DOCS))
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want


def test_op7(spark, folder):
    library = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    want = []
    for d, t, *_ in DOCS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append(str((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))))
    assert sorted(str(tuple(r)[:4]) for r in run(spark, folder, "op7_bpe")) == sorted(want)


def test_op8(spark, folder):
    got, now, grown = run(spark, folder, "op8_sharding"), plain_map(16, 4096), plain_map(17, 4096)
    slot = lambda d: int(hashlib.md5(str("null" if d is None else d).encode()).hexdigest()[:8], 16) % 4096
    want = sorted(str((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", now[slot(d)], grown[slot(d)])) for d, t, *_ in DOCS)
    assert sorted(str((r.doc_id, r.size, r.text_crc32, r.law, r["shard"], r.grown_shard)) for r in got) == want
    for k in range(16):
        own = sorted(r.slot for r in got if r["shard"] == k)
        assert own == list(range(len(own)))


def usable():
    rows = [(i, x) for i, x, _ in VECTOR_ROWS if x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    return [i for i, _ in rows], np.array([x for _, x in rows], np.float64)


def test_op9(spark, folder):
    got, (ids, x) = run(spark, folder, "op9_nearest"), usable()
    want = []
    for q, i in enumerate(ids):
        if i % 100 == 0:
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            near = sorted((d[j], ids[j]) for j in range(len(ids)) if j != q)[:10]
            want += [(i, k + 1, v, round(e, 9)) for k, (e, v) in enumerate(near)]
    told = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got]
    assert len(told) == len(want) and len(set(told) & set(want)) >= 0.95 * len(set(want)) and {q for q, *_ in told} == {0, 100, 200, 300, 400}


def test_op10(spark, folder):
    got, (ids, x) = run(spark, folder, "op10_near_vectors"), usable()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    group = list(range(len(ids)))
    for _ in range(len(ids)):
        new = [min(group[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
        if new == group:
            break
        group = new
    first = {g: min(ids[i] for i in range(len(ids)) if group[i] == g) for g in set(group)}
    want = [(i, int(near[k].sum()) - 1, first[group[k]], i == first[group[k]]) for k, i in enumerate(ids)] + [(i, 0, i, True) for i in (900, 1000, 1100, 1200)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline(spark, folder):
    """The whole pipeline on a table whose columns clash: each row comes from a document, and ids as often as it is taken."""
    got = pipeline.run(spark, folder).collect()
    assert got and {r.doc_id for r in got} <= {d for d, *_ in DOCS} - {300, 301, 302, 303, 161, 163}
    assert all(r.n_tokens > 0 for r in got)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    rows = want.fetchdf()[names]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, spark.createDataFrame(rows.astype(object).where(rows.notna(), None), got.select(*names).schema).collect()))
