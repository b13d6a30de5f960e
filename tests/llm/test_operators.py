"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows, clashing names."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import components, hnsw, jaccard, langid, mixing, near_vectors, pii, secrets, sharding, warc
from quantloom.llm.shared import new_path, stash

R = random.Random(3)
WORDS = [a + b for a in ("an", "the", "re", "ing", "ou", "er") for b in ("", "st", "ti", "ed", "la", "ch")]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


# ---- mixing


def level(sizes, weights, share=1.5, most=2.0):
    want, low, high = share * sum(sizes), 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < want else (low, mid)
    return [min(most * s, low * w) for s, w in zip(sizes, weights, strict=True)]


@pytest.fixture(scope="module")
def sized(spark):
    rows = [(i, s, R.randrange(0, 300)) for i, s in enumerate(["a"] * 900 + ["b"] * 120 + ["ä"] * 70 + [None] * 40)]
    rows += [(None, "a", 5), (None, None, 7), (3, "b", 9), (3, "b", 9), (5000, "empty", 0)]
    return stash(spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("copies", F.lit("clash")), "test")


def test_mixing(sized):
    out = mixing.mix(sized, fan=8).toPandas()
    assert len(out) == sized.count()
    assert (out.taken <= 2 * out["size"]).all() and (out.taken == out.copies * out["size"]).all()
    by = out.assign(s=out.source.fillna("\U0010ffff")).groupby("s").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (by["size"] == by.told).all()
    want = level(by["size"].tolist(), [(3, 1, 2)[i % 3] for i in range(len(by))])
    assert np.allclose(by.target, want, rtol=1e-9, atol=1e-6)
    assert ((by.taken - by.target).abs() <= by.most / 2 + 1e-6).all()
    again = mixing.mix(sized.repartition(5), fan=8).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, out[key].fillna(-1).to_numpy().tolist())) == sorted(map(str, again[key].fillna(-1).to_numpy().tolist()))
    assert mixing.mix(sized.where("false")).count() == 0


def test_mixing_keeps_expectations(sized):
    rows = sized.where("source = 'a' and size > 100")
    share = mixing.mix(rows, share=0.5).toPandas()
    assert abs(share.copies.mean() - 0.5) < 0.06 and set(share.copies) <= {0, 1}


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("a\x0bb c\n d",), ("é x y",)], "text string")
    assert [r[0] for r in df.select(mixing.words(F.col("text"))).collect()] == [0, 0, 0, 3, 2]


def test_mixing_of_repeated_rows(spark):
    """Rows without an id and of one size are dealt over blocks; long runs of repeats over tasks."""
    same = spark.range(12_500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("size"))
    out = mixing.mix(same.unionByName(spark.range(500).selectExpr("id AS doc_id", "'b' AS source", "id AS size")), share=0.5).toPandas()
    by = out.groupby("source").agg(rows=("taken", "size"), taken=("taken", "sum"), target=("target", "first"))
    assert list(by.rows) == [12_500, 500] and abs(by.taken["a"] - by.target["a"]) <= 5 and abs(by.taken["b"] - by.target["b"]) <= 250
    assert 0 < out[out.source == "a"].copies.mean() < 1


# ---- sharding


def plain_map(shards, slots):
    """The map grown shard by shard, by the rule in words: each old shard gives floor(own / (n + 1)) slots, by MD5."""
    held = {0: sorted(range(slots), key=lambda s: hashlib.md5(str(s).encode()).hexdigest())}
    for n in range(1, shards):
        given = [s for k in range(n) for s in held[k][: len(held[k]) // (n + 1)]]
        held = {k: own[len(own) // (n + 1) :] for k, own in held.items()}
        held[n] = sorted(given, key=lambda s: hashlib.md5(str(s).encode()).hexdigest())
    return {s: k for k, own in held.items() for s in own}


def test_sharding_against_plain_slots(spark):
    ids = [*range(300), None, -7, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for shards in (1, 2, 15, 16, 17):
        got = sharding.shard(df, "doc_id", F.lit(1), F.lit(0), shards).collect()
        now, grown = plain_map(shards, sharding.SLOTS), plain_map(shards + 1, sharding.SLOTS)
        for r in got:
            slot = int(hashlib.md5(str("null" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:8], 16) % sharding.SLOTS
            assert (r.vslot, r["shard"], r.grown_shard) == (slot, now[slot], grown[slot])
        assert len(got) == len(ids) and max(now.values()) == shards - 1
        share = [list(now.values()).count(k) for k in range(shards)]
        assert max(share) - min(share) <= 0.1 * sharding.SLOTS / shards


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r for r in sharding.shard(df, "doc_id", F.lit(1), F.lit(0), 16).collect()}
    after = {r.doc_id: r["shard"] for r in sharding.shard(df, "doc_id", F.lit(1), F.lit(0), 17).collect()}
    assert {i: r.grown_shard for i, r in before.items()} == after
    assert all(after[i] in (r["shard"], 16) for i, r in before.items())


def test_sharding_of_hot_keys(spark):
    """A null key and a repeated row hold two thirds of all rows; a slot's parts are numbered without a gap."""
    rows = spark.range(36_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, 5).alias("doc_id"), F.when(F.col("id") % 3 == 1, 1).otherwise(F.col("id")).alias("crc"))
    out = sharding.shard(rows, "doc_id", F.lit(3), F.col("crc"), 16, part_rows=500).toPandas()
    assert len(out) == 36_000 and (out["size"] == 3).all()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    for _, own in out[out.doc_id.isna() | (out.doc_id == 5)].groupby("vslot"):
        assert (own.slot_bytes == 3 * len(out[out.vslot == own.vslot.iloc[0]])).all()


def test_sharding(spark):
    rows = [(i, R.choice([None, "", "x" * 50, prose(9)])) for i in range(700)] + [(None, "n"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    text = F.coalesce("text", F.lit(""))
    out = sharding.shard(df, "doc_id", F.octet_length(text) + 1, F.crc32(F.encode(text, "UTF-8")), 16).toPandas()
    assert len(out) == len(rows)
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert ((out.grown_shard == out["shard"]) | (out.grown_shard == 16)).all() and (out.grown_shard == 16).any()
    assert sorted(out.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    few = sharding.shard(df.where("doc_id < 20"), "doc_id", F.lit(1), F.lit(0), 16).toPandas().set_index("doc_id")["shard"]
    assert (out.dropna().drop_duplicates("doc_id").set_index("doc_id").loc[few.index]["shard"] == few).all()
    assert sharding.shard(df.where("false"), "doc_id", F.lit(1), F.lit(0), 16).count() == 0


def test_rebalanced_map(spark):
    path = new_path(spark, "maps")
    sharding.store_map(sharding.first_map(spark, 4, 64), path)
    sized = spark.range(4000).select(sharding.slot_of(F.col("id"), 64).alias("vslot"), (F.when(F.col("id") % 7 == 0, 90).otherwise(1)).alias("size"))
    stats = sharding.slot_bytes(sized)
    after = sharding.rebalanced_map(sharding.load_map(spark, path, 1), stats)
    sharding.store_map(after, path)
    totals = [r[0] for r in sharding.load_map(spark, path, 2).join(stats, "vslot", "left").groupBy("shard").agg(F.sum("slot_bytes")).collect()]
    assert max(totals) - min(totals) <= 0.05 * sum(totals) / 4 + 100 and sharding.load_map(spark, path, 1).count() == 64


# ---- WARC


def test_warc(spark):
    htmls = ["<p>a</p>", "", None, "x\r\n\r\nWARC/1.1\r\n\r\n", "é" * 20_000, "<p>a</p>", "<p>b</p>"] * 5
    rows = [(i, f"http://x/{i}\r\nEvil: 1", h) for i, h in enumerate(htmls)] + [(None, None, "<p>a</p>"), (1000, None, "only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("payload", F.lit("clash"))
    for least in (0, 9):
        warc.write(df, path := new_path(spark, "warc"), least=least)
        got = {r.page_id: r for r in warc.read(spark, path, True).collect()}
        assert len(got) == len(rows)
        first = {}
        for i, _, h in rows[: len(htmls)]:
            first.setdefault(h or "", i)
        for i, _, h in rows:
            data, r = (h or "").encode(), got[i]
            revisit = i is not None and first.get(h or "", i) != i and len(data) >= least
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert (r.record_type, r.refers_to) == (("revisit", first[h or ""]) if revisit else ("response", None))
            assert r.payload == (None if revisit else data)
    warc.write(df.where("false"), path := new_path(spark, "warc"))
    assert warc.read(spark, path).count() == 0


# ---- language


def test_language(spark):
    kinds = {"xx": "abcde", "yy": "fghij", "zz": "aeiou"}
    rows = [(i, "".join(R.choice(kinds[k] + "  ") for _ in range(R.randrange(20, 300))) + "z", k) for i, k in enumerate(list(kinds) * 150)]
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 $$$", None), (1003, "ABCDE abcde " * 9000, None), (1004, "abc dde", None), (1004, "abc dde", None), (None, "fghij", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("n", F.lit("clash"))
    model = langid.train(df)
    got = langid.identify(df, model).toPandas()
    assert len(got) == len(rows) + len(odd) and got.score.between(0, 1).all()
    own = got[got.doc_id < 1000]
    assert (own.lang == own.lang_pred).mean() > 0.99 and own.rejected.mean() < 0.02
    by = got.set_index("doc_id")
    assert by.lang_pred[1000] == by.lang_pred[1001] == by.lang_pred[1002] == "und" and by.rejected[1002] and by.score[1001] == 0
    assert by.lang_pred[1003] == "xx"
    assert langid.identify(df.where("false"), model).count() == 0
    none = langid.train(df.where("false"))
    assert set(langid.identify(df, none).toPandas().lang_pred) == {"und"}


def test_language_rejects_what_it_does_not_know(spark):
    """Random letters and an unseen language of 50 to 200 characters, though some labels are wrong; clean texts stay."""
    parts = {"en": ("the", "and", "ing", "was", "er"), "de": ("der", "und", "ung", "ist", "zu"), "fr": ("les", "que", "eau", "est", "ou")}
    say = lambda own, n: " ".join("".join(R.choice(own) for _ in range(R.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(parts[k], R.randrange(20, 120)), k if i % 12 else R.choice(list(parts))) for i, k in enumerate(list(parts) * 300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = ["".join(R.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in range(50, 200, 5)] + [say(("ciao", "gatto", "piove", "mio", "sull"), n) for n in range(10, 40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(1000 + i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = langid.identify(docs, model).toPandas()
    assert got[got.doc_id < 1000].rejected.all() and got[got.doc_id >= 1000].rejected.mean() < 0.002


def plain_kneser_ney(texts, gram):
    """The interpolated Kneser-Ney probability of a 4-gram's last symbol, by counts in dictionaries."""
    order = langid.ORDER
    grams = [{} for _ in range(order + 1)]
    for t in texts:
        x = langid.symbols(t)
        for i in range(len(x) - order + 1):
            g = tuple(map(int, x[i : i + order]))
            grams[order][g] = grams[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] = grams[n].get(g[1:], 0) + 1

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(grams[1]) + 1)
        c = grams[n]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
        own = [v for k, v in c.items() if k[:-1] == g[:-1]]
        if not own:
            return p(g[1:])
        return max(c.get(g, 0) - d, 0) / sum(own) + d * len(own) / sum(own) * p(g[1:])

    return p(tuple(gram))


def test_kneser_ney_against_plain_counts():
    texts = ["abracadabra cadabra abra", "bab baa abba abra", "cad dac acd"]
    found, n = np.unique(np.concatenate([langid.keys(langid.symbols(t)) for t in texts]), return_counts=True)
    model = langid.fit(["q"], found, np.zeros(len(found), np.int64), n.astype(float))
    for word in ("abra", "zzab", "cadz", "a bc", "dddd"):
        x = langid.symbols(word)
        got = model.scores(langid.keys(x))[:, 0]
        want = [math.log(plain_kneser_ney(texts, x[i : i + langid.ORDER])) for i in range(len(x) - langid.ORDER + 1)]
        assert np.allclose(got, want, atol=1e-4), word


def test_kneser_ney_sums_to_one():
    x = langid.symbols("abracadabra cadabra abra")
    found, n = np.unique(langid.keys(x), return_counts=True)
    model = langid.fit(["q"], found, np.zeros(len(found), np.int64), n.astype(float))
    for context in ("abr", "zzz", "a b"):
        c = langid.symbols(context)[-3:]
        letters = np.array([*map(ord, "abcdr"), 0], np.uint64)
        k = np.array([(int(c[0]) << 48) | (int(c[1]) << 32) | (int(c[2]) << 16) | int(w) for w in letters], np.uint64)
        total = np.exp(model.scores(k)[:, 0]).sum() + math.exp(model.scores(np.array([(int(k[0]) & ~0xFFFF) | 0x7A7A], np.uint64))[0, 0])
        assert abs(total - 1) < 1e-4


# ---- secrets and personal data


def expected_spans(kinds, text):
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m)]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
SECRET_TEXTS = [None, "", "secret=token: abcdefgh", "PASSWORD = 'hunter22' Token:abc", "é😀 api_key=\"abcdef1234567890\" x", "AKIAAKIA" + "Z9" * 8, "AKIA short AKIA" + "B" * 15, "f" * 23 + " " + "0a" * 12, "token=" + "a" * 50_000, "x" * 3000, "key aZ3kQ9xV1bN7mT5wR2yU8pL4 end", "an_ordinary_identifier_name", "token=abcdef token=abcdef"]


def test_secrets(spark):
    rows = [(i, t) for i, t in enumerate(SECRET_TEXTS)] + [(100 + i, prose(60)) for i in range(80)] + [(8, SECRET_TEXTS[8])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit("clash") for k in ("assign", "access", "hex", "random", "secrets", "a.b")})
    model = secrets.train(secrets.random_strings(spark, 800).unionByName(secrets.identifiers(df)))
    assert 0 <= model.wrong < 0.02 and 0 <= model.missed < 0.1
    got = secrets.find(df, model)
    assert got.columns == [*(c for c in df.columns if c != "secrets"), "secrets"] and got.count() == len(rows)
    base, every = secrets.spans()
    for r in got.select("doc_id", "text", base.alias("base"), "secrets.random", F.col("hex").alias("clash")).collect():
        assert sorted((s.kind, s.start, s.end) for s in r.base) == sorted(expected_spans(SECRETS, r.text)), r.text
        assert r.clash == "clash"
        found = [r.text[s.start : s.end] for s in r.random]
        assert found == (["aZ3kQ9xV1bN7mT5wR2yU8pL4"] if r.doc_id == 10 else []), found
    assert secrets.find(df.where("false"), model).count() == 0


def plain_ratio(token, table):
    """The two models' mean log-likelihood ratio, pair by pair."""
    n = len(secrets.ALPHABET)
    places = [secrets.ALPHABET.index(c) for c in token]
    return sum(table[a * n + b] for a, b in zip(places, places[1:], strict=False)) / (len(token) - 1)


def test_random_strings_against_plain_models(spark):
    """Counts, ratios, threshold and found spans against loops over the same labelled tokens."""
    made = [(t, True) for t in ("".join(R.choice(secrets.ALPHABET) for _ in range(R.randrange(16, 40))) for _ in range(400))]
    made += [(R.choice(["_", "-"]).join(R.choice(WORDS) for _ in range(R.randrange(4, 9))), False) for _ in range(900)] + [(None, True), ("a", False), ("nö", True)]
    rows = spark.createDataFrame(made, "token string, secret boolean")
    model = secrets.train(rows)
    folds = {r.token: r.fold for r in rows.select("token", F.pmod(F.xxhash64("token"), F.lit(secrets.FOLDS)).alias("fold")).collect()}
    known = [(t, s) for t, s in made if t and len(t) > 1 and t.isascii()]
    n = len(secrets.ALPHABET)
    counts = np.ones((2, n, n))
    for t, s in known:
        if folds[t] > 1:
            for a, b in zip(t, t[1:], strict=False):
                counts[int(s), secrets.ALPHABET.index(a), secrets.ALPHABET.index(b)] += 1
    logs = np.log(counts / counts.sum(2, keepdims=True))
    assert np.allclose(model.ratio, (logs[1] - logs[0]).reshape(-1), atol=1e-9)
    x = {k: [plain_ratio(t, model.ratio) for t, s in known if folds[t] == k[0] and s == k[1] and len(t) >= secrets.LEAST] for k in ((0, True), (0, False), (1, True), (1, False))}
    low = np.percentile(x[0, True], 0.5)
    want = max(0.25, min(low, (np.percentile(x[0, False], 99.9) + low) / 2))
    assert abs(model.threshold - want) < 1e-4
    assert abs(model.wrong - np.mean([v > want for v in x[1, False]])) < 1e-9 and abs(model.missed - np.mean([v <= want for v in x[1, True]])) < 1e-9
    texts = [" ".join(R.choice(made)[0] or "" for _ in range(9)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find(df, model).collect():
        base = [(a, b) for _, a, b in expected_spans(SECRETS, r.text)]
        plain = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", r.text)]
        plain = [(a, b) for a, b in plain if not any(a < d and c < b for c, d in base) and re.search("[A-Za-z]", r.text[a:b]) and plain_ratio(r.text[a:b], model.ratio) > model.threshold]
        assert [(s.start, s.end) for s in r.secrets.random] == plain


PRIVATE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
]


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train(pii.sentences(spark, 1500))


def test_personal_data(spark, pii_model):
    texts = [None, "", "a@b.c_d@e.f x@y a@b@c.de", "1.2.3.4.5.6.7.8 256.1.1.1 010.0.0.1", "é 4111 1111 1111 1111 and 4111111111111112", "+1 (269) 555-3296 4524132264652876", "+49 30 1234567 call", "0" * 9000 + ".1.1.1", "a." * 4000 + "@x", "9 " * 4000]
    some = "abz019.@+- ()é"
    texts += ["".join(R.choice(some) for _ in range(40)) for _ in range(150)]
    clash = {k: F.lit("clash") for k in ("email", "ip", "added", "personal", "x.y")}
    df = spark.createDataFrame(list(enumerate(texts)) + [(4, texts[4])], "doc_id long, text string").withColumns(clash)
    own = pii.spans()[0]
    got = pii.find(df, pii_model)
    assert got.columns == [*(c for c in df.columns if c != "personal"), "personal"] and got.count() == len(texts) + 1
    for r in got.select("doc_id", "text", own.alias("base"), "personal.added").collect():
        assert sorted((s.kind, s.start, s.end) for s in r.base) == sorted(expected_spans(PRIVATE, r.text)), r.text
        assert all(a.end <= b.start or b.end <= a.start for a in r.added for b in r.base)
        if r.doc_id == 5:
            assert [(s.kind, r.text[s.start : s.end]) for s in r.added] == [("likely_phone", "+1 (269) 555-3296")]
    out = {r.doc_id: r for r in pii.redacted(df, pii_model).collect()}
    assert out[4].text == "é <CARD> and 4111111111111112" and out[0].text is None and out[4].email == "clash" and out[4].personal == "clash"
    assert pii.redacted(df.where("false"), pii_model).count() == 0


def test_trees_against_plain_ones(spark, pii_model):
    """The trees' scores inside a query against walking them; what is added against a loop over the proposed spans."""
    rows = [(i, r.text, r.truth) for i, r in enumerate(pii.sentences(spark, 200, seed=5).collect())]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    scored = F.transform(pii.proposed(F.col("text")), lambda c: F.struct(c, pii.odds(pii_model, c["rank"], c["x"]).alias("odds")))
    got = pii.find(df, pii_model).select("*", scored.alias("scored")).collect()
    n = 0
    for r in got:
        base = [s for k in pii.KINDS for s in r.personal[k]]
        want = []
        for c, odds in r.scored:
            assert abs(odds - pii_model.trees[c.kind].odds(c.x)) < 1e-6
            if odds > pii_model.threshold[c.kind] and not any(c.start < s.end and s.start < c.end for s in base):
                want.append((f"likely_{c.kind}", c.start, c.end))
        assert sorted((s.kind, s.start, s.end) for s in r.personal.added) == sorted(want)
        n += len(want)
    assert n > 20


def test_personal_data_held_out(spark, pii_model):
    """Precision and recall among spans that the model hasn't seen, and labels from documents' own spans."""
    assert all(p is None or p >= 0.95 for p in pii_model.precision.values())
    texts = [f"{prose(12)} {x} {prose(12)}" for x in ("x.y@mail.example.com", "9.8.7.6", "4111111111111111", "+1 (269) 555-3296", "4111111111111112", "plain")] + [None, ""]
    labelled = pii.windows(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    kinds = [r.truth[0].kind for r in labelled if r.truth]
    assert sorted(kinds) == sorted([*pii.KINDS] * 2) and sum(not r.truth for r in labelled) == 1
    assert all(r.text[r.truth[0].start : r.truth[0].end].strip() for r in labelled if r.truth)
    assert "x.y at mail.example dot com" in {r.text[t.start : t.end] for r in labelled for t in r.truth}


# ---- Jaccard


def plain_jaccard(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard(spark, monkeypatch):
    passage, base, other = prose(60), prose(120).split(), prose(200).split()
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A\x0bb c d E", "a b c d f"]
    texts += [" ".join(base[:k] + ["new"] + base[k:]) for k in range(0, 120, 3)] + [" ".join(base)] * 5
    texts += [" ".join(other[: 200 - k]) for k in range(0, 90, 2)] + [" ".join(other[:k] + [f"w{k}"] * 3 + other[k + 9 :]) for k in range(0, 180, 4)]
    texts += [prose(30) + " " + passage + " " + prose(R.randrange(5, 40)) for _ in range(60)] + [prose(R.randrange(4, 90)) for _ in range(60)] + [prose(9000)]
    rows = list(enumerate(texts))
    R.shuffle(rows)
    rows += [(3, "one"), (rows[7][0], rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("clash"))
    want = plain_jaccard(rows)
    assert sorted(map(tuple, jaccard.join(df).collect())) == want
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # several blocks, rounds and partitions of a bucket
    monkeypatch.setattr(jaccard, "LEAF", 4)
    assert sorted(map(tuple, jaccard.join(df.repartition(7)).collect())) == want
    assert jaccard.join(df.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(-5, 200), (200, 200), (300, 300)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, -5: -5, 200: -5}
    assert got == want


# ---- vectors


def vectors(n, seed, dim=24):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    x[20:60] = x[0] + 0.12 * r.standard_normal((40, dim))
    x[60:80] = x[1]
    return x


def rows_of(x):
    rows = [(i, [float(v) for v in v]) for i, v in enumerate(x)]
    bad = [(9000, None), (9001, []), (9002, [0.0] * x.shape[1]), (9003, [float("nan")] + [1.0] * (x.shape[1] - 1)), (9004, [float("inf")] * x.shape[1]), (9005, [None] + [1.0] * (x.shape[1] - 1)), (9006, [1.0, 2.0, 3.0])]
    return rows, bad


def test_near_vectors(spark, monkeypatch):
    x = vectors(400, 1)
    rows, bad = rows_of(x)
    df = spark.createDataFrame(rows + bad + [rows[5]], "vec_id long, embedding array<float>").withColumn("n", F.lit("clash"))
    y = np.concatenate([x, x[5:6]]).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    ids = [*range(400), 5]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    for block in (4096, 16):
        monkeypatch.setattr(near_vectors, "BLOCK", block)
        got = sorted(near_vectors.near(df, "vec_id", "embedding").collect())
        assert [(r.vec_id, r.n_links) for r in got if r.vec_id < 9000] == sorted(zip(ids, near.sum(1).tolist(), strict=True))
        by = {r.vec_id: r for r in got}
        assert by[30].component_id == by[0].component_id == 0 and by[70].component_id == 1 and not by[70].kept and by[1].kept
        assert all((by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True) for i, _ in bad)
    assert near_vectors.near(df.where("false"), "vec_id", "embedding").count() == 0


def test_near_vectors_at_the_limit(spark):
    """Pairs at a cosine of 0.95 and a little on either side, of any magnitude, are told by double precision."""
    rows, want, r = [], {}, np.random.default_rng(8)
    for i in range(60):
        x, y = r.standard_normal((2, 32))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        cosine = 0.95 + (i % 3 - 1) * 1e-9
        pair = np.stack([x, cosine * x + math.sqrt(1 - cosine**2) * y]) * 2.0 ** (i * 9 - 270)
        one, two = pair / np.linalg.norm(pair, axis=1, keepdims=True)
        if abs(one @ two - 0.95) > 1e-15:  # closer ones depend on the order of the sum
            want |= dict.fromkeys((2 * i, 2 * i + 1), int(one @ two >= 0.95))
        rows += [(2 * i + k, [float(v) for v in pair[k]]) for k in range(2)]
    got = {v.vec_id: v.n_links for v in near_vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()}
    assert {k: got[k] for k in want} == want and set(want.values()) == {0, 1}


@pytest.mark.parametrize(("n", "dim", "fall", "least"), [(100_000, 64, 0, 0.999), (1_000_000, 64, 0, 0.999), (1_000_000, 64, 0.5, 0.999), (1_000_000, 16, 0, 0.999), (100_000_000, 64, 0, 0.999), (100_000_000, 16, 0, 0.998), (10_000, 24, 0, 0.999)])
def test_filters_for_many_vectors(n, dim, fall, least):
    """Pairs at cosine 0.95 share a filter or have a vector in few, whatever n and the fall of energy over the dimensions."""
    r, m, code = np.random.default_rng(5), 2000, near_vectors.Code.fitting(n, dim, 0.95)
    x, y = near_vectors.unit(r.standard_normal((2, m, dim)).reshape(2 * m, dim) / (1 + np.arange(dim)) ** fall).reshape(2, m, dim)
    y = near_vectors.unit(y - (x * y).sum(1, keepdims=True) * x)
    (a, f), (b, g) = near_vectors.decode(x, code), near_vectors.decode(0.95 * x + math.sqrt(1 - 0.95**2) * y, code)
    shared = np.bincount(np.array([i for i, _ in set(zip(a.tolist(), f.tolist(), strict=True)) & set(zip(b.tolist(), g.tolist(), strict=True))]), minlength=m)
    scarce = np.minimum(np.bincount(a, minlength=m), np.bincount(b, minlength=m)) < near_vectors.SCARCE
    assert ((shared > 0) | scarce).mean() >= least and scarce.mean() < 0.02 and 17 < shared.mean() < 24


def test_near_vectors_in_few_filters(spark, monkeypatch):
    x, flat = vectors(300, 6), np.random.default_rng(7).standard_normal((150, 3)).astype(np.float32)
    rows = [(i, [float(v) for v in v]) for i, v in enumerate(x)] + [(1000 + i, [float(v) for v in v]) for i, v in enumerate(flat)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {}
    for first, own in ((0, x), (1000, flat)):
        y = near_vectors.unit(own)
        want |= {first + i: int(k) - 1 for i, k in enumerate((y @ y.T >= 0.95).sum(1))}
    for fewest, block in ((10, 4096), (32, 4096), (32, 32)):  # few and about half of the vectors are compared with all
        monkeypatch.setattr(near_vectors, "SCARCE", fewest)
        monkeypatch.setattr(near_vectors, "BLOCK", block)
        assert {r.vec_id: r.n_links for r in near_vectors.near(df, "vec_id", "embedding").collect()} == want


def test_nearest(spark):
    x = vectors(1500, 2)
    rows, bad = rows_of(x)
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in hnsw.search(df, "vec_id", "embedding", every=20, k=10, shard_rows=400).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y, hits = x.astype(float), 0
    for q in range(0, 1500, 20):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = sorted(zip(d.tolist(), range(1500), strict=True))[:10]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in own) and [s for *_, s in own] == sorted(s for *_, s in own)
        hits += len({i for _, i in want} & {i for _, i, _ in own})
    assert hits >= 0.97 * 750
    assert [i for _, i, _ in sorted(got[60])] == [1, *range(61, 70)]  # equal vectors, the smaller ids first
    assert hnsw.search(df.where("vec_id = 20"), "vec_id", "embedding", every=20).count() == 0
    assert len(hnsw.search(df.where("vec_id in (20, 21, 22)"), "vec_id", "embedding", every=20).collect()) == 2


@pytest.mark.parametrize("scales", [(1e-30,), (1e25,), (1, 1e25), (1, 1e-30), (1e-200, 1, 1e200), (5e-324 * 2**60, 1e308 / 64)])
def test_nearest_of_any_magnitude(scales):
    """A shard with vectors of one or several magnitudes, as _index and _searched see it, against brute force."""
    r, n = np.random.default_rng(4), 300
    x = r.standard_normal((n, 8)) * np.array(scales)[np.arange(n) % len(scales)][:, None]
    same = hnsw.pa.array([[{"id": i, "row": i}] for i in range(n)], hnsw.pa.list_(hnsw.pa.struct([("id", hnsw.pa.int64()), ("row", hnsw.pa.int64())])))
    table = hnsw.pa.table({"dim": hnsw.pa.array([8] * n, hnsw.pa.int32()), "shard": hnsw.pa.array([0] * n, hnsw.pa.int32()), "class": np.arange(n), "same": same, "vector": hnsw.pa.array(x.tolist(), hnsw.pa.list_(hnsw.pa.float64()))})
    graph = hnsw._index(table).append_column("kind", hnsw.pa.array([0])).to_pylist()
    asked = [{"kind": 1, "query_row": i, "query_id": i, "vector": x[i].tolist()} for i in range(0, n, 7)]
    kinds = hnsw.pa.schema([("dim", hnsw.pa.int32()), ("levels", hnsw.pa.int32()), ("entry", hnsw.pa.int64()), ("kind", hnsw.pa.int32()), ("query_row", hnsw.pa.int64()), ("query_id", hnsw.pa.int64()), ("vector", hnsw.pa.list_(hnsw.pa.float64())), *((c, hnsw.pa.binary()) for c in ("copies", "ids", "rows", "vectors", "links"))])
    batches = [hnsw.pa.RecordBatch.from_pylist([{c: r.get(c) for c in kinds.names} for r in part], kinds) for part in (graph + asked[:20], asked[20:])]
    got = hnsw.pa.Table.from_batches(list(hnsw._streamed(batches, 5))).to_pandas()
    hits = 0
    for q in range(0, n, 7):
        d = [math.dist(x[q], v) for v in x]
        want = sorted((e, i) for i, e in enumerate(d) if i != q)[:5]
        own = got[got.query_id == q]
        assert len(own) == 5 and np.allclose(own.score, [d[i] for i in own.vec_id], rtol=1e-12, atol=0)
        hits += len({i for _, i in want} & set(own.vec_id))
    assert hits >= 0.97 * 5 * len(range(0, n, 7))


def test_nearest_of_repeated_ids(spark):
    """Every row with a query's id is a query, and a candidate of the other rows; queries are dealt over several blocks."""
    x = vectors(300, 9)
    rows = [(i if i % 3 else 100, [float(v) for v in v]) for i, v in enumerate(x)] + [(200, [float(v) for v in x[0]])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    y = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        near = sorted((d[i], int(ids[i]), i) for i in range(len(rows)) if i != q)[:10]
        want += [(int(ids[q]), k + 1, i, round(e, 9)) for k, (e, i, _) in enumerate(near)]
    for block in (100_000, 20):
        got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in hnsw.search(df, "vec_id", "embedding", k=10, shard_rows=150, queries_of=block).collect()]
        assert len(got) == len(want) and len(set(got) & set(want)) >= 0.99 * len(set(want))
