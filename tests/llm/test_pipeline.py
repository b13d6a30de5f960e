"""The pipeline's stages on a small corpus, each against a plain version of what it must do."""

import hashlib
import random
import re
from collections import Counter

import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quantloom.llm import bpe
from quantloom.llm.shared import stash
from tests.llm.test_operators import plain_jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

R = random.Random(8)
PARTS = {"en": ("the", "and", "ing", "was", "er"), "de": ("der", "und", "ung", "ist", "zu"), "fr": ("les", "que", "eau", "est", "ou")}


def text(lang, n):
    return " ".join("".join(R.choice(PARTS[lang]) for _ in range(R.randrange(1, 4))) for _ in range(n))


def corpus():
    rows = [(i, text(lang, R.randrange(20, 80)), lang, R.choice(["a", "b", None]), 0) for i, lang in enumerate(list(PARTS) * 60)]
    copies = [(500 + i, rows[i][1].upper(), "en", "a", 1) for i in range(10)]
    words = rows[20][1].split()
    near = [(600, " ".join([*words, "more"] if len(words) > 40 else words), "de", "b", 1)]
    private = [(700, text("en", 30) + " call +1 (555) 555-2485 or write x.y@mail.example.com " + text("en", 9), "en", "a", 1)]
    odd = [(800, None, None, None, None), (801, "", "en", "a", 0), (802, "$$$ 123", None, "b", 7), (None, text("fr", 40), None, None, None), (3, rows[3][1], "en", rows[3][3], 0)]
    return rows + copies + near + private + odd


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES:
        docs = stash(stage(spark, docs, str(tmp_path)), "test")
        seen.append((name, docs.toPandas()))
    assert [list(x.columns) for _, x in seen[:-1]] == [pipeline.COLUMNS] * 4
    told, unique, clean, mixed, ids = (x for _, x in seen)
    assert not {800, 801, 802} & set(told.doc_id) and len(told) >= len(rows) - 6 and told.lang.notna().all()
    assert not {500, 501, 509, 600} & set(unique.doc_id) and (unique.doc_id == 3).sum() == 1 and unique.doc_id.isna().sum() == 1
    assert set(unique.doc_id.dropna()) == {d for d in told.doc_id.dropna() if d < 500 or d == 700}
    by = clean.set_index("doc_id").text
    assert "<PHONE>" in by[700] and "<EMAIL>" in by[700] and "555" not in by[700]
    before = unique.set_index("doc_id").text
    assert all(by[d] == before[d] for d in before.index.dropna() if d != 700)
    assert (clean.n_chars == clean.text.str.len()).all()
    times = Counter(mixed.doc_id.dropna())
    assert set(times.values()) <= {1, 2} and set(times) <= set(clean.doc_id)
    words = lambda x: x.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).sum()
    assert abs(words(mixed) / words(clean) - 1.5) < 0.1
    library = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    want = Counter(hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for t in mixed.text)
    assert Counter(ids.ids_sha256) == want


def test_empty(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").where(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def plain_near_duplicates(rows):
    """The rows that stay: of each group the first by doc_id, null last; of equal rows one."""
    rows = list(dict.fromkeys(rows))
    group = {i: g for i, _, g in plain_jaccard([(i, r[1]) for i, r in enumerate(rows)])}
    stay = {}
    for i, r in enumerate(rows):
        stay.setdefault(group[i], []).append(r)
    return [(min((r[0] is None, r[0] or 0) for r in own), [r for r in own]) for own in stay.values()]


def test_near_duplicates_by_row(spark):
    """Ids that name several texts, rows without an id, equal rows, ties, very long texts and clashing columns."""
    base = [text("en", 60) for _ in range(12)]
    long = text("de", 20_000)
    rows = [(i % 5, t, "en", None, i) for i, t in enumerate(base)] + [(i, t + " more", "en", "a", 0) for i, t in enumerate(base[:6])]
    rows += [(None, base[0], "en", "a", 1), (None, base[0], "en", "a", 1), (None, base[0].upper(), None, "b", 1), (None, "alone", "en", "a", 1), (None, "alone", "en", "a", 1)]
    rows += [(90, long, "de", "a", 1), (91, long + " x", "de", "a", 1), (92, None, None, None, None), (92, None, None, None, None), (93, "", "en", "a", 0), (94, "", "en", "a", 0)]
    R.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("class", F.lit("clash")).withColumn("row", F.lit(1))
    got = [tuple(r) for r in pipeline.near_duplicates(spark, docs, "").collect()]
    want = plain_near_duplicates(rows)
    assert len(got) == len(want) == len(set(got))
    for (none, first), own in want:
        left = [r for r in got if r in own]
        assert len(left) == 1 and (left[0][0] is None, left[0][0] or 0) == (none, first)


def test_source_mix_by_row(spark):
    """Rows are rounded each for itself, whatever ids they share; what is taken is near the targets and the same again."""
    rows = [(i % 40 if i % 7 else None, text("en", R.randrange(1, 60)), "en", R.choice(["a", "b", None]), i % 3) for i in range(300)]
    rows += [rows[5]] * 30 + [(7, None, None, "a", None), (8, "", "en", "a", 0), (9, " \n", "en", None, 0), (1, text("fr", 9000), "fr", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit("clash"))
    got = Counter(tuple(r) for r in pipeline.source_mix(spark, docs, "").collect())
    have = Counter(rows)
    assert all(n <= 2 * have[r] for r, n in got.items()) and not any(r[1] in (None, "", " \n") for r in got)
    words = lambda rows: sum(n * len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r, n in rows.items())
    assert abs(words(got) / words(have) - 1.5) < 0.02 + 9000 / words(have)
    assert got == Counter(tuple(r) for r in pipeline.source_mix(spark, docs.repartition(7), "").collect())


def test_personal_data_and_ids_of_odd_rows(spark):
    """Clashing columns, repeated rows, null, empty and very long texts keep their number of rows."""
    mail = "write to x.y@mail.example.com now"
    rows = [(1, mail, "en", "a", 3), (1, mail, "en", "a", 3), (None, None, None, None, 9), (2, "", None, None, None), (3, ("plain words " * 40_000) + mail, "en", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("email", F.lit("clash")).withColumn("piece", F.lit(0))
    clean = pipeline.personal_data(spark, docs, "").collect()
    assert [list(r.asDict()) for r in clean] == [pipeline.COLUMNS] * 5
    by = Counter((r.doc_id, (r.text or "none")[-22:], r.n_chars) for r in clean)
    assert by[(1, "write to <EMAIL> now", 20)] == 2 and by[(None, "none", 9)] == by[(2, "none", 0)] == 1
    assert sum(n for (i, t, _), n in by.items() if i == 3 and t.endswith("write to <EMAIL> now")) == 1
    assert len(pipeline.token_ids(spark, docs, "").collect()) == 5
