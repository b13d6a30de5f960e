"""Against the library on whole texts, cut anywhere."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.llm import bpe

PATH = bpe.tokenizer_path()
HARD = ["", "  ", "Don't DON'T 's'T''ll", "a\x1cb\xa0c　d​e\x85f", "ΑΣ ΣΑΣ. İi ǅ ﬁ Å", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|", "²³¼ x² 12345", "中文字 テスト 😀😀", "!!'s ''s \"'re\"", "\x00\x01", "é" * 50, "“Quote” — 5€…", "ŉ ſ Ÿ ĲĳŊ ¡¿ ªº µ"]


@pytest.fixture(scope="module")
def e():
    return bpe.Encoder(PATH)


def whole(e, text):
    ids = e.library.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), e.library.decode(ids, skip_special_tokens=False)


def test_equals_library(e):
    for text in HARD:
        assert e.encoded(text) == whole(e, text), text
    r = random.Random(5)
    some = "abzAZéÉßñ'sStT09.,! \n\t\x85\xa0-_\"²ſ"
    for _ in range(3000):
        text = "".join(r.choice(some) for _ in range(r.randrange(30)))
        assert e.encoded(text) == whole(e, text), text


def test_tree_equals_whole(e):
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice([*HARD, "the ", "of and, ", "Ththlyatat", "aaaaaaaa" * 20, "12 ", "!!!"]) for _ in range(r.randrange(1, 25)))
        for leaf in (5, 17, 64, 1000):
            assert e.flat(e.tree(text, leaf)) == whole(e, text), (text, leaf)


def test_unsplit_text(e):
    text = "thequickbrown" * 3000
    assert e.flat(e.tree(text, 1000)) == whole(e, text)


def test_query(spark, e):
    texts = [None, *HARD, *HARD[:3], "Long words and text. " * 400]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "a b", "x", "y"), (3, "twice " * 50, "", ""), (3, "twice " * 50, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, k string")
    for leaf in (40, 1 << 15):
        got = bpe.encode(docs, PATH, leaf).collect()
        want = sorted((-1 if d is None else d, n, bpe._sha(ids), bpe._sha(out)) for d, t, *_ in rows for n, ids, out in [whole(e, t or "")])
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    assert bpe.encode(docs.where(F.lit(False)), PATH).count() == 0
