"""Spans of regular expressions' matches, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.llm.shared import let

BLOCK = 64
SPANS = "array<struct<start:int,end:int,s:string>>"


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one; by blocks, so that long arrays don't take quadratic time."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))

    def offsets(x):
        return F.flatten(F.transform(x["blocks"], lambda block, b: let(total(F.slice(x["sums"], F.lit(1), b)), lambda base: F.transform(block, lambda _, i: base + total(F.slice(block, F.lit(1), i))))))

    return let(blocks, lambda bs: let(F.struct(bs.alias("blocks"), F.transform(bs, total).alias("sums")), offsets))


def matches(text: Column, pattern: str, when: Column | None = None) -> Column:
    """start, end (in code points, end exclusive) and text of the leftmost non-overlapping matches, as an array.

    Gaps come from split and matches from regexp_extract_all, both with the same matcher. Null where when isn't true;
    nothing matches in a null text.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(x):
        steps = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
        befores = let(F.transform(steps, lambda s: s["g"] + s["h"]), _running)
        return F.zip_with(F.arrays_zip(befores.alias("b"), steps.alias("s")), x["hits"], lambda p, h: F.struct((p["b"] + p["s"]["g"]).alias("start"), (p["b"] + p["s"]["g"] + p["s"]["h"]).alias("end"), h.alias("s")))

    found = let(F.struct(gaps.alias("gaps"), hits.alias("hits")), lambda x: F.when(F.size(x["hits"]) > 0, placed(x)))
    when = text.rlike(pattern) if when is None else when
    return F.coalesce(F.when(when, found), F.array().cast(SPANS))


def named(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))


def listed(spans: Column, *order: str) -> Column:
    """kind:start:end of named spans, comma-joined, sorted by the given fields."""
    keyed = F.transform(spans, lambda s: F.struct(*(s[o].alias(o) for o in order), s["end"].alias("e"), s["kind"].alias("k"), s["start"].alias("b")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["b"].cast("string"), s["e"].cast("string"))), ",")


def apart(spans: Column, others: Column) -> Column:
    """Those spans that overlap none of the others."""
    return F.filter(spans, lambda a: ~F.exists(others, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each of the named spans, overlapping ones as one, replaced by its kind in angle brackets."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = F.when(s["start"] >= acc["at"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], new).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
