"""Mixing sources to target weights by pivotal dependent rounding.

Every record of a source has the same expected number of copies, its source's target over its source's size. The whole
part is taken as it is. The fractions are rounded in pairs: words' mass moves from one record to the other, either way,
with the odds that keep both expectations, until the fraction of one is 0 or 1. The other goes into the next pair, so a
source's total changes only when its last fraction is rounded. Pairs are made within blocks of FAN records, then between
the blocks' residuals, FAN at a time: a reduction tree with a task's work bounded at every level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import WORD, let, ranked, repeated, small, stash, uniform

FAN = 64
SEED = 20240601
WEIGHTS = (3.0, 1.0, 2.0)
EPS = 1e-9
#: Sources are few; up to so many are broadcast, beyond it they are joined by a shuffle.
SOURCES_BROADCAST = 50_000


def words(text):
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n, target from source, source_size, n.

    Sources in code point order, null last, take the weights in turn. The level, a source's share for a weight of 1, starts
    as if none were capped; sources whose cap is under their share are capped and what they leave raises the level, until no
    more are. Sources may be many: they are ranked by sorted parts, and each round sums over them.
    """
    x = ranked(by_source, F.col("source").asc_nulls_last(), "at")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    x = stash(x.select("source", "source_size", "n", w.alias("w"), (most * F.col("source_size")).alias("cap")), "mix_sources")
    want = share * (x.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("w")
        held = x.agg(F.count_if(capped).alias("n"), F.sum(F.when(capped, F.col("cap"))).alias("caps"), F.sum(F.when(~capped, F.col("w"))).alias("open")).first()
        if held["n"] == before or not held["open"]:
            break
        before, level = held["n"], max(level, (want - (held["caps"] or 0.0)) / held["open"])
    share_of = F.lit(level) * F.col("w") if held["open"] else F.col("cap")
    return x.select("source", "source_size", "n", F.least("cap", share_of).alias("target"))


def _pair(acc, x):
    """Fold one record into (residual, decided): pivotal step between the residual and x."""
    r = acc["res"]

    def moved(m):
        up = m["toward"] < F.coalesce(F.try_divide(m["down"], m["up"] + m["down"]), F.lit(0.0))
        by = F.when(up, m["up"]).otherwise(-m["down"])
        return F.struct((r["p"] + by / r["s"]).alias("pr"), (x["p"] - by / x["s"]).alias("px"))

    def settled(m):
        first = (m["pr"] <= EPS) | (m["pr"] >= 1 - EPS)
        keep = F.struct(r["s"].alias("s"), r["id"].alias("id"), r["h"].alias("h"), m["pr"].alias("p"))
        swap = F.struct(x["s"].alias("s"), x["id"].alias("id"), x["h"].alias("h"), F.least(F.greatest(m["px"], F.lit(0.0)), F.lit(1.0)).alias("p"))
        done = F.struct(F.when(first, r["s"]).otherwise(x["s"]).alias("s"), F.when(first, r["id"]).otherwise(x["id"]).alias("id"), F.round(F.when(first, m["pr"]).otherwise(m["px"])).cast("long").alias("c"))
        return F.struct(F.when(first, swap).otherwise(keep).alias("res"), F.concat(acc["out"], F.array(done)).alias("out"))

    step = F.struct(
        F.least(r["s"] * (1 - r["p"]), x["s"] * x["p"]).alias("up"), F.least(r["s"] * r["p"], x["s"] * (1 - x["p"])).alias("down"), uniform(F.lit(SEED), r["h"], x["h"]).alias("toward"),
    )
    return F.when(r.isNull(), F.struct(x.alias("res"), acc["out"].alias("out"))).otherwise(let(step, lambda m: let(moved(m), settled)))


def _level(units: DataFrame) -> DataFrame:
    """source, block, res, out from source, block, u: one residual of each block and what has been decided in it."""
    # large records first: what is left at the end tends to be small
    grouped = units.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("u.s")).alias("o"), F.col("u.h").alias("h"), F.col("u").alias("u")))).alias("us"))
    start = F.struct(F.lit(None).cast("struct<s:double,id:bigint,h:bigint,p:double>").alias("res"), F.lit(None).cast("array<struct<s:double,id:bigint,c:bigint>>").alias("out"))
    start = start.withField("out", F.array().cast("array<struct<s:double,id:bigint,c:bigint>>"))
    return grouped.select("source", "block", F.aggregate(F.transform("us", lambda v: v["u"]), start, _pair).alias("a")).select("source", "block", "a.res", "a.out")


def mix(sized: DataFrame, fan: int = FAN, **plan) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies from doc_id (bigint), source, size.

    Copies are 0, 1 or 2 and depend on the rows alone, so reruns agree. A source's words come within half of one of its
    records of its target. A null source is a source; a null doc_id is an id; records of no words take 0; an empty table
    gives no rows; texts of any length come in as their size. Repeated rows are rounded each for itself: they are counted
    first and numbered, so a third of all rows without an id are dealt over blocks like any others. Other columns are not
    looked at.
    """
    sized = sized.select("doc_id", "source", F.col("size").cast("long").alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    sized = stash(sized, "mix")
    sums = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n"))
    dims = stash(targets(sums, **plan), "mix_targets")
    dims = dims.withColumn("rate", F.coalesce(F.try_divide("target", F.col("source_size")), F.lit(0.0)))
    dims = dims.withColumn("whole", F.floor(F.col("rate") + EPS)).withColumn("frac", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    dims = dims.withColumn("blocks", F.greatest(F.ceil(F.col("n") / fan), F.lit(1)))
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("s"))
    dims = dims.withColumn("key", key).drop("source")
    rows = repeated(sized, "n", "again").withColumn("key", key).join(small(dims, SOURCES_BROADCAST), "key")
    split = (F.col("size") > 0) & (F.col("frac") > EPS)
    shown = ["doc_id", "source", "size", "source_size", "target"]
    h = F.xxhash64(F.lit(SEED), "doc_id", "size", "again")
    units = rows.where(split).select("source", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "size", "again"), F.col("blocks")).alias("block"), F.struct(F.col("size").cast("double").alias("s"), F.col("doc_id").alias("id"), h.alias("h"), F.col("frac").alias("p")).alias("u"))
    most = dims.agg(F.max("blocks")).first()[0] or 1
    decided = []
    while True:
        level = stash(_level(units), "mix_level")
        decided.append(level.select("source", F.explode("out").alias("d")).select("source", "d.id", "d.s", "d.c"))
        if most <= 1:
            break
        most = -(-most // fan)
        units = level.select("source", F.floor(F.col("block") / fan).alias("block"), F.col("res").alias("u"))
    decided.append(level.select("source", "res.id", "res.s", F.round("res.p").cast("long").alias("c")))
    done = reduce(DataFrame.unionByName, decided).select(F.col("id").alias("doc_id"), "source", F.col("s").cast("long").alias("size"), "c")
    done = done.withColumn("key", key).join(small(dims, SOURCES_BROADCAST), "key").select(*shown, (F.col("whole") + F.col("c")).alias("copies"))
    plain = rows.where(~split).select(*shown, F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("copies"))
    return done.unionByName(plain).select(*shown, (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source with weights 3, 1, 2 to 150% of their words, at most twice each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"))).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
