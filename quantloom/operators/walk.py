"""Rules fitted on the training days of each fold and traded on its test days, on real and on permuted targets.

Runs, folds and horizons are columns, so one set-based job fits them all. Rules are rows: direction and an array of conditions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.config import Params
from quantloom.functions.rules import holds, interval
from quantloom.operators import mining
from quantloom.operators.resample import boot_weights_by, written

#: A model's group: a run (-1: real targets), a fold and a horizon.
GROUP = ("run", "fold", "horizon")
FAMILIES = ("M1", "M2", "M3")
#: A rule; fa, ba, fb, bb are the features and bins of a cell, which rows are joined on. A leaf has none, only conditions.
CELL = ("fa", "ba", "fb", "bb")
RULE = (*GROUP, "family", "rule_id", "direction", "conds", "n", "days", "mean", *CELL)


def training(rows: DataFrame, targets: DataFrame, folds: DataFrame, runs: int, seed: int) -> DataFrame:
    """rows (series, t, day, features) with run, fold, horizon, long, short on their folds' training days.

    In run -1 results are the rows' own. In the others every training day of a fold takes those of one other, told by MD5, at
    the same slot: one mapping for all horizons, sides and series. A row whose source day lacks its slot has none.
    """
    train = folds.where("role = 'train'").select("fold", "day").join(rows.select("day").distinct(), "day", "left_semi")
    own = rows.select("series", "t", "day", F.pmod("t", F.lit(1440)).alias("slot")).join(targets.select("series", "t", "horizon", "long", "short"), ["series", "t"]).where("long is not null and short is not null")
    real = own.join(train, "day").select(F.lit(-1).cast("long").alias("run"), "fold", "horizon", "series", "day", "slot", "long", "short")
    each = F.concat_ws(":", F.lit(str(seed)), "run", "fold", "day")
    x = train.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long")))) if runs else train.withColumn("run", F.lit(0).cast("long")).limit(0)
    w = Window.partitionBy("run", "fold")
    x = x.withColumn("i", F.row_number().over(w.orderBy("day"))).withColumn("k", F.row_number().over(w.orderBy(F.md5(each))))
    mapping = x.select("run", "fold", "day", "i").join(x.select("run", "fold", F.col("day").alias("source"), F.col("k").alias("i")), ["run", "fold", "i"])
    moved = mapping.join(own.select(F.col("day").alias("source"), "series", "slot", "horizon", "long", "short"), "source").select("run", "fold", "horizon", "series", "day", "slot", "long", "short")
    return rows.withColumn("slot", F.pmod("t", F.lit(1440))).join(real.unionByName(moved), ["series", "day", "slot"]).drop("slot")


def _bound(at: Column, edges: Column) -> tuple[Column, Column]:
    """The edges around a bin; null beyond the first and the last."""
    return F.when(at > 0, F.try_element_at(edges, at.cast("int"))), F.try_element_at(edges, (at + 1).cast("int"))


def edges(train: DataFrame, names: tuple[str, ...], p: Params) -> DataFrame:
    """run, fold, horizon, family, feature, edges: of the bins of M1 and M2, from the training rows."""
    long = written(mining.unpivot(train, names, *GROUP), "walk_values")
    each = [mining.edges(long, n, *GROUP).withColumn("family", F.lit(family)) for family, n in (("M1", p.m1_bins), ("M2", p.m2_bins))]
    return written(reduce(DataFrame.unionByName, each).select(*GROUP, "family", "feature", "edges"), "walk_edges")


def cells(rows: DataFrame, cuts: DataFrame, names: tuple[str, ...], family: str, on: list[str], keep: list[str]) -> DataFrame:
    """GROUP, keep and the cells (fa, ba, fb, bb) that a row is in: one for each feature, or for each pair of features, which
    are formed within a row. cuts are joined on the columns on and the feature."""
    long = mining.unpivot(rows, names, *on, *keep).join(F.broadcast(cuts.where(F.col("family") == family).drop("family")), [*on, "feature"])
    long = long.withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("x"))).cast("long"))
    if family == "M1":
        return long.select(*GROUP, *keep, F.col("feature").alias("fa"), F.col("bin").alias("ba"), F.lit(None).cast("string").alias("fb"), F.lit(None).cast("long").alias("bb"))
    x = long.groupBy(*GROUP, *keep).agg(F.array_sort(F.collect_list(F.struct("feature", "bin"))).alias("f"))
    each = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda b: F.struct(a["feature"].alias("fa"), a["bin"].alias("ba"), b["feature"].alias("fb"), b["bin"].alias("bb")))))
    return x.select(*GROUP, *keep, F.explode(each).alias("q")).select(*GROUP, *keep, "q.*")


def _activated(train: DataFrame, cuts: DataFrame, weights: DataFrame, names: tuple[str, ...], family: str, p: Params) -> DataFrame:
    """Cells of a family that are activated, as rules."""
    x = cells(train, cuts, names, family, list(GROUP), ["series", "t", "day", "long", "short"])
    daily = written(mining.by_side(x, *GROUP, *CELL), "walk_days")
    few = (p.m2_min_rows, p.m2_min_days) if family == "M2" else (1, 1)
    on = mining.activated(daily, weights, p.alpha, [*GROUP, *(CELL if family == "M2" else CELL[:2])], ["fold"], *few)
    if family == "M1":
        on = on.withColumn("fb", F.lit(None).cast("string")).withColumn("bb", F.lit(None).cast("long"))
    sides = "ab" if family == "M2" else "a"
    for s in sides:
        on = on.join(F.broadcast(cuts.where(F.col("family") == family).select(*GROUP, F.col("feature").alias(f"f{s}"), F.col("edges").alias(f"e{s}"))), [*GROUP, f"f{s}"])
    conds = F.array(*(interval(F.col(f"f{s}"), *_bound(F.col(f"b{s}"), F.col(f"e{s}"))) for s in sides))
    name = F.concat_ws("-", F.lit(family), "horizon", "fold", F.concat_ws(":", *CELL, "side"))
    return on.withColumns({"family": F.lit(family), "rule_id": name, "direction": F.col("side"), "conds": conds, "n": F.col("trades")})


def singles(train: DataFrame, cuts: DataFrame, weights: DataFrame, names: tuple[str, ...], p: Params) -> DataFrame:
    """M1: bins of one feature that are activated."""
    return _activated(train, cuts, weights, names, "M1", p)


def pairs(train: DataFrame, cuts: DataFrame, weights: DataFrame, names: tuple[str, ...], p: Params) -> DataFrame:
    """M2: cells of two features that are activated."""
    return _activated(train, cuts, weights, names, "M2", p)


def trees(train: DataFrame, names: tuple[str, ...], p: Params) -> DataFrame:
    """M3: leaves of an exact regression tree on the results of longs; long where their mean is positive, else short where that
    of shorts is. A group of too few rows for a leaf has no tree."""
    few = train.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= p.min_leaf).select(*GROUP)
    x = mining.regression_tree(train.join(few, list(GROUP), "left_semi"), names, "long", p.m3_depth, p.min_leaf, "day", "short", by=GROUP)
    x = x.groupBy(*GROUP, "leaf").agg(F.first("conds").alias("conds"), F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"), F.avg("y").alias("up"), F.avg("short").alias("down"))
    side = F.when(F.col("up") > 0, 1).when(F.col("down") > 0, -1)
    name = F.concat_ws("-", F.lit("M3"), "horizon", "fold", "leaf")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in zip(CELL, ("string", "long") * 2, strict=True)]
    return x.select(*GROUP, F.lit("M3").alias("family"), name.alias("rule_id"), side.alias("direction"), "conds", "n", "days", F.when(side == 1, F.col("up")).otherwise(F.col("down")).alias("mean"), *none).where("direction is not null")


def rules(train: DataFrame, cuts: DataFrame, names: tuple[str, ...], p: Params, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """The rules of all families, a row each."""
    weights = written(boot_weights_by(train.select("fold", "day"), "fold", p.fit_reps, p.seed), "walk_weights")
    made = {"M1": lambda: singles(train, cuts, weights, names, p), "M2": lambda: pairs(train, cuts, weights, names, p), "M3": lambda: trees(train, names, p)}
    return reduce(DataFrame.unionByName, (made[f]().select(*RULE) for f in families))


def fired(rows: DataFrame, rules: DataFrame, names: tuple[str, ...], on: list[str]) -> DataFrame:
    """rows (on, series, t, day) and the rules of their group that hold for them: for rules of which there are few."""
    values = F.create_map(*[c for n in names for c in (F.lit(n), F.col(n).cast("double"))])
    x = rows.select(*on, "series", "t", "day", values.alias("values"))
    return x.join(F.broadcast(rules), on).where(holds(F.col("conds"), F.col("values"))).drop("values")


def traded(rows: DataFrame, targets: DataFrame, folds: DataFrame, rules: DataFrame, cuts: DataFrame, names: tuple[str, ...], families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Out-of-fold trades: run, fold, horizon, family, series, t, day, dir, net. A row is traded where the rules of a family
    that fire take one direction alone and the horizon has a result. Rows meet cells by their bins; leaves, of which a tree has
    a few, by their conditions."""
    test = rows.join(F.broadcast(folds.where("role = 'test'").select("fold", "day")), "day")
    at, hits = ["series", "t", "day"], []
    for family in families:
        own = rules.where(F.col("family") == family)
        if family == "M3":
            hits.append(fired(test, own.select(*GROUP, "family", "direction", "conds"), names, ["fold"]).select(*GROUP, "family", *at, "direction"))
        else:
            key = [*GROUP, *(CELL if family == "M2" else CELL[:2])]
            hits.append(cells(test, cuts, names, family, ["fold"], at).join(own.select(*key, "family", "direction"), key).select(*GROUP, "family", *at, "direction"))
    taken = reduce(DataFrame.unionByName, hits).groupBy(*GROUP, "family", *at).agg(F.max("direction").alias("dir"), F.min("direction").alias("low")).where("dir = low").drop("low")
    results = targets.where("long is not null").select("series", "t", "horizon", "long", "short")
    return taken.join(results, ["series", "t", "horizon"]).select(*GROUP, "family", *at, "dir", F.when(F.col("dir") > 0, F.col("long")).otherwise(F.col("short")).alias("net"))


def means(trades: DataFrame, horizons: DataFrame, runs: DataFrame, families: tuple[str, ...] = FAMILIES, value: str = "net") -> DataFrame:
    """run, family, horizon, trades, days, mean_net for all of them; without a trade the mean is null."""
    every = runs.join(F.broadcast(horizons.select("horizon").distinct())).withColumn("family", F.explode(F.array(*map(F.lit, families))))
    own = trades.groupBy("run", "family", "horizon").agg(F.count(F.lit(1)).alias("trades"), F.countDistinct("day").alias("days"), F.avg(value).alias("mean_net"))
    return every.join(own, ["run", "family", "horizon"], "left").na.fill(0, ["trades", "days"])


def threshold(x: Column, low: float, high: float) -> Column:
    """-1 above high, 1 above low, else 0."""
    return F.when(x <= low, 0).when(x <= high, 1).otherwise(-1)
