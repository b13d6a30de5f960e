"""Mining of interpretable rules: quantile bins, cells, exact regression trees, folds and day permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.rules import CONDS, interval
from quantloom.functions.time import halves_up, r6
from quantloom.operators.resample import draw


def unpivot(rows: DataFrame, names: tuple[str, ...], *keep: str) -> DataFrame:
    """A row for each row and feature: keep, feature, x; null features are left out."""
    each = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names))
    return rows.select(*keep, F.explode(each).alias("f")).select(*keep, "f.feature", "f.x").where("x is not null")


def edges(long: DataFrame, q: int, *by: str) -> DataFrame:
    """Bin edges of each feature: none for one value, midpoints for up to q values, else quantiles, each once."""
    values = long.groupBy(*by, "feature", "x").agg(F.count(F.lit(1)).alias("n"))
    kinds = values.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("kinds"), F.percentile("x", F.array(*(F.lit(i / q) for i in range(1, q))), F.col("n")).alias("cuts"))
    few = values.join(kinds.where(F.col("kinds") <= q).select(*by, "feature"), [*by, "feature"])
    few = few.withColumn("mid", (F.col("x") + F.lead("x").over(Window.partitionBy(*by, "feature").orderBy("x"))) / 2).groupBy(*by, "feature").agg(F.sort_array(F.collect_list(r6(F.col("mid")))).alias("mids"))
    chosen = F.when(F.col("kinds") <= q, F.coalesce("mids", F.array().cast("array<double>"))).otherwise(F.array_sort(F.array_distinct(F.transform("cuts", r6))))
    return kinds.join(few, [*by, "feature"], "left").select(*by, "feature", "kinds", chosen.alias("edges"))


def bins(long: DataFrame, cuts: DataFrame, *by: str) -> DataFrame:
    """long with bin, the number of edges at or below x. The edges have a row for each feature, so they are broadcast."""
    at = F.size(F.filter("edges", lambda e: e <= F.col("x")))
    return long.join(F.broadcast(cuts.select(*by, "feature", "edges")), [*by, "feature"]).withColumn("bin", at.cast("long")).drop("edges")


def cells(binned: DataFrame, *by: str) -> DataFrame:
    """Rows, days and mean results of each feature's bins."""
    return binned.groupBy(*by, "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"), F.avg("long").alias("mean_long"), F.avg("short").alias("mean_short"))


def pair_cells(binned: DataFrame, key: list[str], least_rows: int, least_days: int) -> DataFrame:
    """The same for pairs of features: pairs are formed within a row, from its own bins."""
    row = F.array_sort(F.collect_list(F.struct("feature", "bin")))
    x = binned.groupBy(*key, "day").agg(row.alias("f"), F.first("long").alias("long"), F.first("short").alias("short"))
    pairs = F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: b["feature"] > a["feature"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    x = x.select("day", "long", "short", F.explode(pairs).alias("p")).groupBy(F.col("p.a.feature").alias("feature_a"), F.col("p.a.bin").alias("bin_a"), F.col("p.b.feature").alias("feature_b"), F.col("p.b.bin").alias("bin_b"))
    x = x.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"), F.avg("long").alias("mean_long"), F.avg("short").alias("mean_short"))
    return x.where((F.col("n") >= least_rows) & (F.col("days") >= least_days))


def by_side(binned: DataFrame, *key: str) -> DataFrame:
    """key, day, side, s, n: sums and numbers of the results of longs and shorts by day. Partial sums come before the shuffle."""
    daily = binned.groupBy(*key, "day").agg(F.sum("long").alias("sl"), F.count("long").alias("nl"), F.sum("short").alias("ss"), F.count("short").alias("ns"))
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("sl").alias("s"), F.col("nl").alias("n")), F.struct(F.lit(-1).alias("side"), F.col("ss").alias("s"), F.col("ns").alias("n")))
    return daily.select(*key, "day", F.explode(sides).alias("x")).select(*key, "day", "x.*").where("n > 0")


def activated(daily: DataFrame, weights: DataFrame, alpha: float, key: list[str], by: list[str], least_rows: int = 1, least_days: int = 1) -> DataFrame:
    """Of by_side's cells those with a positive sum, enough rows and days, whose lower bound under day resampling is positive
    too. weights is by rep, day and by; cells that fail the rest are dropped before they meet the resamples."""
    cell = [*key, "side"]
    good = daily.groupBy(*cell).agg(F.sum("s").alias("total"), F.sum("n").alias("trades"), F.count(F.lit(1)).alias("days"))
    good = good.where((F.col("total") > 0) & (F.col("trades") >= least_rows) & (F.col("days") >= least_days))
    reps = daily.join(good, cell).join(weights, [*by, "day"]).groupBy(*cell, "total", "trades", "days", "rep")
    reps = reps.agg(F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum(F.col("n") * F.col("w"))).alias("mean"))
    bound = reps.groupBy(*cell, "total", "trades", "days").agg(F.percentile("mean", alpha).alias("lower"))
    return bound.where("lower > 0").select(*cell, "trades", "days", (F.col("total") / F.col("trades")).alias("mean"), "lower")


def best_splits(long: DataFrame, node: str, least: int) -> DataFrame:
    """For each node the feature and threshold whose halves, of least rows or more, differ most by squared error of y.

    Rows are summed by value before they are ordered, so a partition has a feature's different values. Sums are exact to 12
    places, so halves of the same rows have equal gains by any feature, and the first by name and threshold is taken whatever
    the order of rows. Values of 10^12 or more, infinite ones and those that aren't numbers are summed as doubles.
    """
    part = F.col("y").try_cast("decimal(24,12)")
    long = long.withColumn("d", F.coalesce(part, F.lit(0).cast("decimal(24,12)"))).withColumn("e", F.when(part.isNull(), F.col("y")).otherwise(0.0))
    values = long.groupBy(node, "feature", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"), F.sum("e").alias("e"))
    w = Window.partitionBy(node, "feature").orderBy("x")
    whole = Window.partitionBy(node, "feature")
    total = lambda c, over: F.sum(c).over(over).cast("decimal(36,12)")
    x = values.withColumn("nl", F.sum("n").over(w)).withColumn("nr", F.sum("n").over(whole) - F.col("nl"))
    x = x.withColumns({"dl": total("d", w), "dt": total("d", whole), "el": F.sum("e").over(w), "et": F.sum("e").over(whole)})
    x = x.withColumn("threshold", (F.col("x") + F.lead("x").over(w)) / 2).where((F.col("nl") >= least) & (F.col("nr") >= least))
    sl, sr, st = (d.cast("double") + e for d, e in ((F.col("dl"), F.col("el")), (F.col("dt") - F.col("dl"), F.col("et") - F.col("el")), (F.col("dt"), F.col("et"))))
    gain = sl * sl / F.col("nl") + sr * sr / F.col("nr") - st * st / (F.col("nl") + F.col("nr"))
    x = x.withColumn("gain", halves_up(gain, 9))
    top = x.groupBy(node).agg(F.max("gain").alias("gain"))
    x = x.join(top, [node, "gain"]).groupBy(node).agg(F.min(F.struct("feature", "threshold", "gain", "nl", "nr")).alias("b"))
    return x.select(node, "b.*")


def regression_tree(rows: DataFrame, names: tuple[str, ...], y: str, depth: int, least: int, *keep: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows (keep, y) with leaf, a path of L and R, and conds, its conditions: an exact tree for each group of by, one pass of
    best_splits a level for all of them."""
    from quantloom.operators.resample import written

    x = rows.select(*keep, *by, F.col(y).alias("y"), *names).where(" and ".join(f"{c} is not null" for c in ("y", *names))).withColumn("leaf", F.lit("")).withColumn("conds", F.array().cast(CONDS))
    for _ in range(depth):
        x = written(x.withColumn("node", F.concat_ws("/", *by, "leaf")), "tree")
        splits = best_splits(unpivot(x, names, "node", "y"), "node", least).select("node", F.col("feature").alias("on"), "threshold")
        value = F.element_at(F.create_map(*[c for n in names for c in (F.lit(n), F.col(n).cast("double"))]), F.col("on"))
        left, none = value <= F.col("threshold"), F.lit(None)
        # at most 2 ** depth rows for each group
        x = x.join(splits, "node", "left")
        step = F.when(left, interval(F.col("on"), none, F.col("threshold"), True, True)).otherwise(interval(F.col("on"), F.col("threshold"), none, False, False))
        x = x.withColumn("conds", F.when(F.col("on").isNull(), F.col("conds")).otherwise(F.concat("conds", F.array(step))))
        x = x.withColumn("leaf", F.when(F.col("on").isNull(), F.col("leaf")).otherwise(F.concat("leaf", F.when(left, "L").otherwise("R")))).drop("on", "threshold", "node")
    return x


def leaves(tree: DataFrame, *by: str) -> DataFrame:
    """Rows and mean of each leaf, with its conditions as text."""
    step = lambda c: F.concat(c["feature"], F.when(c["lo"].isNull(), F.concat(F.lit(" <= "), F.format_number(c["hi"], 6))).otherwise(F.concat(F.lit(" > "), F.format_number(c["lo"], 6))))
    return tree.groupBy(*by, "leaf", F.array_join(F.transform("conds", step), " and ").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))


def folds(days: DataFrame, train: int, embargo: int, width: int) -> DataFrame:
    """day, fold, role: each fold tests the next width days and trains on all before, less an embargo; days has day."""
    x = days.select("day").distinct().withColumn("n", F.row_number().over(Window.orderBy("day")))
    x = x.withColumn("fold", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.lit(x.count()) - train - 1) / width)).cast("int"))))
    start = train + F.col("fold") * width
    role = F.when(F.col("n") <= start - embargo, "train").when((F.col("n") > start) & (F.col("n") <= start + width), "test")
    return x.select("day", F.col("fold").cast("long").alias("fold"), role.alias("role")).where("role is not null")


def day_permutation(days: DataFrame, seed: int, run: Column) -> DataFrame:
    """day, run, source_day: the days of each run in another order, told by MD5. There are as many days as in the calendar."""
    x = days.select("day").distinct().withColumn("run", run)
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("day"))).withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "run", "day")))))
    return x.select("run", "day", "n").join(x.select("run", F.col("day").alias("source_day"), F.col("k").alias("n")), ["run", "n"]).select("run", "day", "source_day")


def permuted(rows: DataFrame, mapping: DataFrame, values: list[str], key: list[str]) -> DataFrame:
    """rows (key without the day, day, values) with the values of the source day at the same key; null where it has none."""
    source = rows.select(*key, F.col("day").alias("source_day"), *(F.col(v).alias(f"p_{v}") for v in values))
    return rows.join(mapping, "day").join(source, [*key, "source_day"], "left")


