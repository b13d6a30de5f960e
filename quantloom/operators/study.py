"""Studies on top of mined rules: exits as targets, frozen rules on later days, their tables and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import outcomes, resample, walk

CONFIG = ("run", "family", "horizon")


def exit_targets(results: DataFrame) -> DataFrame:
    """series, t, horizon, long, short from exits' results: the name of an exit stands in the place of a horizon."""
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("r")))
    return results.groupBy("series", "t", F.col("exit").alias("horizon")).agg(of(1).alias("long"), of(-1).alias("short"))


def exit_trades(traded: DataFrame, results: DataFrame) -> DataFrame:
    """Out-of-fold trades with what their exit tells: tc, exit_tc, reason, conflict, usd, r."""
    told = results.select("series", "t", F.col("exit").alias("horizon"), F.col("side").alias("dir"), "tc", "exit_tc", "reason", "conflict", F.col("net").alias("usd"), "r")
    return traded.drop("net").join(told, ["series", "t", "horizon", "dir"])


def single(trades: DataFrame) -> DataFrame:
    """Those of one position at a time in each configuration, series and day."""
    return outcomes.one_at_a_time(trades, [*CONFIG, "series", "day"])


def summary(value: str = "r") -> list[Column]:
    won, lost = F.when(F.col(value) > 0, F.col(value)), F.when(F.col(value) <= 0, F.col(value))
    return [F.count(F.lit(1)).alias("trades"), F.countDistinct("day").alias("days"), F.avg(value).alias("mean_r"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"), F.avg(won).alias("avg_win"), F.avg(lost).alias("avg_loss")]


def base_rate(results: DataFrame, folds: DataFrame, rows: DataFrame) -> DataFrame:
    """horizon, fold, best: the larger mean of always long and always short, one position at a time, on a fold's test rows."""
    test = rows.select("series", "t", "day").join(folds.where("role = 'test'").select("fold", "day"), "day")
    x = results.where("r is not null").drop("day").join(test, ["series", "t"]).withColumnRenamed("exit", "horizon").select("horizon", "side", "series", "day", "fold", "t", "tc", "exit_tc", "r")
    x = outcomes.one_at_a_time(x, ["horizon", "side", "series", "day"])
    means = x.groupBy("horizon", "side", "fold").agg(F.avg("r").alias("m"))
    return means.groupBy("horizon", "fold").agg(F.max("m").alias("best"))


def exit_table(trades: DataFrame, every: DataFrame, means: DataFrame, base: DataFrame, weights: DataFrame, alpha: float) -> DataFrame:
    """A row for each family and exit of the real run: summary of one position at a time, bounds, p against the best of the
    runs with permuted training results, how it ended, drawdown, all moments, and its folds against the base rates.

    trades: one position at a time; every: all trades; means: run, family, horizon, null_mean.
    """
    by = ["family", "horizon"]
    real = trades.where("run = -1")
    ends = [F.count_if(F.col("reason") == k).alias(name) for k, name in ((1, "stops"), (2, "targets"), (3, "ends"))]
    whole = real.groupBy(*by).agg(*summary(), F.avg("usd").alias("mean_usd"), F.avg(F.col("conflict").cast("double")).alias("conflict_share"), *ends)
    boot = resample.day_bootstrap(real, weights, by, "r", alpha).select(*by, "lower")
    null = means.where("run >= 0")
    best = resample.max_statistic_p(whole.select(*by, F.col("mean_r").alias("mean")), resample.null_best(null), by).select(*by, "p_max")
    fall = resample.drawdown(real, by, "r", ["tc", "series"]).select(*by, "drawdown")
    moments = every.where("run = -1").groupBy(*by).agg(F.count(F.lit(1)).alias("all_trades"), F.avg("r").alias("all_mean_r"))
    parts = real.groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m")).join(base, ["horizon", "fold"], "left")
    parts = parts.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.min("n").alias("min_trades"), F.min("m").alias("min_mean"), F.min(F.col("m") - F.col("best")).alias("min_over_base"))
    joined = reduce(lambda a, b: a.join(b, by, "left"), (boot, best, fall, moments, parts), whole)
    return joined.join(null.groupBy(*by).agg(F.avg("null_mean").alias("null_mean")), by, "left")


def exit_verdict(table: DataFrame, folds: int, least: int, good: float = 0.05, fair: float = 0.10) -> DataFrame:
    """The table with passes, weak and the verdict: PASS if a configuration gains in each of so many folds, its lower bound is
    over 0, its p under good, each fold's mean over both base rates and its trades least or more; WEAK if one gains in each
    fold and its p is under fair; else STOP."""
    gains = (F.col("folds") == folds) & (F.col("min_mean") > 0)
    x = table.withColumn("passes", F.coalesce(gains & (F.col("lower") > 0) & (F.col("p_max") < good) & (F.col("min_over_base") > 0) & (F.col("min_trades") >= least), F.lit(False)))
    x = x.withColumn("weak", ~F.col("passes") & F.coalesce(gains & (F.col("p_max") < fair), F.lit(False)))
    every = Window.partitionBy(F.lit(0))  # a row for each configuration
    return x.withColumn("verdict", F.when(F.max("passes").over(every), "PASS").when(F.max("weak").over(every), "WEAK").otherwise("STOP"))


def frozen_pool(rows: DataFrame, targets: DataFrame, rules: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """series, day, t, dir, long, short: all rows with results of both sides and the direction that frozen rules take; 0 where
    none fires or they differ. rules has rule_id, direction, conds."""
    pool = rows.join(targets.where("long is not null and short is not null").select("series", "t", "long", "short"), ["series", "t"])
    hits = walk.fired(pool.withColumn("all", F.lit(1)), F.broadcast(rules.select("direction", "conds").withColumn("all", F.lit(1))), names, ["all"])
    taken = hits.groupBy("series", "t").agg(F.max("direction").alias("up"), F.min("direction").alias("down"))
    x = pool.select("series", "day", "t", "long", "short").join(taken, ["series", "t"], "left")
    return x.select("series", "day", "t", F.when(F.col("up") == F.col("down"), F.col("up")).otherwise(0).cast("long").alias("dir"), "long", "short")


def threshold_pool(moments: DataFrame, targets: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """The same for a day's first moment with a value and results of both sides: long between two limits, short above."""
    first = Window.partitionBy("series", "day").orderBy("t")
    x = moments.withColumn("k", F.row_number().over(first)).where("k = 1").where(F.col(value).isNotNull())
    x = x.join(targets.where("long is not null and short is not null").select("series", "t", "long", "short"), ["series", "t"])
    return x.select("series", "day", "t", walk.threshold(F.col(value), low, high).cast("long").alias("dir"), "long", "short")


def traded(pool: DataFrame) -> DataFrame:
    return pool.where("dir <> 0").withColumn("r", F.when(F.col("dir") > 0, F.col("long")).otherwise(F.col("short")))


def evaluated(pool: DataFrame, period: Column) -> DataFrame:
    """hypothesis, period: trades, days, mean, share of winners and longs, rows that might be traded and their base rates."""
    net = F.when(F.col("dir") > 0, F.col("long")).when(F.col("dir") < 0, F.col("short"))
    on = F.col("dir") != 0
    x = pool.withColumn("net", net).withColumn("period", period)
    return x.groupBy("hypothesis", "period").agg(
        F.count_if(on).alias("trades"), F.countDistinct(F.when(on, F.col("day"))).alias("days"), F.avg("net").alias("mean"), F.avg(F.when(on, (F.col("net") > 0).cast("double"))).alias("win_rate"),
        F.avg(F.when(on, (F.col("dir") > 0).cast("double"))).alias("long_share"), F.count(F.lit(1)).alias("eligible"), F.avg("long").alias("base_long"), F.avg("short").alias("base_short"),
    )


def frozen_verdict(pool: DataFrame, weights: DataFrame, period: Column, alpha: float) -> DataFrame:
    """A row for each hypothesis: mean, bounds, share of resampled means at or below 0, Holm's over all, checks and verdict.

    It passes if it gains in each period, its lower bound is over 0, each period's mean is over both base rates and Holm's p
    is under alpha. One that never trades has p 1.
    """
    parts = evaluated(pool, period)
    fine = F.coalesce((F.col("trades") > 0) & (F.col("mean") > 0), F.lit(False))
    over = F.coalesce((F.col("trades") > 0) & (F.col("mean") > F.greatest("base_long", "base_short")), F.lit(False))
    checks = parts.groupBy("hypothesis").agg(F.min(fine).alias("gains"), F.min(over).alias("beats_base"), F.sum("trades").alias("trades"))
    boot = resample.day_bootstrap(traded(pool), weights, ["hypothesis"], "r", alpha).select("hypothesis", "mean", "lower", "p_boot")
    x = checks.join(boot, "hypothesis", "left").withColumn("p", F.coalesce("p_boot", F.lit(1.0))).drop("p_boot")
    x = x.join(resample.holm(x.select("hypothesis", "p"), ["hypothesis"], alpha).select("hypothesis", "p_holm", "reject"), "hypothesis")
    x = x.withColumn("passes", F.coalesce(F.col("gains") & F.col("beats_base") & (F.col("lower") > 0) & F.col("reject"), F.lit(False)))
    return x.withColumn("verdict", F.when(F.max("passes").over(Window.partitionBy(F.lit(0))), "PASS").otherwise("FAIL"))


def direction_days(trades: DataFrame, period: Column) -> DataFrame:
    """period: trades, days, and how many days were all long, all short or mixed, with the means of either side."""
    of = lambda side: F.avg(F.when(F.col("dir") == side, F.col("r")))
    daily = trades.withColumn("period", period).groupBy("period", "day").agg(F.min("dir").alias("low"), F.max("dir").alias("high"))
    kinds = daily.groupBy("period").agg(F.count_if(F.col("low") == 1).alias("all_long"), F.count_if(F.col("high") == -1).alias("all_short"), F.count_if(F.col("low") != F.col("high")).alias("mixed"), F.count(F.lit(1)).alias("days"))
    means = trades.withColumn("period", period).groupBy("period").agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col("dir") == 1).cast("double")).alias("long_share"), F.avg("r").alias("mean"), of(1).alias("long_mean"), of(-1).alias("short_mean"))
    return means.join(kinds, "period")
