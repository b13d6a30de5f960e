"""Statistics by resampling whole days, permutation and maximum-statistic tests, Holm's step-down, verdicts.

Random numbers are the first 32 bits of an MD5 of seed, repetition and draw, so any engine can repeat them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.time import halves_up


def new_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder in spark.checkpoint.dir. Where that is unset, one is set: a temporary folder on a single
    machine, an error on a cluster, whose executors don't share the driver's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/quantloom/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def draw(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def boot_weights(spark: SparkSession, days: DataFrame, reps: int, seed: int) -> DataFrame:
    """rep, day, w: how often each day is in each resample of as many days. Days are as many as in the calendar."""
    numbered = days.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    n = numbered.count()
    draws = spark.range(reps * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("d"))
    picked = draws.select("rep", (draw(F.lit(str(seed)), F.col("rep"), F.col("d")) % n).alias("i")).groupBy("rep", "i").agg(F.count(F.lit(1)).alias("w"))
    return picked.join(numbered, "i").select("rep", "day", "w")


def boot_weights_by(days: DataFrame, by: str, reps: int, seed: int) -> DataFrame:
    """by, rep, day, w: the same for the days of each group. days has by and day."""
    own = Window.partitionBy(by)
    numbered = days.select(by, "day").distinct().withColumn("i", F.row_number().over(own.orderBy("day")) - 1).withColumn("all", F.count(F.lit(1)).over(own))
    draws = numbered.select(by, "i", "all", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    picked = draws.select(by, "rep", (draw(F.lit(str(seed)), by, "rep", "i") % F.col("all")).alias("i")).groupBy(by, "rep", "i").agg(F.count(F.lit(1)).alias("w"))
    return picked.join(numbered.drop("all"), [by, "i"]).select(by, "rep", "day", "w")


def day_bootstrap(trades: DataFrame, weights: DataFrame, by: list[str], value: str, alpha: float) -> DataFrame:
    """Mean, bounds, share of resampled means at or below 0, days and trades of each group; trades are summed by day first."""
    daily = trades.where(F.col(value).isNotNull()).groupBy(*by, "day").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    reps = daily.join(weights, "day").groupBy(*by, "rep").agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("m"))
    bounds = reps.groupBy(*by).agg(F.percentile("m", alpha).alias("lower"), F.percentile("m", 1 - alpha).alias("upper"), F.avg((F.col("m") <= 0).cast("double")).alias("p_boot"))
    whole = daily.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("days"), F.sum("n").alias("trades"))
    return whole.join(bounds, by)


def permutation_p(real: DataFrame, null: DataFrame, by: list[str]) -> DataFrame:
    """by, mean, p: the share of null runs at or above the real mean; a run without trades counts as 0, no mean gives 1."""
    x = real.join(null.select(*by, F.coalesce("null_mean", F.lit(0.0)).alias("z")), by, "left")
    p = F.coalesce(F.avg(F.when(F.col("mean").isNotNull(), (F.col("z") >= F.col("mean")).cast("double"))), F.lit(1.0))
    return x.groupBy(*by, "mean").agg(p.alias("p"))


def null_best(null: DataFrame) -> DataFrame:
    """run, best: the largest of all configurations' means in each run, one that didn't trade counting as 0."""
    return null.groupBy("run").agg(F.max(F.coalesce("null_mean", F.lit(0.0))).alias("best"))


def max_statistic_p(real: DataFrame, best: DataFrame, by: list[str]) -> DataFrame:
    """p against the best of each run. A histogram of the runs is all that meets the real means. Runs that equal the real mean
    count: both are compared at 9 places, since equal means of sums taken in other orders differ in their last bits."""
    runs = best.agg(F.sort_array(F.collect_list(halves_up(F.col("best"), 9))).alias("bests"))
    share = F.size(F.filter("bests", lambda b: b >= halves_up(F.col("mean"), 9))) / F.size("bests")
    return real.join(F.broadcast(runs)).select(*by, "mean", F.when(F.col("mean").isNull(), 1.0).otherwise(F.coalesce(share, F.lit(1.0))).alias("p_max"))


def holm(ps: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """by, p, p_holm, reject (strictly below alpha). There is a row for each hypothesis."""
    w = Window.orderBy("p", *by)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    x = ps.withColumn("raw", (m - F.row_number().over(w) + 1) * F.col("p"))
    x = x.withColumn("p_holm", F.least(F.lit(1.0), F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("raw")
    return x.withColumn("reject", F.col("p_holm") < alpha)


def flip_null(trades: DataFrame, by: list[str], runs: int, seed: int) -> DataFrame:
    """by, run, null_mean: each run tosses one coin a day, shared by all configurations; trades has r, r_flip."""
    daily = trades.groupBy(*by, "day").agg(F.sum("r").alias("s"), F.sum("r_flip").alias("f"), F.count(F.lit(1)).alias("n"))
    coined = daily.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("coin", draw(F.lit(str(seed)), F.col("run"), F.col("day")) % 2)
    return coined.groupBy(*by, "run").agg((F.sum(F.when(F.col("coin") == 1, F.col("f")).otherwise(F.col("s"))) / F.sum("n")).alias("null_mean"))


def drawdown(trades: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Largest fall of the running sum from its peak so far, 0 at the start included; a group's trades are one window."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = trades.withColumn("__sum", F.sum(value).over(w))
    x = x.withColumn("__fall", F.greatest(F.max("__sum").over(w), F.lit(0.0)) - F.col("__sum"))
    return x.groupBy(*by).agg(F.max("__fall").alias("drawdown"), F.count(F.lit(1)).alias("trades"))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, told by MD5."""
    return rows.withColumn("__o", F.md5(F.concat_ws(":", F.lit(str(seed)), key))).orderBy("__o").limit(n).drop("__o")


def verdict(rows: DataFrame, alpha: float, least: int) -> DataFrame:
    """rows (mean, lower, p, p_holm, min_trades, min_mean over periods) with passes, weak and verdict PASS, WEAK or STOP."""
    ok = (F.col("p_holm") < alpha) & (F.col("lower") > 0) & (F.col("mean") > 0) & (F.col("min_trades") >= least) & (F.col("min_mean") > 0)
    weak = (F.col("mean") > 0) & (F.col("p") < 2 * alpha)
    x = rows.withColumn("passes", F.coalesce(ok, F.lit(False))).withColumn("weak", F.coalesce(weak, F.lit(False)))
    every = Window.partitionBy(F.lit(0))
    return x.withColumn("verdict", F.when(F.max("passes").over(every), "PASS").when(F.max("weak").over(every), "WEAK").otherwise("STOP"))
