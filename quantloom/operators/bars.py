"""Bars and what is read off them in order: resampling, as-of values, average true range, streaks, extremes.

A bar is a row of series, t (minute of its open), tc (of its close), day, o, h, l, c, tv, spread. Windows are partitioned
by series: a series has at most 1440 bars a day however many ticks it has, so a partition is bounded by the calendar, and
ticks themselves are only ever aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.time import day_of, floor_to, weekday_of


def by_time(order: str = "t"):
    return Window.partitionBy("series").orderBy(order)


def by_day(order: str = "t"):
    return Window.partitionBy("series", "day").orderBy(order)


def from_ticks(ticks: DataFrame, length: int, point: float) -> DataFrame:
    """Bars of a length from ticks of series, minute, ts, event_id, value, points; weekend bars are left out. Equal times go by event_id."""
    at = F.struct("ts", "event_id")
    x = ticks.withColumn("t", floor_to(F.col("minute"), length)).groupBy("series", "t").agg(
        F.min_by("value", at).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", at).alias("c"),
        F.count(F.lit(1)).alias("tv"), (F.max_by("points", at) * F.lit(point)).alias("spread"),
    )
    x = x.withColumn("tc", F.col("t") + length).withColumn("day", day_of(F.col("t")))
    return x.where(weekday_of(F.col("day")) < 5).select("series", "t", "tc", "day", "o", "h", "l", "c", "tv", "spread")


def resample(bars: DataFrame, length: int) -> DataFrame:
    """Longer bars, aligned to the clock, with the lowest and highest ask and the first and last member's open."""
    x = bars.withColumn("k", floor_to(F.col("t"), length)).groupBy("series", "day", "k").agg(
        F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("tv").alias("tv"), F.max_by("spread", "t").alias("spread"),
        F.min(F.col("l") + F.col("spread")).alias("ask_low"), F.max(F.col("h") + F.col("spread")).alias("ask_high"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )
    return x.withColumnRenamed("k", "t").withColumn("tc", F.col("t") + length)


def days(bars: DataFrame) -> DataFrame:
    """Trading days: those with a bar; day_row numbers them in each series."""
    x = bars.groupBy("series", "day").agg(
        F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("tv").alias("tv"), F.count(F.lit(1)).alias("bars"), F.min("t").alias("first_t"), F.max("tc").alias("last_tc"),
    )
    return x.withColumn("day_row", F.row_number().over(by_time("day")))


def asof(probes: DataFrame, values: DataFrame, at: str, when: str, take: list[str], by: tuple[str, ...] = ("series",)) -> DataFrame:
    """probes with the columns of the last row of values at or before each (null before the first).

    Both sides go through one window in time order, values before probes at equal times: a sort, and no pair is formed.
    """
    payload = F.struct(*(F.col(c) for c in take))
    v = values.select(*by, F.col(when).alias("__at"), F.lit(0).alias("__kind"), payload.alias("__value"), F.lit(None).cast(probes.select(F.struct("*").alias("p")).schema["p"].dataType).alias("__probe"))
    p = probes.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(values.select(payload.alias("p")).schema["p"].dataType).alias("__value"), F.struct("*").alias("__probe"))
    w = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = v.unionByName(p).withColumn("__last", F.last("__value", ignorenulls=True).over(w)).where("__kind = 1")
    return both.select("__probe.*", *(F.col(f"__last.{c}").alias(c) for c in take))


def asof_back(value: str, minutes: int) -> Column:
    """The value of the last bar that closed minutes or more before each bar's close; days are crossed."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("series").orderBy("tc").rangeBetween(Window.unboundedPreceding, -minutes))


#: Rows over which the weights of a running average are carried exactly; older ones count for less than a double shows.
ATR_BLOCK = 4096


def atr(bars: DataFrame, period: int, order: str = "t", name: str = "atr") -> DataFrame:
    """bars with Wilder's average true range: the mean of the first ranges, then a share of each new one; null before that.

    The recursion is a weighted sum. It is taken by blocks of rows, with the last value of the block before carried over.
    """
    w = by_time(order)
    prev = F.lag("c").over(w)
    x = bars.withColumn("__tr", F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - prev), F.abs(F.col("l") - prev))).withColumn("__i", F.row_number().over(w) - 1)
    seed = F.avg("__tr").over(w.rowsBetween(-(period - 1), 0))
    x = x.withColumn("__x", F.when(F.col("__i") < period - 1, 0.0).when(F.col("__i") == period - 1, seed).otherwise(F.col("__tr") / period))
    q = 1 - 1 / period
    x = x.withColumn("__m", F.col("__i") % ATR_BLOCK).withColumn("__b", F.floor(F.col("__i") / ATR_BLOCK))
    own = Window.partitionBy("series", "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__loc", F.pow(F.lit(q), F.col("__m")) * F.sum(F.col("__x") * F.pow(F.lit(q), -F.col("__m"))).over(own))
    last = F.max(F.when(F.col("__m") == ATR_BLOCK - 1, F.struct("__b", "__loc"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = F.coalesce(F.when(last["__b"] == F.col("__b") - 1, last["__loc"]), F.lit(0.0)) * F.pow(F.lit(q), F.col("__m") + 1)
    x = x.withColumn(name, F.when(F.col("__i") >= period - 1, F.col("__loc") + carried))
    return x.drop("__tr", "__i", "__x", "__m", "__b", "__loc")


def streak(bars: DataFrame, name: str = "consec") -> DataFrame:
    """Signed length of the run of closes that move the same way; 0 for a close that doesn't move."""
    w = by_time()
    x = bars.withColumn("__s", F.coalesce(F.signum(F.col("c") - F.lag("c").over(w)), F.lit(0.0)).cast("int"))
    x = x.withColumn("__island", F.sum(F.when((F.col("__s") != F.coalesce(F.lag("__s").over(w), F.lit(9))) | (F.col("__s") == 0), 1).otherwise(0)).over(w))
    run = F.row_number().over(Window.partitionBy("series", "__island").orderBy("t"))
    return x.withColumn(name, (F.col("__s") * run).cast("long")).drop("__s", "__island")


def since_extremes(bars: DataFrame) -> DataFrame:
    """Bars since the day's high and low so far; equal extremes count from the latest."""
    w = by_day().rowsBetween(Window.unboundedPreceding, 0)
    x = bars.withColumn("__n", F.row_number().over(by_day()))
    x = x.withColumn("__hi", F.max("h").over(w)).withColumn("__lo", F.min("l").over(w))
    x = x.withColumn("bars_since_high", F.col("__n") - F.max(F.when(F.col("h") == F.col("__hi"), F.col("__n"))).over(w))
    x = x.withColumn("bars_since_low", F.col("__n") - F.max(F.when(F.col("l") == F.col("__lo"), F.col("__n"))).over(w))
    return x.drop("__n", "__hi", "__lo")


def same_slot(bars: DataFrame, value: str, length: int, history: int, least: int, how: str, name: str) -> DataFrame:
    """bars with the mean or median of a value at the same slot of the day over the days before.

    Slots without a value take the last one of their day. Fewer than least values give null.
    """
    slots = 1440 // length
    own = bars.select("series", "day", F.floor(F.pmod("t", F.lit(1440)) / length).cast("int").alias("slot"), F.col(value).alias("v"))
    grid = bars.select("series", "day").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    filled = grid.join(own, ["series", "day", "slot"], "left").withColumn("v", F.last("v", ignorenulls=True).over(Window.partitionBy("series", "day").orderBy("slot")))
    w = Window.partitionBy("series", "slot").orderBy("day").rowsBetween(-history, -1)
    stat = F.avg("v") if how == "mean" else F.percentile("v", F.lit(0.5))
    known = filled.select("series", "day", "slot", F.when(F.count("v").over(w) >= least, stat.over(w)).alias(name))
    return bars.withColumn("slot", F.floor(F.pmod("t", F.lit(1440)) / length).cast("int")).join(known, ["series", "day", "slot"]).drop("slot")
