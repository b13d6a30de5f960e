"""When a day may be traded: the time at which spreads are usual again, and the decision moments after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.config import Params
from quantloom.functions.time import DAY, minute_of_day
from quantloom.operators.bars import by_day, by_time


def resume_times(bars: DataFrame, p: Params) -> DataFrame:
    """series, day, resume (minute of the day), reason (0 by rule, 1 deadline, 2 no reference), ref.

    By rule: the close of the first bar whose spread, and those of the bars before it in the day, resume_bars in all, are
    at most resume_factor times the previous day's median between ref_from and flat.
    """
    of_day = minute_of_day(F.col("t"))
    medians = bars.groupBy("series", "day").agg(F.percentile(F.when((of_day >= p.ref_from) & (of_day < p.flat), F.col("spread")), 0.5).alias("usual"))
    refs = medians.withColumn("ref", F.lag("usual").over(by_time("day"))).drop("usual")
    x = bars.join(refs, ["series", "day"]).withColumn("ok", F.coalesce((F.col("spread") <= F.col("ref") * p.resume_factor).cast("int"), F.lit(0)))
    run = F.min("ok").over(by_day().rowsBetween(-(p.resume_bars - 1), 0))
    x = x.withColumn("hit", (run == 1) & (F.row_number().over(by_day()) >= p.resume_bars))
    met = F.min(F.when(F.col("hit"), F.col("tc") - F.col("day") * DAY))
    days = x.groupBy("series", "day").agg(met.alias("met"), F.first("ref").alias("ref"))
    reason = F.when(F.col("ref").isNull(), 2).when(F.coalesce(F.col("met") <= p.deadline, F.lit(False)), 0).otherwise(1)
    return days.select("series", "day", F.when(reason == 0, F.col("met")).otherwise(p.deadline).cast("long").alias("resume"), reason.alias("reason"), "ref")


def decision_moments(signal: DataFrame, resume: DataFrame, excluded: DataFrame, p: Params) -> DataFrame:
    """Signal bars that close from the day's resume time to before flat, on days that aren't excluded (series, day)."""
    x = signal.join(resume.select("series", "day", "resume"), ["series", "day"]).join(excluded.select("series", "day"), ["series", "day"], "left_anti")
    close = F.col("tc") - F.col("day") * DAY
    return x.where((close >= F.col("resume")) & (close < p.flat))
