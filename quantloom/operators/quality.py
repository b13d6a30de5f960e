"""Audit of bars: gaps, spreads, duplicates, quarantined days, and violations of a bar's own rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.bars import by_day, by_time


def deduplicated(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def duplicates(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Rows in groups of equal keys, and rows that deduplication drops."""
    sizes = rows.groupBy(*by, *[k for k in key if k not in by]).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*by).agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup_rows"), F.sum(F.col("n") - 1).alias("dropped"))


def audit_days(bars: DataFrame, length: int, report: int, quarantine: int) -> DataFrame:
    """For each day: bars, first and last, gaps of report missing bars or more, the largest, odd spreads, quarantine."""
    missing = F.coalesce((F.col("t") - F.lag("t").over(by_day())) / length - 1, F.lit(0.0)).cast("long")
    x = bars.withColumn("gap", missing).groupBy("series", "day").agg(
        F.count(F.lit(1)).alias("bars"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_if(F.col("gap") >= report).alias("gaps"), F.max("gap").alias("max_gap"),
        F.count_if(F.col("spread") == 0).alias("zero_spread"), F.count_if(F.col("spread") < 0).alias("negative_spread"),
    )
    return x.withColumn("quarantined", F.col("max_gap") > quarantine)


def gaps(bars: DataFrame, length: int, report: int, quarantine: int) -> DataFrame:
    """A row for each gap of report missing bars or more within a day: after_t, the last bar before it, missing, and the reason
    if it quarantines the day."""
    before = F.lag("t").over(by_day())
    x = bars.withColumn("after_t", before).withColumn("missing", F.coalesce((F.col("t") - before) / length - 1, F.lit(0.0)).cast("long"))
    return x.where(F.col("missing") >= report).select("series", "day", "after_t", "missing", F.when(F.col("missing") > quarantine, F.lit(f"gap over {quarantine}")).alias("reason"))


def sessions(bars: DataFrame) -> DataFrame:
    """Whether a day's first bar is later, and its last one earlier, than is most common in its series."""
    x = bars.groupBy("series", "day").agg(F.min("t").alias("a"), F.max("t").alias("b")).withColumn("a", F.pmod("a", F.lit(1440))).withColumn("b", F.pmod("b", F.lit(1440)))
    usual = modal(x, ["series"], "a", "start").join(modal(x, ["series"], "b", "stop"), "series")
    return x.join(usual, "series").select("series", "day", (F.col("a") > F.col("start")).alias("late_start"), (F.col("b") < F.col("stop")).alias("early_close"))


def audit_periods(audit: DataFrame, period) -> DataFrame:
    """Sums of the audit for each series and period, for each series, and over all."""
    return audit.withColumn("period", period).rollup("series", "period").agg(
        F.count(F.lit(1)).alias("days"), F.sum("bars").alias("bars"), F.sum("gaps").alias("gaps"), F.max("max_gap").alias("max_gap"), F.sum(F.col("quarantined").cast("long")).alias("quarantined"),
    )


def modal(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The most common value of each group; of equally common ones the smallest."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(name), F.max("n").alias(f"{name}_n"))


def violations(bars: DataFrame) -> DataFrame:
    """A row for each rule that a bar breaks."""
    bars = bars.withColumn("__late", F.col("t") <= F.lag("t").over(by_time("seq")))
    checks = {"not_increasing": F.col("__late"), "high": F.col("h") < F.greatest("o", "c"), "low": F.col("l") > F.least("o", "c"), "spread": F.col("spread") < 0}
    found = F.filter(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in checks.items())), lambda x: x.isNotNull())
    return bars.withColumn("violation", F.explode(found)).drop("__late")
