"""Ticks and bars from the driver's events table: one series for each event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.config import DEFAULT, Params
from quantloom.functions.time import minute_of
from quantloom.operators.bars import from_ticks, resample


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, minute, ts, event_id, value, points: the k in props is a tick's spread."""
    x = spark.read.parquet(f"{sf_dir}/events.parquet")
    return x.select(F.col("event_type").alias("series"), minute_of(F.col("ts")).alias("minute"), "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("points"))


def base(spark: SparkSession, sf_dir: str, p: Params = DEFAULT) -> DataFrame:
    return from_ticks(ticks(spark, sf_dir), p.base, p.point)


def base_and_signal(spark: SparkSession, sf_dir: str, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    b = base(spark, sf_dir, p)
    return b, resample(b, p.signal)
