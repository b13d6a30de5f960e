"""Registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.config import DEFAULT
from quantloom.operators import moments, outcomes
from quantloom.operators.bars import atr, resample
from quantloom.plans import bars, events, mining, study, outcomes as outcome_plans
from quantloom.sources.tables import base

PARTS = (bars, outcome_plans, mining, events, study)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in PARTS for k, v in part.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean net result of always-long and always-short by horizon at all decision moments, on hourly bars."""
    p = replace(DEFAULT, base=60, resume_bars=2, resume_factor=3.0)
    b = base(spark, sf_dir, p)
    signal = atr(resample(b, p.signal), p.atr_period)
    none = b.where(F.lit(False)).select("series", "day")
    at = moments.decision_moments(signal, moments.resume_times(b, p), none, p)
    return bars.rounded(outcomes.baseline(outcomes.targets(b, at, p), ["horizon"]))
