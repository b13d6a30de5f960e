"""Queries on outcomes of decision moments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.config import DEFAULT as P
from quantloom.operators import outcomes
from quantloom.plans.bars import AUDIT, BARS, MOMENTS, RESUME, SIGNAL_ATR, decided, q, r, rounded
from quantloom.sources.tables import base

CTES = (BARS, SIGNAL_ATR, RESUME, AUDIT, MOMENTS)

TARGETS = """
lasts AS (SELECT series, day, max(tc) AS last_tc FROM base GROUP BY ALL),
hz AS (SELECT m.*, last_tc, hz, CASE WHEN hz < 0 THEN day * 1440 + 1290 ELSE tc + hz END AS until FROM moments m JOIN lasts USING (series, day), (VALUES (60), (120), (240), (-1)) x(hz)),
tgt AS (
  SELECT h.series, h.day, h.t, h.tc, hz AS horizon, b.tc AS xtc, b.c - h.c AS mv, h.spread AS s0, b.spread AS s1, 2 * 0.000016::DOUBLE * h.c AS com,
    CASE WHEN hz < 0 THEN b.tc > h.tc ELSE until <= h.day * 1440 + 1290 AND last_tc >= until END AS valid
  FROM hz h ASOF LEFT JOIN base b ON b.series = h.series AND b.tc <= h.until),
targets AS (SELECT series, day, t, tc, horizon, CASE WHEN valid THEN mv - s0 - com END AS long, CASE WHEN valid THEN -mv - s1 - com END AS short, CASE WHEN valid THEN xtc END AS exit_tc FROM tgt)"""

PATHS = """
sides AS (SELECT series, day, t, tc, c, spread, atr, side, CASE WHEN side = 1 THEN c + spread ELSE c END AS e FROM moments, (VALUES (1), (-1)) x(side) WHERE atr > 0),
path AS (
  SELECT s.series, s.day, s.t, s.tc AS tc0, side, atr AS a, 2 * 0.000016::DOUBLE * s.c / atr AS com, s.spread / atr AS spa, b.tc,
    CASE WHEN side = 1 THEN (b.h - e) / atr ELSE (e - b.l - b.spread) / atr END AS fav, CASE WHEN side = 1 THEN (b.l - e) / atr ELSE (e - b.h - b.spread) / atr END AS adv,
    CASE WHEN side = 1 THEN (b.o - e) / atr ELSE (e - b.o - b.spread) / atr END AS op, CASE WHEN side = 1 THEN (b.c - e) / atr ELSE (e - b.c - b.spread) / atr END AS cl
  FROM sides s JOIN base b ON b.series = s.series AND b.day = s.day AND b.t >= s.tc AND b.tc <= s.day * 1440 + 1290),
run AS (SELECT *, max(cl) OVER w AS pcl, max(fav) OVER w AS pfav FROM path WINDOW w AS (PARTITION BY series, t, side ORDER BY tc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT *, CASE kind WHEN 'trail' THEN greatest(-s, CASE WHEN pcl IS NULL THEN -s ELSE greatest(-spa, pcl) - s END) WHEN 'be' THEN CASE WHEN pfav >= s THEN greatest(-s, com) ELSE -s END WHEN 'time' THEN -1e9 ELSE -s END AS stop
  FROM run, (VALUES {grid}) x(exit, kind, s, k)),
hit AS (SELECT *, adv <= stop AS stopped, CASE WHEN kind = 'sltp' THEN fav >= k * s ELSE false END AS reached FROM lev),
firsts AS (
  SELECT series, day, t, tc0, side, exit, any_value(kind) AS kind, any_value(s) AS s, any_value(k) AS k, any_value(a) AS a, any_value(com) AS com, any_value(spa) AS spa,
    coalesce(min(tc) FILTER (WHERE stopped OR reached), max(tc)) AS exit_tc FROM hit GROUP BY ALL),
exits AS (
  SELECT f.series, f.day, f.t, f.tc0 AS tc, f.side, f.exit, CASE WHEN stopped THEN 1 WHEN reached THEN 2 ELSE 3 END AS reason, f.exit_tc, stopped AND reached AS conflict,
    (CASE WHEN stopped THEN least(stop, op) WHEN reached THEN greatest(f.k * f.s, op) ELSE cl END - f.com) * f.a AS net,
    (CASE WHEN stopped THEN least(stop, op) WHEN reached THEN greatest(f.k * f.s, op) ELSE cl END - f.com) / (f.s + f.spa + f.com) AS r
  FROM firsts f JOIN hit h ON h.series = f.series AND h.t = f.t AND h.side = f.side AND h.exit = f.exit AND h.tc = f.exit_tc)"""


def _paths(*kinds: str) -> str:
    return PATHS.format(grid=", ".join(f"('{n}', '{kind}', {s}::DOUBLE, {'NULL' if k is None else k}::DOUBLE)" for n, kind, s, k in outcomes.exit_grid(P) if kind in kinds))


def exits_of(*kinds: str):
    return lambda s, d: rounded(outcomes.exits(base(s, d), decided(s, d), P, kinds))


EXIT_SQL = f"SELECT series, day, t, tc, side::BIGINT AS side, exit, reason::BIGINT AS reason, exit_tc, conflict, {r('net', 'r')} FROM exits"
CHAIN = """
tr1 AS (SELECT *, row_number() OVER (PARTITION BY exit, side, series, day ORDER BY tc) AS n FROM exits),
nxt AS MATERIALIZED (SELECT a.*, b.tc AS next_tc FROM tr1 a ASOF LEFT JOIN tr1 b ON b.exit = a.exit AND b.side = a.side AND b.series = a.series AND b.day = a.day AND b.tc >= a.exit_tc),
one AS (SELECT * FROM nxt WHERE n = 1 UNION ALL SELECT x.* FROM one o JOIN nxt x ON x.exit = o.exit AND x.side = o.side AND x.series = o.series AND x.day = o.day AND x.tc = o.next_tc)"""


def singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position at a time for each exit, side, series and day."""
    return outcomes.one_at_a_time(outcomes.exits(base(spark, sf_dir), decided(spark, sf_dir), P), ["exit", "side", "series", "day"])


def baseline_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = singles(spark, sf_dir)
    wins, losses = F.avg(F.when(F.col("r") > 0, F.col("r"))), F.avg(F.when(F.col("r") <= 0, F.col("r")))
    return rounded(x.groupBy("exit", "side").agg(F.count(F.lit(1)).alias("trades"), F.countDistinct("day").alias("days"), F.avg("r").alias("mean_r"), wins.alias("avg_win"), losses.alias("avg_loss"), F.avg(F.col("conflict").cast("double")).alias("conflict_share"), F.count_if(F.col("reason") == 1).alias("stops"), F.count_if(F.col("reason") == 2).alias("targets"), F.count_if(F.col("reason") == 3).alias("ends")))


def top_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the best ten exits and sides by mean result; those without a trade come last."""
    return baseline_exits(spark, sf_dir).select("exit", "side", "trades", "mean_r").orderBy(F.coalesce("mean_r", F.lit(-9.0)).desc(), "exit", "side").limit(10)


QUERIES = {
    "targets_net": lambda s, d: rounded(outcomes.targets(base(s, d), decided(s, d), P)),
    "baseline_b0": lambda s, d: rounded(outcomes.baseline(outcomes.targets(base(s, d), decided(s, d), P), ["horizon"])),
    "exit_sltp": exits_of("sltp"),
    "exit_sl": exits_of("sl"),
    "exit_trail": exits_of("trail"),
    "exit_be": exits_of("be"),
    "exit_time": exits_of("time"),
    "one_position": lambda s, d: rounded(singles(s, d)),
    "baseline_exits": baseline_exits,
    "top_exits": top_exits,
}
ALL_KINDS = ("sltp", "sl", "trail", "be", "time")
BASELINE_EXITS = """SELECT exit, side::BIGINT AS side, count(*) AS trades, count(DISTINCT day) AS days, round(avg(r), 6) + 0.0 AS mean_r, round(avg(r) FILTER (WHERE r > 0), 6) + 0.0 AS avg_win, round(avg(r) FILTER (WHERE r <= 0), 6) + 0.0 AS avg_loss,
  round(avg(conflict::INT), 6) + 0.0 AS conflict_share, count(*) FILTER (WHERE reason = 1) AS stops, count(*) FILTER (WHERE reason = 2) AS targets, count(*) FILTER (WHERE reason = 3) AS ends FROM one GROUP BY ALL"""
ORACLE_SQL = {
    "targets_net": q(f"SELECT series, day, t, tc, horizon::BIGINT AS horizon, {r('long', 'short')}, exit_tc FROM targets", *CTES, TARGETS),
    "baseline_b0": q("SELECT horizon::BIGINT AS horizon, side, count(*) AS trades, count(DISTINCT day) AS days, round(avg(net), 6) + 0.0 AS mean_net, round(avg((net > 0)::INT), 6) + 0.0 AS win_rate FROM (SELECT horizon, day, 'long' AS side, long AS net FROM targets UNION ALL SELECT horizon, day, 'short', short FROM targets) WHERE net IS NOT NULL GROUP BY ALL", *CTES, TARGETS),
    **{f"exit_{k}": q(EXIT_SQL, *CTES, _paths(k)) for k in ALL_KINDS},
    "one_position": q(EXIT_SQL.replace("FROM exits", "FROM one"), *CTES, _paths(*ALL_KINDS), CHAIN),
    "baseline_exits": q(BASELINE_EXITS, *CTES, _paths(*ALL_KINDS), CHAIN),
    "top_exits": q("SELECT exit, side::BIGINT AS side, count(*) AS trades, round(avg(r), 6) + 0.0 AS mean_r FROM one GROUP BY ALL ORDER BY coalesce(round(avg(r), 6), -9) DESC, exit, side LIMIT 10", *CTES, _paths(*ALL_KINDS), CHAIN),
}
