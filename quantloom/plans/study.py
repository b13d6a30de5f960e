"""Queries on studies of mined and frozen rules, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.config import DEFAULT as P
from quantloom.functions import rules as rule_table
from quantloom.functions.time import iso, month_start, r6, year_of, year_start
from quantloom.operators import features, outcomes, quality, resample, study, walk
from quantloom.plans.bars import ALL_F, AUDIT, BARS, F_PREVDAY, MOMENTS, RESUME, SIGNAL_ATR, audit, decided, q, r, rounded
from quantloom.plans.mining import DATA, DATASET, FIRES, FOLDS, N, RULES, TRADED, WALK, dataset, walk_inputs
from quantloom.plans.outcomes import CTES, TARGETS, _paths
from quantloom.sources.files import freeze_rules, read_rules
from quantloom.sources.tables import base, base_and_signal

#: Days of a period, limits of the range rule, fewest trades of a fold.
PERIOD, LOW, HIGH, LEAST = 14, 0.8, 1.2, 5
FAMILIES = ("M1", "M3")


def span() -> Column:
    return F.floor((F.col("day") + 3) / PERIOD).cast("long")


# ---- exits as targets


def exit_study(spark: SparkSession, sf_dir: str, runs: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """All trades, those of one position at a time, exits' results, rows and folds."""
    rows, _, plan = walk_inputs(spark, sf_dir)
    results = resample.written(outcomes.exits(base(spark, sf_dir), decided(spark, sf_dir), P, ("sltp",)), "study_exits")
    targets = resample.written(study.exit_targets(results), "study_targets")
    train = resample.written(walk.training(rows, targets, plan, runs, P.seed), "study_train")
    cuts = walk.edges(train, N, P)
    rules = resample.written(walk.rules(train, cuts, N, P, FAMILIES), "study_rules")
    every = resample.written(study.exit_trades(walk.traded(rows, targets, plan, rules, cuts, N, FAMILIES), results), "study_trades")
    return every, resample.written(study.single(every), "study_single"), results, rows, plan


def exit_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of rules mined on exits' results, one position at a time."""
    x = exit_study(spark, sf_dir, 0)[1]
    return rounded(x.select("fold", "family", "horizon", "series", "day", "t", "tc", "dir", "exit_tc", "reason", "conflict", "usd", "r"))


def exit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, trades, results, rows, plan = exit_study(spark, sf_dir, P.null_runs)
    means = resample.written(walk.means(trades, results.select(F.col("exit").alias("horizon")), spark.range(-1, P.null_runs).withColumnRenamed("id", "run"), FAMILIES, "r"), "study_means")
    weights = resample.boot_weights(spark, trades.where("run = -1"), P.reps, P.seed)
    best = resample.written(study.base_rate(results, plan, rows), "study_base")
    table = resample.written(study.exit_table(trades, every, means.withColumnRenamed("mean_net", "null_mean"), best, weights, P.alpha), "study_table")
    folds = plan.where("role = 'test'").select("fold").distinct().count()
    return rounded(study.exit_verdict(table, folds, LEAST))


# ---- frozen rules


def frozen_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hypotheses on all moments: frozen rules, written as a file and read back, and a rule of the previous day's range."""
    freeze_rules(rule_table.table(spark, RULES).withColumn("family", F.lit("fixed")), path := resample.new_path(spark, "frozen") + "/rules.json")
    rows = features_rows(spark, sf_dir)
    ends = resample.written(outcomes.targets(base(spark, sf_dir), decided(spark, sf_dir), P).where("horizon = -1").select("series", "t", "long", "short"), "study_ends")
    one = study.frozen_pool(rows, ends, read_rules(spark, path), N)
    moments = decided(spark, sf_dir).select("series", "day", "t").join(features.previous_day(base_and_signal(spark, sf_dir)[1], P), ["series", "day"], "left")
    two = study.threshold_pool(moments.withColumn("pd_range_rel", r6(F.col("pd_range_rel"))), ends, "pd_range_rel", LOW, HIGH)
    return resample.written(one.withColumn("hypothesis", F.lit("rules")).unionByName(two.withColumn("hypothesis", F.lit("range"))), "study_pool")


def features_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_inputs(spark, sf_dir)[0]


def frozen_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = frozen_pool(spark, sf_dir)
    weights = resample.boot_weights(spark, study.traded(pool), P.reps, P.seed)
    return rounded(study.frozen_verdict(pool, weights, span(), P.alpha))


def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_table.table(spark, RULES).select("rule_id", F.col("direction").cast("long").alias("direction"), rule_table.described(F.col("conds")).alias("text"))


def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the 25 rules with most hits."""
    return rule_table.top_hits(rule_table.hits(dataset(spark, sf_dir), RULES))


# ---- calendar and audit


def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day with bars: its year, the first days of its year and month, and its first bar's time as text."""
    x = base(spark, sf_dir).groupBy("series", "day").agg(F.min("t").alias("first_t"))
    return x.select("series", "day", year_of(F.col("day")).alias("year"), year_start(year_of(F.col("day")).cast("int")).alias("year_day"), month_start(F.col("day")).alias("month_day"), iso(F.col("first_t")).alias("first_bar"))


QUERIES = {
    "exit_walk": exit_walk,
    "exit_table": exit_table,
    "frozen_trades": lambda s, d: rounded(frozen_pool(s, d)),
    "frozen_eval": lambda s, d: rounded(study.evaluated(frozen_pool(s, d), span())),
    "frozen_verdict": frozen_verdict,
    "direction_days": lambda s, d: rounded(study.direction_days(study.traded(frozen_pool(s, d).where("hypothesis = 'rules'")), span())),
    "rule_texts": rule_texts,
    "top_rules": top_rules,
    "calendar_days": calendar_days,
    "audit_years": lambda s, d: quality.audit_periods(audit(s, d), year_of(F.col("day"))),
    "audit_gaps": lambda s, d: quality.gaps(base(s, d), P.base, P.gap_report, P.gap_quarantine),
    "audit_sessions": lambda s, d: quality.sessions(base(s, d)),
}


def exits_sql(sql: str) -> str:
    return sql.replace("targets", "xt").replace("horizon::BIGINT", "horizon")


def draws_sql(name: str, src: str) -> str:
    return f"""
{name}d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM {src})),
{name} AS (SELECT rep, day, count(*) AS w FROM (SELECT rep, ('0x' || substr(md5(concat_ws(':', '7', rep, d)), 1, 8))::BIGINT % (SELECT count(*) FROM {name}d) AS i FROM range({P.reps}) a(rep), range(1000) b(d) WHERE d < (SELECT count(*) FROM {name}d)) JOIN {name}d USING (i) GROUP BY ALL)"""


XT = "xt AS MATERIALIZED (SELECT series, day, t, exit AS horizon, max(r) FILTER (WHERE side = 1) AS long, max(r) FILTER (WHERE side = -1) AS short FROM exits GROUP BY ALL)"
ONE_BY_ONE = """
{name}1 AS (SELECT *, row_number() OVER (PARTITION BY {key}, series, day ORDER BY tc) AS n FROM {src}),
{name}2 AS MATERIALIZED (SELECT a.*, b.tc AS next_tc FROM {name}1 a ASOF LEFT JOIN {name}1 b ON {same} AND b.series = a.series AND b.day = a.day AND b.tc >= a.exit_tc),
{name} AS (SELECT * FROM {name}2 WHERE n = 1 UNION ALL SELECT b.* FROM {name} a JOIN {name}2 b ON {same} AND b.series = a.series AND b.day = a.day AND b.tc = a.next_tc)"""


def one_by_one(name: str, src: str, *key: str) -> str:
    return ONE_BY_ONE.format(name=name, src=src, key=", ".join(key), same=" AND ".join(f"a.{k} = b.{k}" for k in key))


EXIT_TRADES = (
    "xall AS MATERIALIZED (SELECT w.* EXCLUDE (net), e.tc, e.exit_tc, e.reason, e.conflict, e.net AS usd, e.r FROM wtr w JOIN exits e ON e.series = w.series AND e.t = w.t AND e.exit = w.horizon AND e.side = w.dir WHERE w.family <> 'M2'),"
    + one_by_one("xone", "xall", "run", "family", "horizon")
)
EXIT_TABLE = f"""
xr AS (SELECT * FROM xone WHERE run = -1),{draws_sql('xw', 'xr')},
xs AS (SELECT family, horizon, count(*) AS trades, count(DISTINCT day) AS days, avg(r) AS mean_r, avg((r > 0)::INT) AS win_rate, avg(r) FILTER (WHERE r > 0) AS avg_win, avg(r) FILTER (WHERE r <= 0) AS avg_loss, avg(usd) AS mean_usd, avg(conflict::INT) AS conflict_share,
  count(*) FILTER (WHERE reason = 1) AS stops, count(*) FILTER (WHERE reason = 2) AS targets, count(*) FILTER (WHERE reason = 3) AS ends FROM xr GROUP BY ALL),
xb AS (SELECT family, horizon, quantile_cont(m, 0.05) AS lower FROM (SELECT family, horizon, rep, sum(s * w) / sum(n * w) AS m FROM (SELECT family, horizon, day, sum(r) AS s, count(*) AS n FROM xr GROUP BY ALL) JOIN xw USING (day) GROUP BY ALL) GROUP BY ALL),
xg AS (SELECT a.run::BIGINT AS run, family, horizon, m FROM range({P.null_runs}) a(run) CROSS JOIN (SELECT DISTINCT exit AS horizon FROM exits) CROSS JOIN (VALUES ('M1'), ('M3')) f(family) LEFT JOIN (SELECT run, family, horizon, avg(r) AS m FROM xone GROUP BY ALL) z USING (run, family, horizon)),
xm AS (SELECT run, max(coalesce(m, 0)) AS best FROM xg GROUP BY ALL),
xp AS (SELECT family, horizon, avg((best >= mean_r)::INT) AS p_max FROM xs, xm GROUP BY ALL),
xc AS (SELECT family, horizon, tc, series, sum(r) OVER (PARTITION BY family, horizon ORDER BY tc, series ROWS UNBOUNDED PRECEDING) AS s FROM xr),
xd AS (SELECT family, horizon, max(greatest(top, 0) - s) AS drawdown FROM (SELECT *, max(s) OVER (PARTITION BY family, horizon ORDER BY tc, series ROWS UNBOUNDED PRECEDING) AS top FROM xc) GROUP BY ALL),
xa AS (SELECT family, horizon, count(*) AS all_trades, avg(r) AS all_mean_r FROM xall WHERE run = -1 GROUP BY ALL),
bt AS (SELECT e.exit AS horizon, e.side, f.fold, e.series, e.day, e.t, e.tc, e.exit_tc, e.r FROM exits e JOIN fall g ON g.series = e.series AND g.t = e.t JOIN folds f ON f.day = e.day AND f.role = 'test' WHERE e.r IS NOT NULL),{one_by_one('bone', 'bt', 'horizon', 'side')},
bb AS (SELECT horizon, fold, max(m) AS best FROM (SELECT horizon, side, fold, avg(r) AS m FROM bone GROUP BY ALL) GROUP BY ALL),
xf AS (SELECT family, horizon, count(*) AS folds, min(n) AS min_trades, min(m) AS min_mean, min(m - best) AS min_over_base FROM (SELECT family, horizon, fold, count(*) AS n, avg(r) AS m FROM xr GROUP BY ALL) LEFT JOIN bb USING (horizon, fold) GROUP BY ALL),
xn AS (SELECT family, horizon, avg(m) AS null_mean FROM xg GROUP BY ALL),
xt2 AS (SELECT * FROM xs LEFT JOIN xb USING (family, horizon) LEFT JOIN xp USING (family, horizon) LEFT JOIN xd USING (family, horizon) LEFT JOIN xa USING (family, horizon) LEFT JOIN xf USING (family, horizon) LEFT JOIN xn USING (family, horizon)),
xv AS (SELECT *, folds = (SELECT count(DISTINCT fold) FROM folds WHERE role = 'test') AND min_mean > 0 AS gains FROM xt2),
xz AS (SELECT * EXCLUDE (gains), coalesce(gains AND lower > 0 AND p_max < 0.05 AND min_over_base > 0 AND min_trades >= {LEAST}, false) AS passes, coalesce(gains AND p_max < 0.1, false) AND NOT coalesce(gains AND lower > 0 AND p_max < 0.05 AND min_over_base > 0 AND min_trades >= {LEAST}, false) AS weak FROM xv)"""
XS = ("mean_r", "win_rate", "avg_win", "avg_loss", "mean_usd", "conflict_share", "lower", "p_max", "drawdown", "all_mean_r", "min_mean", "min_over_base", "null_mean")
POOL = f"""
hp AS (SELECT 'rules' AS hypothesis, series, day, t, CASE WHEN (l1 OR l2) AND NOT (s1 OR s2) THEN 1 WHEN (s1 OR s2) AND NOT (l1 OR l2) THEN -1 ELSE 0 END::BIGINT AS dir, g.long, g.short FROM (SELECT * FROM fires) JOIN (SELECT series, t, long, short FROM targets WHERE horizon = -1 AND long IS NOT NULL AND short IS NOT NULL) g USING (series, t)
  UNION ALL SELECT 'range', m.series, m.day, m.t, CASE WHEN x <= {LOW} THEN 0 WHEN x <= {HIGH} THEN 1 ELSE -1 END, g.long, g.short FROM (SELECT series, day, min(t) AS t FROM moments GROUP BY ALL) m JOIN (SELECT series, day, round(pd_range_rel, 6) + 0.0 AS x FROM f_prevday) p ON p.series = m.series AND p.day = m.day
    JOIN (SELECT series, t, long, short FROM targets WHERE horizon = -1 AND long IS NOT NULL AND short IS NOT NULL) g ON g.series = m.series AND g.t = m.t WHERE x IS NOT NULL),
ht AS (SELECT *, CASE WHEN dir > 0 THEN long ELSE short END AS r, (day + 3) // {PERIOD} AS period FROM hp WHERE dir <> 0),
he AS (SELECT hypothesis, (day + 3) // {PERIOD} AS period, count(*) FILTER (WHERE dir <> 0) AS trades, count(DISTINCT CASE WHEN dir <> 0 THEN day END) AS days, avg(CASE WHEN dir > 0 THEN long WHEN dir < 0 THEN short END) AS mean,
  avg((CASE WHEN dir > 0 THEN long ELSE short END > 0)::INT) FILTER (WHERE dir <> 0) AS win_rate, avg((dir > 0)::INT) FILTER (WHERE dir <> 0) AS long_share, count(*) AS eligible, avg(long) AS base_long, avg(short) AS base_short FROM hp GROUP BY ALL)"""
FROZEN = f"""{draws_sql('hw', 'ht').lstrip()},
hd AS (SELECT hypothesis, day, sum(r) AS s, count(*) AS n FROM ht GROUP BY ALL),
hb AS (SELECT * FROM (SELECT hypothesis, sum(s) / sum(n) AS mean FROM hd GROUP BY ALL) JOIN (SELECT hypothesis, quantile_cont(m, 0.05) AS lower, avg((m <= 0)::INT) AS p FROM (SELECT hypothesis, rep, sum(s * w) / sum(n * w) AS m FROM hd JOIN hw USING (day) GROUP BY ALL) GROUP BY ALL) USING (hypothesis)),
hc AS (SELECT hypothesis, bool_and(coalesce(trades > 0 AND mean > 0, false)) AS gains, bool_and(coalesce(trades > 0 AND mean > greatest(base_long, base_short), false)) AS beats_base, sum(trades)::BIGINT AS trades FROM he GROUP BY ALL),
hx AS (SELECT c.*, mean, lower, coalesce(p, 1.0) AS p FROM hc c LEFT JOIN hb USING (hypothesis)),
hh AS (SELECT * EXCLUDE (k, m), least(1.0, max((m - k + 1) * p) OVER (ORDER BY p, hypothesis)) AS p_holm FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, hypothesis) AS k FROM hx)),
hv AS (SELECT *, p_holm < 0.05 AS reject, coalesce(gains AND beats_base AND lower > 0 AND p_holm < 0.05, false) AS passes FROM hh)"""
_TEXTS = ", ".join(
    f"({json.dumps(x.rule_id)!s}, {x.side}, [" + ", ".join("{{'f': '{}', 'lo': {}::DOUBLE, 'hi': {}::DOUBLE, 'a': '{}', 'b': '{}'}}".format(i.feature, "NULL" if i.low is None else i.low, "NULL" if i.high is None else i.high, "[" if i.low_in else "(", "]" if i.high_in else ")") for i in x.within) + "])"
    for x in RULES
).replace('"', "'")
EXITS = (*CTES, *ALL_F, TARGETS, DATASET, FOLDS, _paths("sltp"), XT)
POOLED = (*DATA, DATASET, FIRES.format(src="fall"), POOL)
GAPS = "gapped AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY series, day ORDER BY t)) // 15 - 1, 0) AS gap, lag(t) OVER (PARTITION BY series, day ORDER BY t) AS before FROM base)"
ORACLE_SQL = {
    "exit_walk": q(f"SELECT fold, family, horizon, series, day, t, tc, dir::BIGINT AS dir, exit_tc, reason::BIGINT AS reason, conflict, {r('usd', 'r')} FROM xone WHERE run = -1", *EXITS, exits_sql(WALK), exits_sql(TRADED), EXIT_TRADES),
    "exit_table": q(f"SELECT family, horizon, trades, days, stops, targets, ends, all_trades, folds, min_trades, passes, weak, {r(*XS)}, CASE WHEN max(passes) OVER () THEN 'PASS' WHEN max(weak) OVER () THEN 'WEAK' ELSE 'STOP' END AS verdict FROM xz", *EXITS, exits_sql(WALK), exits_sql(TRADED), EXIT_TRADES, EXIT_TABLE),
    "frozen_trades": q(f"SELECT hypothesis, series, day, t, dir, {r('long', 'short')} FROM hp", *POOLED),
    "frozen_eval": q(f"SELECT hypothesis, period, trades, days, eligible, {r('mean', 'win_rate', 'long_share', 'base_long', 'base_short')} FROM he", *POOLED),
    "frozen_verdict": q(f"SELECT hypothesis, gains, beats_base, trades, reject, passes, {r('mean', 'lower', 'p', 'p_holm')}, CASE WHEN max(passes) OVER () THEN 'PASS' ELSE 'FAIL' END AS verdict FROM hv", *POOLED, FROZEN),
    "direction_days": q(f"SELECT period, trades, {r('long_share', 'mean', 'long_mean', 'short_mean')}, all_long, all_short, mixed, days FROM (SELECT period, count(*) AS trades, avg((dir = 1)::INT) AS long_share, avg(r) AS mean, avg(r) FILTER (WHERE dir = 1) AS long_mean, avg(r) FILTER (WHERE dir = -1) AS short_mean FROM ht WHERE hypothesis = 'rules' GROUP BY ALL) JOIN (SELECT period, count(*) FILTER (WHERE low = 1) AS all_long, count(*) FILTER (WHERE high = -1) AS all_short, count(*) FILTER (WHERE low <> high) AS mixed, count(*) AS days FROM (SELECT period, day, min(dir) AS low, max(dir) AS high FROM ht WHERE hypothesis = 'rules' GROUP BY ALL) GROUP BY ALL) USING (period)", *POOLED),
    "rule_texts": f"SELECT rule_id, direction::BIGINT AS direction, array_to_string([c.f || ' in ' || CASE WHEN c.lo IS NULL THEN '(-inf' ELSE c.a || printf('%.4f', c.lo) END || ', ' || CASE WHEN c.hi IS NULL THEN 'inf)' ELSE printf('%.4f', c.hi) || c.b END FOR c IN conds], ' and ') AS text FROM (VALUES {_TEXTS}) x(rule_id, direction, conds)",
    "top_rules": q("SELECT rule_id, count(*) AS hits FROM (SELECT *, CASE WHEN (l1 OR l2) AND NOT (s1 OR s2) THEN 1 WHEN (s1 OR s2) AND NOT (l1 OR l2) THEN -1 ELSE 0 END AS dir, unnest(['up60', 'low', 'down60', 'late']) AS rule_id, unnest([l1, l2, s1, s2]) AS lit FROM fires) WHERE dir <> 0 AND lit GROUP BY ALL ORDER BY hits DESC, rule_id LIMIT 25", *DATA, DATASET, FIRES.format(src="data")),
    "calendar_days": q("SELECT series, day, year(d) AS year, date_diff('day', DATE '1970-01-01', date_trunc('year', d)::DATE) AS year_day, date_diff('day', DATE '1970-01-01', date_trunc('month', d)::DATE) AS month_day, strftime(TIMESTAMP '1970-01-01' + to_minutes(first_t), '%Y-%m-%d %H:%M:%S') AS first_bar FROM (SELECT *, DATE '1970-01-01' + day::INT AS d FROM (SELECT series, day, min(t) AS first_t FROM base GROUP BY ALL))", BARS),
    "audit_years": q("SELECT series, year(DATE '1970-01-01' + day::INT) AS period, count(*) AS days, sum(bars)::BIGINT AS bars, sum(gaps)::BIGINT AS gaps, max(max_gap) AS max_gap, sum(quarantined::INT)::BIGINT AS quarantined FROM audit GROUP BY ROLLUP (series, year(DATE '1970-01-01' + day::INT))", BARS, AUDIT),
    "audit_gaps": q("SELECT series, day, before AS after_t, gap AS missing, CASE WHEN gap > 12 THEN 'gap over 12' END AS reason FROM gapped WHERE gap >= 1", BARS, GAPS),
    "audit_sessions": q("""SELECT series, day, first_t % 1440 > mode_start AS late_start, (last_tc - 15) % 1440 < mode_stop AS early_close FROM days JOIN
      (SELECT series, v AS mode_start FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, v) AS k FROM (SELECT series, first_t % 1440 AS v, count(*) AS n FROM days GROUP BY ALL)) WHERE k = 1) USING (series) JOIN
      (SELECT series, v AS mode_stop FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, v) AS k FROM (SELECT series, (last_tc - 15) % 1440 AS v, count(*) AS n FROM days GROUP BY ALL)) WHERE k = 1) USING (series)""", BARS),
}
