"""Queries on level events, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.config import DEFAULT as P
from quantloom.operators import events, moments
from quantloom.operators.bars import resample
from quantloom.operators.resample import boot_weights, flip_null, written
from quantloom.plans.bars import ATR, AUDIT, BARS, RESUME, audit, q, r, rounded
from quantloom.sources.tables import base

#: Days of a period in the tables of results, and fewest trades in each: the driver's tables have a month.
PERIOD, LEAST = 14, 5


def weeks() -> Column:
    return F.floor((F.col("day") + 3) / PERIOD).cast("long")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants' events on signal bars of all lengths, written once, numbered."""
    b = written(base(spark, sf_dir), "level_bars")
    ctx = written(events.context(b, moments.resume_times(b, P), audit(spark, sf_dir).where("quarantined"), P), "level_days")
    parts = [events.events(b, resample(b, n), ctx, P, n) for n in P.level_bars]
    return written(reduce(DataFrame.unionByName, parts).withColumn("eid", F.monotonically_increasing_id()), "level_events")


def family(prefix: str):
    shown = ("series", "day", "t", "tc", "bars", "variant", "approach", "level", "a0", "dir", "entry", "flip", "entry_tc", "fill_t", "struct", "busy", "rearm")
    return lambda s, d: rounded(found(s, d).where(F.regexp_extract("variant", "^[A-Z0-9]+", 0) == prefix).select(*shown))


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    ctx = events.context(b, moments.resume_times(b, P), audit(spark, sf_dir).where("quarantined"), P)
    parts = [events.marked(resample(b, n), ctx, P).select("series", "day", "t", F.lit(n).alias("bars"), "n", "level", "a0", "d", "side") for n in P.level_bars]
    return reduce(DataFrame.unionByName, parts)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of all configurations: lengths of bars by variants by stops by targets."""
    x = found(spark, sf_dir)
    results = written(events.simulated(x, base(spark, sf_dir), P), "level_results")
    return written(events.accepted(x, results, P), "level_trades")


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trades(spark, sf_dir)
    null = flip_null(x, ["config"], P.reps, P.seed)
    return written(events.results_table(x, boot_weights(spark, x, P.reps, P.seed), null, P, weeks()), "level_table")


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = trades(spark, sf_dir).select(weeks().alias("p")).distinct().count()
    return events.verdict(table(spark, sf_dir), periods, LEAST).select("config", "mean_r", "lower", "p_max", "min_trades", "passes", "weak", "verdict")


TRADE = ("config", "series", "day", "t", "tc", "approach", "dir", "level", "a0", "entry", "entry_tc", "exit_tc", "reason", "conflict", "usd", "r", "r_flip", "test_no")
QUERIES = {
    "level_side": lambda s, d: rounded(sides(s, d)),
    "ev_touch": family("R1"),
    "ev_reject": family("R2"),
    "ev_break": family("B"),
    "ev_retest": family("BR"),
    "ev_failed": family("F"),
    "level_trades": lambda s, d: rounded(trades(s, d).select(*TRADE)),
    "level_splits": lambda s, d: rounded(events.splits(trades(s, d), P, weeks())),
    "level_heatmap": lambda s, d: rounded(events.heatmap(trades(s, d), P)),
    "level_table": lambda s, d: rounded(table(s, d)),
    "level_verdict": lambda s, d: rounded(verdict(s, d)),
}

#: Signal bars of all lengths as one table: series has the length behind it, sr is the series alone.
LEVEL_BARS = """
lsig AS (
  SELECT series || '|' || len AS series, series AS sr, len AS bars, day, b.t - b.t % len AS t, b.t - b.t % len + len AS tc, arg_min(o, b.t) AS o, max(h) AS h, min(l) AS l, arg_max(c, b.t) AS c,
    arg_max(spread, b.t) AS spread, min(l + spread) AS ask_low, max(h + spread) AS ask_high, max(b.t) AS last_t
  FROM base b, (VALUES (60), (120)) z(len) GROUP BY ALL)"""
LEVEL_ATR = ATR.format(table="lsig", order="t", period=14, name="lsa")
CTX = """
lv AS (SELECT series, day, lag(c) OVER (PARTITION BY series ORDER BY day) AS lvl FROM days),
ends AS (SELECT series, day, max(tc) AS last_tc FROM base WHERE tc <= day * 1440 + 1290 GROUP BY ALL),
ctx AS (SELECT l.series, l.day, lvl, l.day * 1440 + resume AS from_tc FROM lv l JOIN resume r USING (series, day) JOIN ends d USING (series, day) ANTI JOIN (SELECT * FROM audit WHERE quarantined) z USING (series, day)
  WHERE lvl IS NOT NULL AND d.last_tc > l.day * 1440 + resume),
mk0 AS (SELECT *, lag(atr) OVER (PARTITION BY series ORDER BY t) AS a0 FROM lsa),
mk1 AS MATERIALIZED (SELECT m.*, lvl, from_tc, row_number() OVER w AS n, first_value(o) OVER w AS dopen, last_value(last_t) OVER v AS end_t, last_value(m.tc) OVER v AS end_tc
  FROM mk0 m JOIN ctx x ON x.series = m.sr AND x.day = m.day WINDOW w AS (PARTITION BY m.series, m.day ORDER BY t), v AS (PARTITION BY m.series, m.day ORDER BY t ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
outs AS (SELECT m.series, m.t, d, max_by(z.c, z.n) AS oc FROM mk1 m, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) x(d), mk1 z WHERE z.series = m.series AND z.day = m.day AND z.n < m.n AND abs(z.c - m.lvl) > d * m.a0 GROUP BY ALL),
mk AS MATERIALIZED (SELECT m.*, x.d, x.d * a0 AS band, sign(coalesce(oc, dopen) - lvl)::INT AS side FROM mk1 m CROSS JOIN (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) x(d) LEFT JOIN outs o ON o.series = m.series AND o.t = m.t AND o.d = x.d),
hrs AS (SELECT * FROM mk WHERE tc > from_tc AND tc < day * 1440 + 1260 AND a0 IS NOT NULL)"""
COLUMNS = "series, sr, day, t, tc, bars, {variant} AS variant, lvl, {side} AS approach, a0, {dir} AS dir, {entry} AS entry, {flip} AS flip, {entry_tc} AS entry_tc, {path_t} AS path_t, {fill_t} AS fill_t, {struct} AS struct, {known} AS known, {busy} AS busy"


def _close(side: str, close: str = "c", spread: str = "spread") -> dict[str, str]:
    return {"dir": side, "entry": f"CASE WHEN {side} = 1 THEN {close} + {spread} ELSE {close} END", "flip": f"CASE WHEN {side} = 1 THEN {close} ELSE {close} + {spread} END"}


def _rows(variant: str, **columns: str) -> str:
    return "SELECT " + COLUMNS.format(**{"side": "side", "fill_t": "NULL::BIGINT", "known": "false", "variant": variant, **columns}) + " FROM "


_D = "'{}(' || regexp_replace(d::VARCHAR, '\\.0$', '') || ')'"
_BREAK_STOP = "CASE WHEN side = 1 THEN ask_high ELSE l END"
_FAR_SIDE = "CASE WHEN side = 1 THEN {0} ELSE {1} END"
FAMILIES = f"""
brk AS MATERIALIZED (SELECT * FROM hrs WHERE (side = 1 AND c < lvl - band) OR (side = -1 AND c > lvl + band)),
seen AS (SELECT b.series AS bsr, b.day AS bday, b.t AS bt, m.series, any_value(m.bars) AS bars, max_by(m.c, m.tc) FILTER (WHERE m.tc <= b.t AND m.c <> m.lvl) AS oc, max_by(m.atr, m.tc) FILTER (WHERE m.tc <= b.t AND m.atr IS NOT NULL) AS atr_seen,
  count(*) FILTER (WHERE m.tc <= b.t) AS n_seen, max_by(m.atr IS NULL, m.tc) FILTER (WHERE m.tc <= b.t) AS last_null, min_by(coalesce(m.a0, -1), m.t) AS first_a FROM base b JOIN mk1 m ON m.sr = b.series AND m.day = b.day GROUP BY ALL),
tch0 AS (SELECT b.*, first_value(b.o) OVER (PARTITION BY b.series, b.day ORDER BY b.t) AS dopen FROM base b),
tch AS (SELECT s.series, b.series AS sr, b.day, b.t, b.tc, s.bars, x.lvl, sign(coalesce(s.oc, b.dopen) - x.lvl)::INT AS side, CASE WHEN n_seen > 0 THEN CASE WHEN last_null THEN NULL ELSE atr_seen END WHEN first_a >= 0 THEN first_a END AS a0, b.l, b.h, b.spread
  FROM tch0 b JOIN ctx x USING (series, day) JOIN seen s ON s.bsr = b.series AND s.bday = b.day AND s.bt = b.t WHERE b.t >= x.from_tc AND b.t < b.day * 1440 + 1260),
ev_r1 AS ({_rows("'R1'", dir="side", entry="lvl", flip="lvl", entry_tc="tc", path_t="t", fill_t="t", struct="CASE WHEN side = 1 THEN l ELSE h + spread END", busy="tc")} tch WHERE a0 IS NOT NULL AND ((side = 1 AND l + spread <= lvl) OR (side = -1 AND h >= lvl))),
ev_r2 AS ({_rows("'R2'", **_close("side"), entry_tc="tc", path_t="last_t + 1", struct=_FAR_SIDE.format("l", "ask_high"), busy="tc")} hrs WHERE d = 0 AND ((side = 1 AND ask_low <= lvl AND c > lvl) OR (side = -1 AND h >= lvl AND c < lvl))),
ev_b AS ({_rows(_D.format("B"), **_close("(-side)"), entry_tc="tc", path_t="last_t + 1", struct=_BREAK_STOP, busy="tc")} brk),
fills AS (SELECT e.series, e.d, e.t AS et, min(b.t) AS ft, min(b.tc) AS ftc FROM brk e JOIN base b ON b.series = e.sr AND b.day = e.day AND b.t > e.last_t AND b.t <= e.end_t AND b.t < e.day * 1440 + 1260 AND CASE WHEN e.side = 1 THEN b.h >= e.lvl ELSE b.l + b.spread <= e.lvl END GROUP BY ALL),
ev_br AS ({_rows(_D.format("BR"), dir="CASE WHEN ft IS NOT NULL THEN -side END", entry="CASE WHEN ft IS NOT NULL THEN lvl END", flip="CASE WHEN ft IS NOT NULL THEN lvl END", entry_tc="ftc", path_t="ft", fill_t="ft", struct=f"CASE WHEN ft IS NOT NULL THEN {_BREAK_STOP} END", known="true", busy="coalesce(ftc, end_tc)")}
  (SELECT e.*, ft, ftc FROM brk e LEFT JOIN fills f ON f.series = e.series AND f.d = e.d AND f.et = e.t)),
backs AS (SELECT e.series, e.d, e.t AS et, min(z.tc) AS btc FROM brk e JOIN mk1 z ON z.series = e.series AND z.day = e.day AND z.n > e.n AND z.n <= e.n + 12 AND z.tc < e.day * 1440 + 1260 AND CASE WHEN e.side = 1 THEN z.c > e.lvl ELSE z.c < e.lvl END GROUP BY ALL),
turned AS (SELECT b.series, b.d, b.et, btc, max_by(z.c, z.n) AS bc, max_by(z.spread, z.n) AS bs, min(z.l) AS low, max(z.ask_high) AS high FROM backs b JOIN mk1 z ON z.series = b.series AND z.day = b.et // 1440 AND z.t >= b.et AND z.tc <= b.btc GROUP BY ALL),
ev_f AS ({_rows(_D.format("F"), dir="CASE WHEN btc IS NOT NULL THEN side END", entry="CASE WHEN side = 1 THEN bc + bs ELSE bc END", flip="CASE WHEN side = 1 THEN bc ELSE bc + bs END", entry_tc="btc", path_t="btc", struct=_FAR_SIDE.format("low", "high"), busy="coalesce(btc, end_tc)")}
  (SELECT e.*, btc, bc, bs, low, high FROM brk e LEFT JOIN turned f ON f.series = e.series AND f.d = e.d AND f.et = e.t)),
ev0 AS (SELECT * FROM ev_r1 UNION ALL SELECT * FROM ev_r2 UNION ALL SELECT * FROM ev_b UNION ALL SELECT * FROM ev_br UNION ALL SELECT * FROM ev_f),
rearms AS (SELECT e.series, e.variant, e.t, min(z.tc) AS rearm FROM ev0 e JOIN mk1 z ON z.series = e.series AND z.day = e.day AND z.tc > e.tc AND abs(z.c - e.lvl) >= 0.5 * e.a0 GROUP BY ALL),
ev AS MATERIALIZED (SELECT e.*, coalesce(rearm, {events.NEVER}) AS rearm FROM ev0 e LEFT JOIN rearms USING (series, variant, t))"""
ALL = (BARS, LEVEL_BARS, LEVEL_ATR, RESUME, AUDIT, CTX)
EV = "SELECT sr AS series, day, t, tc, bars::BIGINT AS bars, variant, approach::BIGINT AS approach, round(lvl, 6) + 0.0 AS level, round(a0, 6) + 0.0 AS a0, dir::BIGINT AS dir, round(entry, 6) + 0.0 AS entry, round(flip, 6) + 0.0 AS flip, entry_tc, fill_t, round(struct, 6) + 0.0 AS struct, busy, rearm FROM ev WHERE regexp_extract(variant, '^[A-Z0-9]+') = "
TRADES = f"""
sides AS (
  SELECT series, sr, day, variant, t, path_t, fill_t, a0, stop, way, k, CASE WHEN way = 1 THEN entry ELSE flip END AS e, dir * way AS dr, CASE WHEN stop = 'Sstruct' THEN greatest((entry - struct) * dir, 0.1 * a0) ELSE s * a0 END AS dist, CASE WHEN stop = 'Sstruct' THEN known ELSE true END AS in_fill
  FROM ev, (VALUES ('S0.5', 0.5::DOUBLE), ('S1', 1.0::DOUBLE), ('S2', 2.0::DOUBLE), ('Sstruct', NULL)) x(stop, s), (VALUES (1), (-1)) y(way), (VALUES (1), (2), (3)) z(k) WHERE dir IS NOT NULL),
costs AS (SELECT *, 2 * 0.000016::DOUBLE * e AS cost FROM sides),
goals AS (SELECT *, dist + cost AS unit, e - dr * dist AS sl, e + dr * (k * (dist + cost) + cost) AS tp FROM costs),
pth AS (
  SELECT g.*, b.tc AS btc, coalesce(b.t = g.fill_t, false) AS filling, CASE WHEN dr = 1 THEN b.o ELSE b.o + b.spread END AS op, CASE WHEN dr = 1 THEN b.c ELSE b.c + b.spread END AS cl,
    CASE WHEN dr = 1 THEN b.l <= sl ELSE b.h + b.spread >= sl END AS below, CASE WHEN dr = 1 THEN b.h >= tp ELSE b.l + b.spread <= tp END AS above
  FROM goals g JOIN base b ON b.series = g.sr AND b.day = g.day AND b.t >= g.path_t AND b.tc <= g.day * 1440 + 1290),
firsts AS (SELECT series, variant, t, stop, way, k, min(btc) FILTER (WHERE below AND (NOT filling OR in_fill)) AS stc, min(btc) FILTER (WHERE above AND NOT filling) AS ttc, max(btc) AS ltc FROM pth GROUP BY ALL),
told AS (SELECT *, CASE WHEN stc <= coalesce(ttc, stc) THEN 1 WHEN ttc IS NOT NULL THEN 2 ELSE 0 END AS reason, coalesce(least(stc, ttc), ltc) AS exit_tc FROM firsts),
sims AS (
  SELECT f.series, f.variant, f.t, f.stop, f.way, f.k, reason, f.exit_tc, reason = 1 AND stc = coalesce(ttc, -1) AS conflict,
    (CASE reason WHEN 1 THEN CASE WHEN NOT filling AND CASE WHEN dr = 1 THEN op <= sl ELSE op >= sl END THEN op ELSE sl END WHEN 2 THEN tp ELSE cl END - e) * dr - cost AS usd, unit
  FROM told f JOIN pth p ON p.series = f.series AND p.variant = f.variant AND p.t = f.t AND p.stop = f.stop AND p.way = f.way AND p.k = f.k AND p.btc = f.exit_tc),
both_ways AS (SELECT a.* EXCLUDE (way, unit), a.usd / a.unit AS r, b.usd / b.unit AS r_flip FROM sims a JOIN sims b USING (series, variant, t, stop, k) WHERE a.way = 1 AND b.way = -1),
every AS (SELECT 'M' || bars || '_' || ev.variant || '_' || c.stop || '_k' || c.k AS config, ev.* EXCLUDE (bars), bars, c.stop, c.k, exit_tc, reason, conflict, usd, r, r_flip, greatest(busy, coalesce(exit_tc, busy), rearm) AS ready
  FROM ev CROSS JOIN (SELECT DISTINCT stop, k FROM (VALUES ('S0.5'), ('S1'), ('S2'), ('Sstruct')) x(stop), (VALUES (1), (2), (3)) z(k)) c LEFT JOIN both_ways w ON w.series = ev.series AND w.variant = ev.variant AND w.t = ev.t AND w.stop = c.stop AND w.k = c.k),
ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY config, series, day ORDER BY t) AS n FROM every),
nx AS MATERIALIZED (SELECT a.*, b.t AS next_t FROM ord a ASOF LEFT JOIN ord b ON b.config = a.config AND b.series = a.series AND b.day = a.day AND b.t >= a.ready),
walk AS (SELECT *, 1::BIGINT AS test_no FROM nx WHERE n = 1 UNION ALL SELECT x.*, a.test_no + 1 FROM walk a JOIN nx x ON x.config = a.config AND x.series = a.series AND x.day = a.day AND x.t = a.next_t),
acc AS (SELECT *, (day + 3) // {PERIOD} AS period FROM walk WHERE exit_tc IS NOT NULL)"""
SUMMARY = "count(*) AS trades, round(avg(r), 6) + 0.0 AS mean_r, round(avg((r > 0)::INT), 6) + 0.0 AS win_rate, round(avg(r) FILTER (WHERE r > 0), 6) + 0.0 AS avg_win, round(avg(r) FILTER (WHERE r <= 0), 6) + 0.0 AS avg_loss"
SESSION = "(SELECT count(*) FROM (VALUES (480), (600), (780), (990), (1080)) h(x) WHERE x <= entry_tc % 1440)"
DRAW = "('0x' || substr(md5('7:' || {0}), 1, 8))::UBIGINT::BIGINT"
TABLE = f"""
tdays AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM acc)),
draws AS (SELECT rep, {DRAW.format("rep || ':' || d")} % (SELECT count(*) FROM tdays) AS i FROM range(200) a(rep), range(10000) b(d) WHERE d < (SELECT count(*) FROM tdays)),
wts AS (SELECT rep, day, count(*) AS w FROM draws JOIN tdays USING (i) GROUP BY ALL),
daily AS MATERIALIZED (SELECT config, day, sum(r) AS s, sum(r_flip) AS f, count(*) AS n FROM acc GROUP BY ALL),
lows AS (SELECT config, quantile_cont(m, 0.05) AS lower FROM (SELECT config, rep, sum(s * w) / sum(n * w) AS m FROM daily JOIN wts USING (day) GROUP BY ALL) GROUP BY ALL),
coins AS (SELECT run, day, {DRAW.format("run || ':' || day")} % 2 AS coin FROM range(200) a(run), (SELECT DISTINCT day FROM acc)),
nulls AS (SELECT config, run, sum(CASE WHEN coin = 1 THEN f ELSE s END) / sum(n) AS m FROM daily JOIN coins USING (day) GROUP BY ALL),
bests AS (SELECT run, max(m) AS best FROM nulls GROUP BY ALL),
whole AS (SELECT config, {SUMMARY}, avg(r) AS exact, round(avg(conflict::INT), 6) + 0.0 AS conflict_share, round(avg(usd), 6) + 0.0 AS mean_usd FROM acc GROUP BY ALL),
pmax AS (SELECT config, avg((best >= exact)::INT) AS p_max FROM whole, bests GROUP BY ALL),
sums AS (SELECT config, entry_tc, series, sum(r) OVER (PARTITION BY config ORDER BY entry_tc, series ROWS UNBOUNDED PRECEDING) AS s FROM acc),
falls AS (SELECT config, max(greatest(top, 0) - s) AS drawdown FROM (SELECT *, max(s) OVER (PARTITION BY config ORDER BY entry_tc, series ROWS UNBOUNDED PRECEDING) AS top FROM sums) GROUP BY ALL),
spans AS (SELECT config, count(*) AS periods, min(n) AS min_trades, min(m) AS min_mean FROM (SELECT config, period, count(*) AS n, avg(r) AS m FROM acc GROUP BY ALL) GROUP BY ALL),
tbl AS (SELECT * FROM whole JOIN lows USING (config) JOIN pmax USING (config) JOIN falls USING (config) JOIN spans USING (config)),
marks AS (SELECT *, periods = (SELECT count(DISTINCT period) FROM acc) AND min_mean > 0 AS gains FROM tbl),
flags AS (SELECT *, gains AND lower > 0 AND p_max < 0.05 AND min_trades >= {LEAST} AS passes, NOT (gains AND lower > 0 AND p_max < 0.05 AND min_trades >= {LEAST}) AND gains AND p_max < 0.10 AS weak FROM marks)"""

ORACLE_SQL = {
    "level_side": q(f"SELECT sr AS series, day, t, bars::BIGINT AS bars, n, round(lvl, 6) + 0.0 AS level, {r('a0', 'd')}, side::BIGINT AS side FROM mk", *ALL),
    **{f"ev_{name}": q(f"{EV}'{prefix}'", *ALL, FAMILIES) for name, prefix in (("touch", "R1"), ("reject", "R2"), ("break", "B"), ("retest", "BR"), ("failed", "F"))},
    "level_trades": q(f"SELECT config, sr AS series, day, t, tc, approach::BIGINT AS approach, dir::BIGINT AS dir, round(lvl, 6) + 0.0 AS level, {r('a0', 'entry', 'usd', 'r', 'r_flip')}, entry_tc, exit_tc, reason::BIGINT AS reason, conflict, test_no FROM acc", *ALL, FAMILIES, TRADES),
    "level_splits": q(f"SELECT config, period, approach, test, session, {SUMMARY} FROM (SELECT config, period, approach::BIGINT AS approach, least(test_no, 4) AS test, {SESSION} AS session, r FROM acc) GROUP BY GROUPING SETS ((config), (config, period), (config, approach), (config, test), (config, session))", *ALL, FAMILIES, TRADES),
    "level_heatmap": q("SELECT bars::BIGINT AS bars, variant, k::BIGINT AS k, " + ", ".join(f"round(avg(r) FILTER (WHERE stop = '{s}'), 6) + 0.0 AS {s.replace('.', '_')}" for s in ("S0.5", "S1", "S2", "Sstruct")) + " FROM acc GROUP BY ALL", *ALL, FAMILIES, TRADES),
    "level_table": q(f"SELECT * EXCLUDE (exact, lower, p_max, drawdown, min_mean), {r('lower', 'p_max', 'drawdown', 'min_mean')} FROM tbl", *ALL, FAMILIES, TRADES, TABLE),
    "level_verdict": q(f"SELECT config, mean_r, {r('lower', 'p_max')}, min_trades, passes, weak, CASE WHEN max(passes) OVER () THEN 'PASS' WHEN max(weak) OVER () THEN 'WEAK' ELSE 'STOP' END AS verdict FROM flags", *ALL, FAMILIES, TRADES, TABLE),
}
