"""Hand cases as literal tables: resampling, average true range, resume times, targets, exits, selection, statistics."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quantloom.config import DEFAULT, Params
from quantloom.functions.rules import Interval, Rule, described, direction, from_rows, hits, holds, table, top_hits
from quantloom.operators import bars, events, mining, moments, outcomes, quality, resample

DAY0 = 19723 * 1440  # Monday, 1 January 2024
SCHEMA = "series string, t long, tc long, day long, o double, h double, l double, c double, tv long, spread double"


def flat_day(spark, day=0, start=60, end=1435, price=1800.0, spread=0.2, edits=None):
    rows = []
    for m in range(start, end + 1):
        o = h = low = c = price
        s = spread
        if edits and m in edits:
            o, h, low, c, s = edits[m]
        t = DAY0 + day * 1440 + m
        rows.append(("x", t, t + 1, t // 1440, o, h, low, c, 50, s))
    return spark.createDataFrame(rows, SCHEMA)


def test_atr_by_hand(spark):
    rows = [("x", i, i + 1, 0, 0.0, h, low, c, 1, 0.0) for i, (h, low, c) in enumerate([(10.0, 8.0, 9.0), (12.0, 9.0, 11.0), (11.0, 9.0, 10.0), (13.0, 10.0, 12.0), (12.0, 11.0, 11.5)])]
    got = [r.atr for r in bars.atr(spark.createDataFrame(rows, SCHEMA), 3).orderBy("t").collect()]
    assert got[:2] == [None, None] and got[2:] == pytest.approx([7 / 3, 23 / 9, 55 / 27])


def test_atr_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(bars, "ATR_BLOCK", 512)
    rows = [("x", i, i + 1, 0, 0.0, 10 + math.sin(i) * 3, 5 + math.cos(i), 7 + math.sin(i / 7), 1, 0.0) for i in range(2000)]
    got = [r.atr for r in bars.atr(spark.createDataFrame(rows, SCHEMA), 14).orderBy("t").collect()]
    tr = [rows[0][5] - rows[0][6]] + [max(h[5] - h[6], abs(h[5] - p[7]), abs(h[6] - p[7])) for p, h in zip(rows, rows[1:], strict=False)]
    a = sum(tr[:14]) / 14
    for i in range(14, 2000):
        a += (tr[i] - a) / 14
        assert got[i] == pytest.approx(a, rel=1e-12)


def test_resample_keeps_nominal_close(spark):
    x = flat_day(spark, start=600, end=612, edits={601: (1.0, 9.0, 0.5, 2.0, 0.3)})
    got = {r.t - DAY0: r for r in bars.resample(x, 5).collect()}
    assert got[600].h == 1800 and got[600].l == 0.5 and got[600].ask_low == pytest.approx(0.8) and got[610].tc - DAY0 == 615 and got[610].tv == 150


def test_resume_times(spark):
    p = replace(DEFAULT, base=1, resume_bars=5)
    wide = lambda n: {m: (1800.0,) * 4 + (0.9,) for m in range(60, 60 + n)}
    x = flat_day(spark, 0).union(flat_day(spark, 1, edits=wide(10))).union(flat_day(spark, 2, edits=wide(1200))).union(flat_day(spark, 3))
    got = [(r.resume, r.reason) for r in moments.resume_times(x, p).orderBy("day").collect()]
    assert got == [(990, 2), (75, 0), (990, 1), (65, 0)]


def test_targets_by_hand(spark):
    edits = {1259: (1800.0, 1803.5, 1800.0, 1803.5, 0.35), 1289: (1800.0, 1800.0, 1797.2, 1797.2, 0.25)}
    x = flat_day(spark, edits=edits)
    at = x.where(F.col("tc") == DAY0 + 1230)
    p = replace(DEFAULT, base=1, horizons=(30, 60, 120))
    got = {r.horizon: r for r in outcomes.targets(x, at, p).collect()}
    assert got[30].long == pytest.approx(3.2424) and got[30].short == pytest.approx(-3.9076)
    assert got[60].long == got[-1].long == pytest.approx(-3.0576) and got[-1].short == pytest.approx(2.4924)
    assert got[120].long is None


def test_long_and_short_sum_to_costs(spark):
    x = flat_day(spark, edits={700: (1800.0, 1811.0, 1799.0, 1810.0, 0.4)})
    r = outcomes.targets(x, x.where(F.col("tc") == DAY0 + 641), replace(DEFAULT, horizons=(60,))).where("horizon = 60").first()
    assert r.long + r.short == pytest.approx(-(0.2 + 0.4) - 4 * 0.000016 * 1800)


@pytest.mark.parametrize(
    ("edit", "side", "exit_", "reason", "gain"),
    [
        ((1800.0, 1800.0, 1798.1, 1800.0, 0.2), 1, "SL1_TP2", 1, -2.0),
        ((1800.0, 1804.3, 1800.0, 1800.0, 0.2), 1, "SL1_TP2", 2, 4.0),
        ((1800.0, 1804.3, 1798.1, 1800.0, 0.2), 1, "SL1_TP2", 1, -2.0),
        ((1797.0, 1797.0, 1796.0, 1797.0, 0.2), 1, "SL1", 1, -3.2),
        ((1802.0, 1802.0, 1801.0, 1802.0, 0.05), -1, "SL1", 1, -2.05),
    ],
)
def test_exits_by_hand(spark, edit, side, exit_, reason, gain):
    x = flat_day(spark, edits={700: edit})
    at = x.where(F.col("tc") == DAY0 + 641).withColumn("atr", F.lit(2.0))
    r = outcomes.exits(x, at, DEFAULT).where((F.col("side") == side) & (F.col("exit") == exit_)).first()
    assert r.reason == reason and r.net == pytest.approx(gain - 0.0576) and r.conflict == (edit[1] > 1804 and edit[2] < 1799)


def test_break_even_and_trailing(spark):
    x = flat_day(spark, edits={700: (1800.0, 1803.0, 1800.0, 1803.0, 0.2), 701: (1803.0, 1803.0, 1799.0, 1799.0, 0.2)})
    at = x.where(F.col("tc") == DAY0 + 641).withColumn("atr", F.lit(2.0))
    got = {r.exit: r for r in outcomes.exits(x, at, DEFAULT).where("side = 1").collect()}
    assert got["BE1"].net == pytest.approx(0) and got["TR1"].net == pytest.approx(1803 - 2 - 1800.2 - 0.0576) and got["SL1"].reason == 3


def test_one_at_a_time(spark):
    df = spark.createDataFrame(list(zip([0, 5, 10, 12, 20], [12, 8, 15, 30, 25], strict=True)), "tc long, exit_tc long").withColumn("day", F.lit(1))
    assert sorted(r.tc for r in outcomes.one_at_a_time(df, ["day"]).collect()) == [0, 12]
    assert outcomes.one_at_a_time(df.where("false"), ["day"]).count() == 0


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "h string, p double")
    got = {r.h: (round(r.p_holm, 9), r.reject) for r in resample.holm(df, ["h"], 0.05).collect()}
    assert got == {"a": (0.03, True), "b": (0.06, False), "c": (0.06, False), "d": (0.02, True)}


def test_permutation_and_maximum(spark):
    real = spark.createDataFrame([("a", 0.1), ("b", None)], "c string, mean double")
    null = spark.createDataFrame([("a", r, v) for r, v in enumerate([None, None, 0.2, -0.3])], "c string, run int, null_mean double")
    assert {r.c: r.p for r in resample.permutation_p(real, null, ["c"]).collect()} == {"a": 0.25, "b": 1.0}
    null = spark.createDataFrame([(r, v) for r, row in enumerate([[0.1, None, -0.2], [None] * 3, [0.3, 0.2, 0.0]]) for v in row], "run int, null_mean double")
    best = resample.null_best(null)
    assert sorted(r.best for r in best.collect()) == [0.0, 0.1, 0.3]
    assert resample.max_statistic_p(spark.createDataFrame([("a", 0.2)], "c string, mean double"), best, ["c"]).first().p_max == pytest.approx(1 / 3)


def test_drawdown(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, -2, 1, -3, 5])], "c string, t int, r double")
    assert resample.drawdown(df, ["c"], "r", ["t"]).first().drawdown == 4


def test_two_day_bootstrap(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0)], "c string, day int, r double")
    r = resample.day_bootstrap(df, resample.boot_weights(spark, df, 400, 1), ["c"], "r", 0.05).first()
    assert (r.lower, r.upper, r.mean, r.days) == (0, 1, 0.5, 2)


def test_edges(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("w", float(i % 5)) for i in range(100)] + [("one", 1.0)] * 3, "feature string, x double")
    got = {r.feature: r.edges for r in mining.edges(df, 10).collect()}
    assert len(got["a"]) == 9 and got["w"] == [0.5, 1.5, 2.5, 3.5] and got["one"] == []
    sizes = mining.bins(df.where("feature = 'a'"), mining.edges(df, 10)).groupBy("bin").count().collect()
    assert {r["count"] for r in sizes} == {10}


def test_rule_conflict(spark):
    rules = [Rule("l", 1, (Interval("x", 1.0, 3.0),)), Rule("s", -1, (Interval("x", 2.0, None),))]
    df = spark.createDataFrame([(float(i),) for i in range(4)], "x double")
    assert [r.d for r in df.select("x", direction(rules).alias("d")).orderBy("x").collect()] == [0, 1, 0, -1]
    rows = table(spark, [*rules, Rule("all", 1)])
    texts = {r.rule_id: r.text for r in rows.select("rule_id", described(F.col("conds")).alias("text")).collect()}
    assert texts == {"l": "x in [1.0000, 3.0000)", "s": "x in [2.0000, inf)", "all": "always"}
    assert from_rows(rows) == [Rule("all", 1), *rules]
    # the same conditions as columns and as rows
    wide = df.select("x", F.create_map(F.lit("x"), F.col("x").cast("double")).alias("v"))
    both = wide.crossJoin(rows).select("x", "rule_id", holds(F.col("conds"), F.col("v")).alias("on")).where("on").collect()
    assert sorted((r.x, r.rule_id) for r in both if r.rule_id != "all") == sorted((r.x, n) for r in df.collect() for n, ok in (("l", 1 <= r.x < 3), ("s", r.x >= 2)) if ok)
    assert [tuple(r) for r in top_hits(hits(df, rules, "x"), 1).collect()] == [("l", 1)]


def test_tree_finds_planted_split(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7), 1.0 if i % 10 >= 6 else -1.0) for i in range(400)], "id long, a double, b double, y double")
    got = {r.leaf: (r.n, r["mean"]) for r in mining.leaves(mining.regression_tree(df, ("a", "b"), "y", 1, 20, "id")).collect()}
    assert got == {"L": (240, -1.0), "R": (160, 1.0)}


def test_folds_and_permutation(spark):
    days = spark.createDataFrame([(i,) for i in range(10)], "day long")
    got = mining.folds(days, 4, 1, 3).where("fold = 0").orderBy("day").collect()
    assert [(r.day, r.role) for r in got] == [(0, "train"), (1, "train"), (2, "train"), (4, "test"), (5, "test"), (6, "test")]
    m = mining.day_permutation(days, 1, F.lit(0)).collect()
    assert sorted(r.day for r in m) == sorted(r.source_day for r in m) == list(range(10))


def test_audit_and_dedup(spark):
    x = flat_day(spark, edits={100: (1.0, 1.0, 1.0, 1.0, 0.0), 101: (1.0, 1.0, 1.0, 1.0, -0.03)}).where(~F.col("t").between(DAY0 + 200, DAY0 + 230))
    r = quality.audit_days(x, 1, 5, 30).first()
    assert (r.max_gap, r.gaps, r.quarantined, r.zero_spread, r.negative_spread) == (31, 1, True, 1, 1)
    twice = x.withColumn("seq", F.lit(0)).union(x.limit(2).withColumn("seq", F.lit(1)))
    d = quality.duplicates(twice, ["t"], ["series"]).first()
    assert (d.dup_rows, d.dropped) == (4, 2) and quality.deduplicated(twice, ["t"], ["seq"]).count() == x.count()
    broken = x.withColumn("seq", F.col("t")).withColumn("h", F.col("l") - 1)
    assert {r.violation for r in quality.violations(broken).collect()} == {"high", "spread"}


def test_features_do_not_look_ahead(spark):
    rows = [("x", t := DAY0 + d * 1440 + m, t + 15, t // 1440, 100 + math.sin(t), 101 + math.sin(t) ** 2, 99 - math.cos(t) ** 2, 100 + math.cos(t * 7), 5 + t % 4, 0.1 + (t // 15 % 5) / 100) for d in (0, 1, 2, 3, 4) for m in range(0, 1440, 15)]
    whole = spark.createDataFrame(rows, SCHEMA)
    cut = DAY0 + 4 * 1440 + 720
    from quantloom.operators import features

    def at(df):
        s = bars.resample(df, 60)
        return sorted(features.features(df, s, moments.resume_times(df, DEFAULT), DEFAULT).where(F.col("tc") <= cut).select("t", *features.NAMES).collect())

    changed = whole.withColumn("c", F.when(F.col("tc") > cut, F.col("c") * 3).otherwise(F.col("c"))).where((F.col("tc") <= cut) | (F.col("t") % 2 == 0))
    assert str(at(whole)) == str(at(changed))


def plain_exit(path, side, entry, dist, k, in_fill, fill_t, p):
    """reason, tc, conflict and r of a position along bars (t, tc, o, h, l, c, spread), bar by bar."""
    cost = 2 * p.rate * entry
    unit = dist + cost
    stop, target = entry - side * dist, entry + side * (k * unit + cost)
    for t, tc, o, h, low, c, sp in path:
        ask = 0.0 if side > 0 else sp
        worst, best, opened = (low, h, o) if side > 0 else (h + ask, low + ask, o + ask)
        filling = t == fill_t
        stopped = (worst - stop) * side <= 0 and (not filling or in_fill)
        reached = (best - target) * side >= 0 and not filling
        if stopped:
            price = opened if not filling and (opened - stop) * side <= 0 else stop
            return 1, tc, reached, ((price - entry) * side - cost) / unit
        if reached:
            return 2, tc, False, ((target - entry) * side - cost) / unit
    return 0, tc, False, ((c + ask - entry) * side - cost) / unit


def test_level_trades(spark):
    """Exits of random events and the events that are accepted, against walking bars and events one by one."""
    r, p = random.Random(5), replace(DEFAULT, level_stops=(0.5, 1.0), level_targets=(1, 2))
    bars, price = [], 100.0
    for i in range(40):
        o, price = price, price + r.uniform(-1, 1)
        bars.append((i * 15, i * 15 + 15, o, max(o, price) + r.random() / 2, min(o, price) - r.random() / 2, price, r.choice([0.01, 0.05, 0.3])))
    base = spark.createDataFrame([("x", 0, *b) for b in bars], "series string, day long, t long, tc long, o double, h double, l double, c double, spread double")
    found = []
    for i in range(60):
        at, side, none = r.randrange(0, 39), r.choice([1, -1]), r.random() < 0.2
        entry, fill = bars[at][5], r.choice([None, bars[at][0]])
        known = fill is not None and r.random() < 0.5
        busy = bars[at][1] if not none else bars[min(at + 3, 39)][1]
        start = None if none else (fill if fill is not None else bars[at][1])
        found.append((i, "x", 0, bars[at][0], bars[at][1], 15, r.choice("ab"), 100.0, side, 1.0, None if none else side, None if none else entry, None if none else entry + 0.05, busy, start, None if none else fill, None if none else entry - side * r.uniform(0, 1), known, busy, 600, bars[at][1] + r.choice([0, 30, 1 << 40])))
    names = "eid long, series string, day long, t long, tc long, bars int, variant string, level double, approach long, a0 double, dir int, entry double, flip double, entry_tc long, path_t long, fill_t long, struct double, known boolean, busy long, until long, rearm long"
    events_of = spark.createDataFrame(found, names)
    results = events.simulated(events_of, base, p)
    got = {(x.eid, x.stop, x.k): x for x in results.collect()}
    want = {}
    for e in found:
        eid, side, entry, flip, start, fill, struct, known = e[0], *e[10:13], *e[14:18]
        path = [b for b in bars if side is not None and b[0] >= start and b[1] <= 600]
        for s in (0.5, 1.0, None):
            for k in (1, 2):
                if path:
                    dist = max((entry - struct) * side, 0.1) if s is None else s
                    one, two = (plain_exit(path, w * side, price, dist, k, known if s is None else True, fill, p) for w, price in ((1, entry), (-1, flip)))
                    want[(eid, events.stop_name(s), k)] = (*one, two[3])
    assert set(got) == set(want) and want
    for key, (reason, tc, conflict, gain, turned) in want.items():
        x = got[key]
        assert (x.reason, x.exit_tc, x.conflict) == (reason, tc, conflict) and abs(x.r - gain) < 1e-9 and abs(x.r_flip - turned) < 1e-9
    # events of equal times are walked by what follows in their rows; here each time of a variant is taken once
    once = {(e[6], e[3]): e for e in found}
    chosen = events_of.where(F.col("eid").isin([e[0] for e in once.values()]))
    taken = {(x.config, x.t, x.test_no) for x in events.accepted(chosen, results, p).collect()}
    expected = set()
    for variant in "ab":
        for s in (0.5, 1.0, None):
            for k in (1, 2):
                ready, n = -1, 0
                for e in sorted((e for e in once.values() if e[6] == variant), key=lambda e: e[3]):
                    if e[3] < ready:
                        continue
                    n += 1
                    result = want.get((e[0], events.stop_name(s), k))
                    ready = max(e[18], result[1] if result else e[18], e[20])
                    if result:
                        expected.add((f"M15_{variant}_{events.stop_name(s)}_k{k}", e[3], n))
    assert taken == expected and taken



def test_fingerprint():
    assert Params().fingerprint() == DEFAULT.fingerprint() != replace(DEFAULT, seed=8).fingerprint()
