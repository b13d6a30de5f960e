"""Rounding and ties: as the SQL's engine rounds, and the same whatever the order of rows."""

import random
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from quantloom.functions.time import r6
from quantloom.operators import mining, resample


def test_rounding_is_the_sqls(spark):
    """Shares of 640 and 3200 end at the seventh place with a 5, as means of prices and commissions do."""
    chance = random.Random(4)
    values = [j / n for n in (128, 640, 3200) for j in range(-2 * n, 2 * n)] + [chance.randint(-(10**9), 10**9) * 1e-7 for _ in range(5000)]
    values += [0.0, -0.0, -1e-9, 1e300, 1e305, -1e308, 123456789012.3456785, float("inf"), float("-inf"), float("nan")]
    got = [r.r for r in spark.createDataFrame([(v,) for v in values], "x double").select(r6(F.col("x")).alias("r")).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(x, 6) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()][0]
    assert [repr(v) for v in got] == [repr(v) for v, in want]
    assert spark.range(1).select(r6(F.lit(None).cast("double")).alias("r")).first().r is None


def test_splits_of_equal_rows_are_told_by_name(spark):
    """Features b and c part the rows as a does, in other orders within the halves, c the other way round."""
    rows, want = [], {}
    for node in range(12):
        chance = random.Random(node)
        cents = [chance.randint(-200000, 200000) + (900000 if i < 300 else 0) for i in range(700)]
        orders = [chance.sample(range(300), 300) + [300 + i for i in chance.sample(range(400), 400)] for _ in range(3)]
        for i, y in enumerate(cents):
            rows += [(node, f, x, y / 100) for f, x in zip("bac", (float(orders[0][i]), float(orders[1][i]), -float(orders[2][i])), strict=True)]
        left, right = sum(cents[:300]), sum(cents[300:])
        want[node] = float(Fraction(left**2, 300) + Fraction(right**2, 400) - Fraction((left + right) ** 2, 700)) / 10000
    chance.shuffle(rows)
    shape, gains = "node int, feature string, x double, y double", []
    for features, named in (("abc", "a"), ("bc", "b"), ("c", "c")):
        got = {r.node: r for r in mining.best_splits(spark.createDataFrame([r for r in rows if r[1] in features], shape), "node", 40).collect()}
        assert all(r.feature == named and {r.nl, r.nr} == {300, 400} and abs(r.gain - want[n]) < 1e-12 * want[n] for n, r in got.items())
        gains.append({n: r.gain for n, r in got.items()})
    assert len(got) == 12 and gains[0] == gains[1] == gains[2]


def test_splits_keep_values_that_are_no_decimals(spark):
    rows = [(0, "a", float(i), y) for i, y in enumerate((1e15, 1e15, 3e15, 3e15))] + [(1, "a", float(i), y) for i, y in enumerate((1.0, 1.0, float("inf"), 2.0))]
    got = {r.node: r for r in mining.best_splits(spark.createDataFrame(rows, "node int, feature string, x double, y double"), "node", 2).collect()}
    assert got[0].threshold == 1.5 and abs(got[0].gain - 4e30) < 1e18 and got[1].gain != got[1].gain


def test_runs_that_equal_the_mean_count(spark):
    """0.1 + 0.2 + 0.3 is another double than 0.3 + 0.2 + 0.1; a run that turns no day has the real trades."""
    real = spark.createDataFrame([("a", (0.1 + 0.2 + 0.3) / 3), ("b", 0.3), ("c", 0.20000001)], "config string, mean double")
    best = spark.createDataFrame([(0, (0.3 + 0.2 + 0.1) / 3), (1, (0.1 + 0.2) / 1), (2, 0.1)], "run int, best double")
    assert (0.3 + 0.2 + 0.1) / 3 < (0.1 + 0.2 + 0.3) / 3
    got = {r.config: r.p_max for r in resample.max_statistic_p(real, best, ["config"]).collect()}
    assert got == {"a": 2 / 3, "b": 1 / 3, "c": 1 / 3}
