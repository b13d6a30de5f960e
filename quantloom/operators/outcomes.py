"""What a position opened at a decision moment earns: by horizon, by path exits, one position at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.config import Params
from quantloom.functions.time import DAY
from quantloom.operators.bars import asof


def targets(base: DataFrame, moments: DataFrame, p: Params) -> DataFrame:
    """moments by horizon (-1: end of day) with the net results of a long and a short.

    Longs pay the spread at entry, shorts that at exit, both twice the commission. A horizon counts if it ends by flat and the
    day's bars reach it; the exit is the last close by then. At the end of day the exit must be after the entry.
    """
    last = base.groupBy("series", "day").agg(F.max("tc").alias("last_tc"))
    x = moments.select("series", "day", "t", "tc", F.col("c").alias("p0"), F.col("spread").alias("spread0"))
    x = x.join(last, ["series", "day"]).withColumn("horizon", F.explode(F.array(*map(F.lit, (*p.horizons, -1)))))
    end = F.col("day") * DAY + p.flat
    x = x.withColumn("until", F.when(F.col("horizon") < 0, end).otherwise(F.col("tc") + F.col("horizon")))
    exits = base.select("series", F.col("tc").alias("xtc"), F.col("c").alias("p1"), F.col("spread").alias("spread1"))
    x = asof(x, exits, "until", "xtc", ["xtc", "p1", "spread1"])
    valid = F.when(F.col("horizon") < 0, F.col("xtc") > F.col("tc")).otherwise((F.col("until") <= end) & (F.col("last_tc") >= F.col("until")))
    commission = 2 * p.rate * F.col("p0")
    move = F.col("p1") - F.col("p0")
    return x.select(
        "series", "day", "t", "tc", "horizon", F.when(valid, move - F.col("spread0") - commission).alias("long"), F.when(valid, -move - F.col("spread1") - commission).alias("short"),
        F.when(valid, F.col("xtc")).alias("exit_tc"),
    )


def baseline(results: DataFrame, by: list[str]) -> DataFrame:
    """Always long and always short: trades, days, mean and share of winners for each group and side."""
    sides = results.select(*by, "day", F.explode(F.array(F.struct(F.lit("long").alias("side"), F.col("long").alias("net")), F.struct(F.lit("short").alias("side"), F.col("short").alias("net")))).alias("s"))
    sides = sides.select(*by, "day", "s.*").where("net is not null")
    return sides.groupBy(*by, "side").agg(F.count(F.lit(1)).alias("trades"), F.countDistinct("day").alias("days"), F.avg("net").alias("mean_net"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))


def exit_grid(p: Params) -> list[tuple[str, str, float, float | None]]:
    """name, kind, stop s, and for targets k: stop and target, stop alone, trailing stop, break-even; and time alone."""
    grid: list[tuple[str, str, float, float | None]] = [(f"SL{s:g}_TP{k:g}", "sltp", s, k) for s in p.stops for k in p.targets]
    for kind, name in (("sl", "SL"), ("trail", "TR"), ("be", "BE")):
        grid += [(f"{name}{s:g}", kind, s, None) for s in p.stops]
    return [*grid, ("TIME", "time", 1.0, None)]


def paths(base: DataFrame, moments: DataFrame, p: Params) -> DataFrame:
    """A row for each moment and side with its path: the day's later bars until flat, in order, as an array.

    Prices are in the position's favour and in average true ranges: fav is the best, adv the worst, op the open, cl the
    close of a bar; a short closes at the ask. A path has a day's bars at most.
    """
    bar = F.struct("t", "tc", "o", "h", "l", "c", "spread")
    by_day = base.where(F.col("tc") <= F.col("day") * DAY + p.flat).groupBy("series", "day").agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    m = moments.where("atr > 0").select("series", "day", F.col("t").alias("t0"), F.col("tc").alias("tc0"), F.col("c").alias("p0"), F.col("spread").alias("spread0"), F.col("atr").alias("a"))
    x = m.join(by_day, ["series", "day"]).withColumn("later", F.filter("bars", lambda b: b["t"] >= F.col("tc0"))).where(F.size("later") > 0)
    x = x.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("entry", F.when(F.col("side") == 1, F.col("p0") + F.col("spread0")).otherwise(F.col("p0")))
    a, e = F.col("a"), F.col("entry")
    long = lambda b: F.struct(b["tc"].alias("tc"), ((b["h"] - e) / a).alias("fav"), ((b["l"] - e) / a).alias("adv"), ((b["o"] - e) / a).alias("op"), ((b["c"] - e) / a).alias("cl"))
    short = lambda b: F.struct(
        b["tc"].alias("tc"), ((e - b["l"] - b["spread"]) / a).alias("fav"), ((e - b["h"] - b["spread"]) / a).alias("adv"), ((e - b["o"] - b["spread"]) / a).alias("op"), ((e - b["c"] - b["spread"]) / a).alias("cl")
    )
    path = F.when(F.col("side") == 1, F.transform("later", long)).otherwise(F.transform("later", short))
    return x.select("series", "day", "t0", "tc0", "side", "a", (2 * p.rate * F.col("p0") / a).alias("commission"), (F.col("spread0") / a).alias("spread_a"), path.alias("path"))


def _walk(kind: str, s: float, k: float | None, path: Column, commission: Column, spread: Column) -> Column:
    """reason (1 stop, 2 target, 3 end of day), at, gain before commission and conflict of an exit along a path.

    The stop wins in a bar that reaches both. A bar that opens beyond a level fills at its open. A trailing stop follows the
    best close so far; a break-even stop covers costs from the bar after the gain first reached s.
    """
    start = F.struct(F.lit(0).alias("reason"), F.lit(None).cast("bigint").alias("at"), F.lit(0.0).alias("gain"), F.lit(False).alias("conflict"), F.lit(-s).alias("stop"), (-spread if kind == "trail" else F.lit(0.0)).alias("best"))

    def step(acc, b):
        stopped = F.lit(False) if kind == "time" else b["adv"] <= acc["stop"]
        reached = b["fav"] >= k * s if kind == "sltp" else F.lit(False)
        gain = F.when(stopped, F.least(acc["stop"], b["op"])).when(reached, F.greatest(F.lit((k or 0.0) * s), b["op"])).otherwise(b["cl"])
        if kind == "trail":
            best = F.greatest(acc["best"], b["cl"])
            stop = F.greatest(acc["stop"], best - s)
        elif kind == "be":
            best = F.greatest(acc["best"], b["fav"])
            stop = F.when(best >= s, F.greatest(acc["stop"], commission)).otherwise(acc["stop"])
        else:
            best, stop = acc["best"], acc["stop"]
        new = F.struct(F.when(stopped, 1).when(reached, 2).otherwise(0).alias("reason"), b["tc"].alias("at"), gain.alias("gain"), (stopped & reached).alias("conflict"), stop.alias("stop"), best.alias("best"))
        return F.when(acc["reason"] > 0, acc).otherwise(new)

    return F.aggregate(path, start, step, lambda acc: acc.withField("reason", F.when(acc["reason"] == 0, 3).otherwise(acc["reason"])))


def exits(base: DataFrame, moments: DataFrame, p: Params, kinds: tuple[str, ...] = ("sltp", "sl", "trail", "be", "time")) -> DataFrame:
    """series, day, t, side, exit, reason, exit_tc, conflict, net (price) and r (in units of what the stop risks)."""
    x = paths(base, moments, p)
    made = [
        F.struct(F.lit(name).alias("exit"), F.lit(s).alias("s"), _walk(kind, s, k, F.col("path"), F.col("commission"), F.col("spread_a")).alias("w")) for name, kind, s, k in exit_grid(p) if kind in kinds
    ]
    x = x.withColumn("e", F.explode(F.array(*made)))
    gain = F.col("e.w.gain") - F.col("commission")
    return x.select(
        "series", "day", F.col("t0").alias("t"), F.col("tc0").alias("tc"), "side", "e.exit", "e.w.reason", F.col("e.w.at").alias("exit_tc"), "e.w.conflict", (gain * F.col("a")).alias("net"),
        (gain / (F.col("e.s") + F.col("spread_a") + F.col("commission"))).alias("r"),
    )


def one_at_a_time(trades: DataFrame, by: list[str], entry: str = "tc", leave: str = "exit_tc") -> DataFrame:
    """Trades in order of entry, each taken if it isn't before the last taken one's exit; all are flat by the day's end.

    The walk is a fold over a group's trades; by includes the day, so a group has a day's moments at most.
    """
    rest = [c for c in trades.columns if c not in by]
    row = F.struct(F.col(entry).alias("__entry"), *rest)
    start = F.struct(F.lit(-(1 << 62)).cast("bigint").alias("until"), F.array().cast(trades.select(F.array(row).alias("x")).schema["x"].dataType).alias("taken"))

    def step(acc, x):
        return F.when(x["__entry"] >= acc["until"], F.struct(x[leave].cast("bigint").alias("until"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    folded = trades.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step, lambda acc: acc["taken"]).alias("taken"))
    return folded.select(*by, F.explode("taken").alias("x")).select(*by, *(f"x.{c}" for c in rest))
