"""Events at the previous day's last close: touches, rejections, breaks, retests and failed breaks, and their trades.

Everything happens between a day's resume time and its flat time, so events, fills and exits are looked up in the day's own
bars: as windows where all bars are marked at once, as an array of the day's bars where one event looks ahead, and as an
aggregation over an event's later bars where stops and targets are told. A day has 1440 bars at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.config import Params
from quantloom.functions.rules import bucket
from quantloom.functions.time import DAY, minute_of_day
from quantloom.operators.bars import atr, by_day, by_time, days
from quantloom.operators.resample import day_bootstrap, drawdown, max_statistic_p, null_best

#: Later than any minute: a level that isn't free again, a stop that isn't reached.
NEVER = 1 << 60


def levels(base: DataFrame, excluded: DataFrame) -> DataFrame:
    """series, day, level: the last close of the trading day before, which may be excluded itself; days that are are left out."""
    x = days(base).select("series", "day", F.lag("c").over(by_time("day")).alias("level")).where("level is not null")
    return x.join(excluded.select("series", "day"), ["series", "day"], "left_anti")


def context(base: DataFrame, resume: DataFrame, excluded: DataFrame, p: Params) -> DataFrame:
    """Levels of days with a bar that closes after the resume time and by flat: series, day, level, from_tc, until."""
    x = levels(base, excluded).join(resume.select("series", "day", "resume"), ["series", "day"])
    x = x.withColumn("from_tc", F.col("day") * DAY + F.col("resume")).withColumn("until", F.col("day") * DAY + p.flat)
    last = base.where(F.col("tc") <= F.col("day") * DAY + p.flat).groupBy("series", "day").agg(F.max("tc").alias("last_tc"))
    return x.join(last, ["series", "day"]).where("last_tc > from_tc").drop("last_tc", "resume")


def marked(signal: DataFrame, ctx: DataFrame, p: Params) -> DataFrame:
    """Signal bars of the context's days by band: a0, the average true range before the bar; band, so many of them; side, that
    of the latest close before that lies outside the band, or the day's open's; end_t and end_tc, the window's last bar's;
    next, the window's bars."""
    x = atr(signal, p.atr_period).withColumn("a0", F.lag("atr").over(by_time())).join(ctx, ["series", "day"])
    before, window = by_day().rowsBetween(Window.unboundedPreceding, -1), by_day().rowsBetween(0, p.level_window)
    x = x.withColumn("n", F.row_number().over(by_day())).withColumn("closes", F.collect_list("c").over(before))
    x = x.withColumn("opened", F.first("o").over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("end_t", F.last("last_t").over(window)).withColumn("end_tc", F.last("tc").over(window))
    x = x.withColumn("next", F.collect_list(F.struct("tc", "c", "l", "ask_high", "spread")).over(by_day().rowsBetween(1, p.level_window)))
    x = x.withColumn("d", F.explode(F.array(*map(F.lit, p.bands)))).withColumn("band", F.col("d") * F.col("a0"))
    level = F.col("level")
    outside = F.try_element_at(F.filter("closes", lambda c: F.abs(c - level) > F.col("band")), F.lit(-1))
    return x.withColumn("side", F.signum(F.coalesce(outside, F.col("opened")) - level).cast("int")).drop("closes", "opened")


#: An event and the position that it leads to; where there is none (dir is null), only busy tells how long it is waited for.
EVENT = ("series", "day", "t", "tc", "bars", "variant", "level", "approach", "a0", "dir", "entry", "flip", "entry_tc", "path_t", "fill_t", "struct", "known", "busy", "until")


def _in_hours(x: DataFrame, p: Params) -> DataFrame:
    return x.where((F.col("tc") > F.col("from_tc")) & (F.col("tc") < F.col("day") * DAY + p.last_entry) & F.col("a0").isNotNull())


def _named(family: str) -> Column:
    """The family with its band, as short as it can be written."""
    return F.concat(F.lit(f"{family}("), F.regexp_replace(F.col("d").cast("string"), r"\.0$", ""), F.lit(")"))


def _event(x: DataFrame, variant: Column, **columns: Column) -> DataFrame:
    none = {"fill_t": F.lit(None).cast("long"), "known": F.lit(False), "approach": F.col("side").cast("long"), "variant": variant}
    made = {**none, **columns}
    return x.select(*(made[c].alias(c) if c in made else F.col(c) for c in EVENT))


def _at_close(direction: Column, close: Column, spread: Column) -> dict[str, Column]:
    """Longs pay the ask; the position the other way round pays the other price."""
    return {"dir": direction, "entry": F.when(direction == 1, close + spread).otherwise(close), "flip": F.when(direction == 1, close).otherwise(close + spread)}


def rejections(bars: DataFrame, p: Params) -> DataFrame:
    """Bars that reach the level and close on the side they came from: trade away from it at the close."""
    up, down, level = F.col("side") == 1, F.col("side") == -1, F.col("level")
    hit = (up & (F.col("ask_low") <= level) & (F.col("c") > level)) | (down & (F.col("h") >= level) & (F.col("c") < level))
    x = _in_hours(bars.where("d = 0"), p).where(hit)
    return _event(x, F.lit("R2"), **_at_close(F.col("side"), F.col("c"), F.col("spread")), entry_tc=F.col("tc"), path_t=F.col("last_t") + 1, struct=F.when(up, F.col("l")).otherwise(F.col("ask_high")), busy=F.col("tc"))


def broken(bars: DataFrame, p: Params) -> DataFrame:
    """Closes beyond the level by more than the band, from the other side."""
    hit = ((F.col("side") == 1) & (F.col("c") < F.col("level") - F.col("band"))) | ((F.col("side") == -1) & (F.col("c") > F.col("level") + F.col("band")))
    return _in_hours(bars, p).where(hit)


def breaks(bars: DataFrame, p: Params) -> DataFrame:
    """Breaks: trade on in their direction at the close."""
    stop = F.when(F.col("side") == 1, F.col("ask_high")).otherwise(F.col("l"))
    return _event(broken(bars, p), _named("B"), **_at_close(-F.col("side"), F.col("c"), F.col("spread")), entry_tc=F.col("tc"), path_t=F.col("last_t") + 1, struct=stop, busy=F.col("tc"))


def _day_bars(base: DataFrame) -> DataFrame:
    """series, day and the day's bars in order."""
    return base.groupBy("series", "day").agg(F.sort_array(F.collect_list(F.struct("t", "tc", "o", "h", "l", "c", "spread"))).alias("path"))


def retests(bars: DataFrame, base: DataFrame, p: Params) -> DataFrame:
    """Breaks after which a base bar comes back to the level within the window: a limit order there fills, on in the break's
    direction. It is waited for until then, or to the window's end."""
    x = broken(bars, p).join(_day_bars(base), ["series", "day"])
    level, down = F.col("level"), F.col("side") == 1
    back = lambda b: F.when(down, b["h"] >= level).otherwise(b["l"] + b["spread"] <= level)
    within = lambda b: (b["t"] > F.col("last_t")) & (b["t"] <= F.col("end_t")) & (b["t"] < F.col("day") * DAY + p.last_entry)
    x = x.withColumn("f", F.try_element_at(F.filter("path", lambda b: within(b) & back(b)), F.lit(1)))
    some = lambda c: F.when(F.col("f").isNotNull(), c)
    stop = F.when(down, F.col("ask_high")).otherwise(F.col("l"))
    return _event(x, _named("BR"), dir=some(-F.col("side")), entry=some(level), flip=some(level), entry_tc=F.col("f.tc"), path_t=F.col("f.t"), fill_t=F.col("f.t"), struct=some(stop), known=F.lit(True), busy=F.coalesce("f.tc", "end_tc"))


def failures(bars: DataFrame, p: Params) -> DataFrame:
    """Breaks after which a signal bar closes back on the other side within the window: trade against the break, with the
    extreme since the break as the structural stop. It is waited for until then, or to the window's end."""
    level, down = F.col("level"), F.col("side") == 1
    back = lambda b: F.when(down, b["c"] > level).otherwise(b["c"] < level) & (b["tc"] < F.col("day") * DAY + p.last_entry)
    x = broken(bars, p).withColumn("f", F.try_element_at(F.filter("next", back), F.lit(1)))
    since = F.filter("next", lambda b: b["tc"] <= F.col("f.tc"))
    low, high = F.array_min(F.transform(since, lambda b: b["l"])), F.array_max(F.transform(since, lambda b: b["ask_high"]))
    some = {k: F.when(F.col("f").isNotNull(), v) for k, v in _at_close(F.col("side"), F.col("f.c"), F.col("f.spread")).items()}
    stop = F.when(F.col("f").isNull(), None).when(down, F.least(F.col("l"), low)).otherwise(F.greatest(F.col("ask_high"), high))
    # the path begins with the first base bar after the signal bar, which no base bar reaches over
    return _event(x, _named("F"), **some, entry_tc=F.col("f.tc"), path_t=F.col("f.tc"), struct=stop, busy=F.coalesce("f.tc", "end_tc"))


def touches(base: DataFrame, bars: DataFrame, ctx: DataFrame, p: Params) -> DataFrame:
    """The base bars that reach the level, by the ask from above and the bid from below: a limit order there fills.

    The side and the range are those of the last signal bar that had closed; before the day's first one, the day's open's and
    that of the last signal bar of the day before.
    """
    own = bars.where("d = 0").groupBy("series", "day").agg(F.sort_array(F.collect_list(F.struct("tc", "c", "atr"))).alias("closed"), F.min_by("a0", "t").alias("first_a"), F.first("bars").alias("bars"))
    opened = F.first("o").over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    x = base.withColumn("opened", opened).join(ctx, ["series", "day"]).join(own, ["series", "day"])
    x = x.where((F.col("t") >= F.col("from_tc")) & (F.col("t") < F.col("day") * DAY + p.last_entry))
    level = F.col("level")
    x = x.withColumn("seen", F.filter("closed", lambda b: b["tc"] <= F.col("t")))
    off = F.try_element_at(F.filter("seen", lambda b: b["c"] != level), F.lit(-1))["c"]
    x = x.withColumn("side", F.signum(F.coalesce(off, F.col("opened")) - level).cast("int"))
    x = x.withColumn("a0", F.when(F.size("seen") > 0, F.try_element_at("seen", F.lit(-1))["atr"]).otherwise(F.col("first_a"))).where("a0 is not null")
    hit = ((F.col("side") == 1) & (F.col("l") + F.col("spread") <= level)) | ((F.col("side") == -1) & (F.col("h") >= level))
    stop = F.when(F.col("side") == 1, F.col("l")).otherwise(F.col("h") + F.col("spread"))
    return _event(x.where(hit), F.lit("R1"), dir=F.col("side"), entry=level, flip=level, entry_tc=F.col("tc"), path_t=F.col("t"), fill_t=F.col("t"), struct=stop, busy=F.col("tc"))


def events(base: DataFrame, signal: DataFrame, ctx: DataFrame, p: Params, length: int) -> DataFrame:
    """All variants' events on signal bars of a length, with rearm: when a signal bar first closes far enough from the level."""
    x = marked(signal, ctx, p).withColumn("bars", F.lit(length))
    parts = (touches(base, x, ctx, p), rejections(x, p), breaks(x, p), retests(x, base, p), failures(x, p))
    closes = x.where("d = 0").groupBy("series", "day").agg(F.sort_array(F.collect_list(F.struct("tc", "c"))).alias("closes"))
    out = reduce(DataFrame.unionByName, parts).join(closes, ["series", "day"])
    far = F.filter("closes", lambda b: (b["tc"] > F.col("tc")) & (F.abs(b["c"] - F.col("level")) >= p.rearm * F.col("a0")))
    return out.select(*EVENT, F.coalesce(F.try_element_at(far, F.lit(1))["tc"], F.lit(NEVER)).alias("rearm"))


def stop_name(s: float | None) -> str:
    return "Sstruct" if s is None else f"S{s:g}"


def simulated(found: DataFrame, base: DataFrame, p: Params) -> DataFrame:
    """A row for each event with a position, stop and target: exit_tc, reason (1 stop, 2 target, 0 end of day), conflict, r,
    usd, and r_flip of the position the other way round. found has eid, a number for each event.

    The target lies k times what the stop risks from the entry, costs included. The stop wins over a target in one bar and
    fills at the open if that is beyond it; targets fill at their price. In the bar in which a limit order fills, the open
    and the target don't count, and the stop only if it was known before. An event without a bar left gives no row.
    """
    stops = [*p.level_stops, None]
    x = found.where("dir is not null").join(base.select("series", "day", *(F.col(c).alias(f"b_{c}") for c in ("t", "tc", "o", "h", "l", "c", "spread"))), ["series", "day"])
    x = x.where((F.col("b_t") >= F.col("path_t")) & (F.col("b_tc") <= F.col("until")))
    least = F.greatest((F.col("entry") - F.col("struct")) * F.col("dir"), p.struct_floor * F.col("a0"))
    kinds = [F.struct(F.lit(stop_name(s)).alias("stop"), (least if s is None else s * F.col("a0")).alias("dist"), (F.col("known") if s is None else F.lit(True)).alias("in_fill")) for s in stops]
    x = x.withColumn("s", F.explode(F.array(*kinds))).select("*", "s.*").drop("s")
    filling = F.coalesce(F.col("b_t") == F.col("fill_t"), F.lit(False))
    made, shown = [], []
    for name, direction, entry in (("", F.col("dir"), F.col("entry")), ("_flip", -F.col("dir"), F.col("flip"))):
        cost = 2 * p.rate * entry
        unit = F.col("dist") + cost
        price = lambda c, direction=direction: F.when(direction == 1, F.col(f"b_{c}")).otherwise(F.col(f"b_{c}") + F.col("b_spread"))
        stop = entry - direction * F.col("dist")
        beyond = lambda c, stop=stop, direction=direction, price=price: (price(c) - stop) * direction <= 0
        reached = F.when(direction == 1, beyond("l")).otherwise(beyond("h"))
        stopped = F.when(reached & (~filling | F.col("in_fill")), F.col("b_tc"))
        at = F.when(beyond("o") & ~filling, price("o")).otherwise(stop)
        made += [F.min(stopped).alias(f"stop_tc{name}"), F.min_by(F.when(stopped.isNotNull(), at), stopped).alias(f"stop_px{name}"), F.max_by(price("c"), "b_tc").alias(f"last_px{name}"), F.max("b_tc").alias(f"last_tc{name}")]
        for k in p.level_targets:
            target = entry + direction * (k * unit + cost)
            hit = F.when(direction == 1, price("h") >= target).otherwise(price("l") <= target)
            made.append(F.min(F.when(hit & ~filling, F.col("b_tc"))).alias(f"target_tc{name}_{k}"))
    rows = x.groupBy("eid", "stop", "dist", "dir", "entry", "flip").agg(*made)
    for k in p.level_targets:
        result = {}
        for name, direction, entry in (("", F.col("dir"), F.col("entry")), ("_flip", -F.col("dir"), F.col("flip"))):
            cost = 2 * p.rate * entry
            unit = F.col("dist") + cost
            stop_tc, target_tc = F.coalesce(f"stop_tc{name}", F.lit(NEVER)), F.coalesce(f"target_tc{name}_{k}", F.lit(NEVER))
            reason = F.when((stop_tc < NEVER) & (stop_tc <= target_tc), 1).when(target_tc < NEVER, 2).otherwise(0)
            exit_tc = F.when(reason == 0, F.col(f"last_tc{name}")).otherwise(F.least(stop_tc, target_tc))
            price = F.when(reason == 1, F.col(f"stop_px{name}")).when(reason == 2, entry + direction * (k * unit + cost)).otherwise(F.col(f"last_px{name}"))
            net = (price - entry) * direction - cost
            result |= {f"exit_tc{name}": exit_tc, f"reason{name}": reason, f"conflict{name}": (reason == 1) & (stop_tc == target_tc), f"usd{name}": net, f"r{name}": net / unit}
        shown.append(F.struct(F.lit(k).alias("k"), *(result[c].alias(c) for c in ("exit_tc", "reason", "conflict", "usd", "r", "r_flip"))))
    return rows.select("eid", "stop", F.explode(F.array(*shown)).alias("x")).select("eid", "stop", "x.*")


def accepted(found: DataFrame, results: DataFrame, p: Params) -> DataFrame:
    """Trades of each configuration: bars, variant, stop and target. Its events of a day are walked in order: one that begins
    before the last accepted one's position is closed, its wait has ended and the level is free again is passed over; test_no
    numbers the accepted ones, those without a position included. A fold has a day's events at most."""
    stops = F.explode(F.array(*(F.lit(stop_name(s)) for s in (*p.level_stops, None)))).alias("stop")
    every = found.select("*", stops).select("*", F.explode(F.array(*map(F.lit, p.level_targets))).alias("k")).join(results, ["eid", "stop", "k"], "left")
    every = every.withColumn("config", F.concat(F.lit("M"), "bars", F.lit("_"), "variant", F.lit("_"), "stop", F.lit("_k"), "k"))
    shown = ["t", "tc", "bars", "variant", "stop", "k", "level", "approach", "a0", "dir", "entry", "entry_tc", "exit_tc", "reason", "conflict", "usd", "r", "r_flip", "rearm", "busy"]
    row = F.struct(*shown)
    kind = every.select(F.array(row).alias("x")).schema["x"].dataType.simpleString()
    start = F.struct(F.lit(-NEVER).alias("ready"), F.array().cast(kind).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        ready = F.greatest(x["busy"], F.coalesce(x["exit_tc"], x["busy"]), x["rearm"])
        return F.when(x["t"] >= acc["ready"], F.struct(ready.alias("ready"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    folded = every.groupBy("config", "series", "day").agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step, lambda acc: acc["taken"]).alias("taken"))
    out = folded.select("config", "series", "day", F.posexplode("taken").alias("n", "x")).where("x.exit_tc is not null")
    return out.select("config", "series", "day", *(f"x.{c}" for c in shown), (F.col("n") + 1).cast("long").alias("test_no"))


def _summary() -> list[Column]:
    won, lost = F.when(F.col("r") > 0, F.col("r")), F.when(F.col("r") <= 0, F.col("r"))
    return [F.count(F.lit(1)).alias("trades"), F.avg("r").alias("mean_r"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.avg(won).alias("avg_win"), F.avg(lost).alias("avg_loss")]


def splits(trades: DataFrame, p: Params, period: Column) -> DataFrame:
    """The summary of each configuration: overall, and by period, approach, test number (4 and more as one) and part of the day."""
    test, part = F.least("test_no", F.lit(4)).cast("long"), bucket(minute_of_day(F.col("entry_tc")), list(p.hours)).cast("long")
    x = trades.select("config", "r", period.alias("period"), "approach", test.alias("test"), part.alias("session"))
    sets = [[F.col("config")], *([F.col("config"), F.col(c)] for c in ("period", "approach", "test", "session"))]
    return x.groupingSets(sets, "config", "period", "approach", "test", "session").agg(*_summary())


def heatmap(trades: DataFrame, p: Params) -> DataFrame:
    """Mean result by bars, variant and target, a column for each stop, whose points are underscores there."""
    names = [stop_name(s) for s in (*p.level_stops, None)]
    return trades.groupBy("bars", "variant", "k").pivot("stop", names).agg(F.avg("r")).withColumnsRenamed({n: n.replace(".", "_") for n in names})


def results_table(trades: DataFrame, weights: DataFrame, null: DataFrame, p: Params, period: Column) -> DataFrame:
    """A row for each configuration with a trade: summary, bootstrap bounds, p against the best of each null run, drawdown,
    share of conflicts, and the fewest trades and least mean of a period."""
    whole = trades.groupBy("config").agg(*_summary(), F.avg(F.col("conflict").cast("double")).alias("conflict_share"), F.avg("usd").alias("mean_usd"))
    boot = day_bootstrap(trades, weights, ["config"], "r", p.alpha).select("config", "lower")
    against = max_statistic_p(whole.select("config", F.col("mean_r").alias("mean")), null_best(null), ["config"]).select("config", "p_max")
    fall = drawdown(trades, ["config"], "r", ["entry_tc", "series"]).select("config", "drawdown")
    parts = trades.withColumn("period", period).groupBy("config", "period").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"))
    parts = parts.groupBy("config").agg(F.count(F.lit(1)).alias("periods"), F.min("n").alias("min_trades"), F.min("m").alias("min_mean"))
    return reduce(lambda a, b: a.join(b, "config"), (boot, against, fall, parts), whole)


def verdict(table: DataFrame, periods: int, least: int, good: float = 0.05, fair: float = 0.10) -> DataFrame:
    """The table with passes, weak and the verdict over all rows: PASS if a configuration gains in each of so many periods,
    its lower bound is over 0, its p under good and its trades in each period are least or more; WEAK if one gains in each
    period and its p is under fair; else STOP."""
    gains = (F.col("periods") == periods) & (F.col("min_mean") > 0)
    x = table.withColumn("passes", F.coalesce(gains & (F.col("lower") > 0) & (F.col("p_max") < good) & (F.col("min_trades") >= least), F.lit(False)))
    x = x.withColumn("weak", ~F.col("passes") & F.coalesce(gains & (F.col("p_max") < fair), F.lit(False)))
    every = Window.partitionBy(F.lit(0))  # a row for each configuration
    return x.withColumn("verdict", F.when(F.max("passes").over(every), "PASS").when(F.max("weak").over(every), "WEAK").otherwise("STOP"))
