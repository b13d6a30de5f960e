"""Interval conditions and rules, as expressions over columns and as rows of a table. A bound that is missing is open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Conditions of a rule as a column; the names of the fields are those of the files that rules are frozen in.
CONDS = "array<struct<feature:string,lo:double,hi:double,lo_closed:boolean,hi_closed:boolean>>"


@dataclass(frozen=True)
class Interval:
    """Values of a feature from low to high; low_in and high_in tell whether a bound belongs to it."""

    feature: str
    low: float | None = None
    high: float | None = None
    low_in: bool = True
    high_in: bool = False

    def holds(self) -> Column:
        """False for a missing value, unless both bounds are missing."""
        value, inside = F.col(self.feature), F.lit(True)
        for bound, sign, included in ((self.low, 1, self.low_in), (self.high, -1, self.high_in)):
            if bound is not None:
                reach = F.signum((value - F.lit(float(bound))) * sign)
                inside = inside & (reach >= 0 if included else reach > 0)
        return F.coalesce(inside, F.lit(False))

    def struct(self) -> Column:
        return interval(F.lit(self.feature), F.lit(self.low), F.lit(self.high), self.low_in, self.high_in)


def interval(feature: Column, low: Column, high: Column, low_in: bool = True, high_in: bool = False) -> Column:
    """A condition as a struct of CONDS."""
    return F.struct(feature.alias("feature"), low.cast("double").alias("lo"), high.cast("double").alias("hi"), F.lit(low_in).alias("lo_closed"), F.lit(high_in).alias("hi_closed"))


@dataclass(frozen=True)
class Rule:
    """A side, 1 or -1, taken where all conditions hold; without a condition, always."""

    rule_id: str
    side: int
    within: tuple[Interval, ...] = ()

    def holds(self) -> Column:
        return F.forall(F.array(F.lit(True), *(i.holds() for i in self.within)), lambda ok: ok)

    def struct(self) -> Column:
        conds = F.array(*(i.struct() for i in self.within)).cast(CONDS)
        return F.struct(F.lit(self.rule_id).alias("rule_id"), F.lit(self.side).alias("direction"), conds.alias("conds"))


def table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rule_id, direction, conds: a row for each rule."""
    return spark.range(1).select(F.inline(F.array(*(r.struct() for r in rules))))


def from_rows(rows: DataFrame) -> list[Rule]:
    """Rules of a table of few rows, those of a report or a frozen file, as objects."""
    rows = rows.select("rule_id", "direction", "conds").orderBy("rule_id").collect()
    return [Rule(r["rule_id"], r["direction"], tuple(Interval(*c) for c in r["conds"])) for r in rows]


def described(conds: Column) -> Column:
    """Conditions as text, in the notation of intervals; `always` for none."""

    def one(c: Column) -> Column:
        low = F.when(c["lo"].isNull(), F.lit("(-inf")).otherwise(F.concat(F.when(c["lo_closed"], F.lit("[")).otherwise(F.lit("(")), F.format_string("%.4f", c["lo"])))
        high = F.when(c["hi"].isNull(), F.lit("inf)")).otherwise(F.concat(F.format_string("%.4f", c["hi"]), F.when(c["hi_closed"], F.lit("]")).otherwise(F.lit(")"))))
        return F.format_string("%s in %s, %s", c["feature"], low, high)

    return F.when(F.size(conds) > 0, F.array_join(F.transform(conds, one), " and ")).otherwise(F.lit("always"))


def holds(conds: Column, values: Column) -> Column:
    """Whether all conditions hold for a map from feature to value; a missing value fulfils none that has a bound."""

    def one(c: Column) -> Column:
        v = F.try_element_at(values, c["feature"])
        low = c["lo"].isNull() | F.when(c["lo_closed"], v >= c["lo"]).otherwise(v > c["lo"])
        high = c["hi"].isNull() | F.when(c["hi_closed"], v <= c["hi"]).otherwise(v < c["hi"])
        return F.coalesce(low & high, F.lit(False))

    return F.forall(conds, one)


def _firing(rules: list[Rule]) -> Column:
    """rule_id and side of the rules that hold for a row."""
    each = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.side).alias("side"), r.holds().alias("on")) for r in rules))
    return F.filter(each, lambda r: r["on"])


def direction(rules: list[Rule]) -> Column:
    """The side on which all rules that hold agree; 0 if none holds or they differ."""
    sides = F.array_distinct(F.transform(_firing(rules), lambda r: r["side"]))
    return F.when(F.size(sides) == 1, F.try_element_at(sides, F.lit(1))).otherwise(0)


def hits(rows: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """A row for each rule and row on which the rule holds and all that hold agree."""
    x = rows.withColumn("dir", direction(rules)).where("dir <> 0")
    return x.select(*keep, "dir", F.explode(_firing(rules)).alias("r")).select(*keep, "dir", "r.rule_id")


def top_hits(found: DataFrame, n: int = 25) -> DataFrame:
    """The n rules with most hits, of equal ones the first by name: a report's table."""
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "rule_id").limit(n)


def bucket(x, edges: list[float]) -> Column:
    """Number of the fixed edges at or below x."""
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= x))
