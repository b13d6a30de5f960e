"""Bar files: gzipped CSV by year with a JSON manifest, guards on both, and the exporter that writes them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.config import Params
from quantloom.operators.resample import written

#: Fixed columns of a bar file, in order; times have no zone and a blank or a T before the hours, spreads are whole points.
CSV_SCHEMA = "time TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, tick_volume BIGINT, spread_pts BIGINT"
NAMES = [f.split()[0] for f in CSV_SCHEMA.split(", ")]
TIME, WRITTEN_TIME = "yyyy-MM-dd[' ']['T']HH:mm:ss", "yyyy-MM-dd HH:mm:ss"
MANIFEST_SCHEMA = (
    "schema STRING, phase STRING, symbol STRING, digits INT, point DOUBLE, contract_size DOUBLE, timeframe STRING, "
    "files ARRAY<STRUCT<file: STRING, year: INT, rows: BIGINT, first_bar: STRING, last_bar: STRING, sha256: STRING, bytes: BIGINT, crc32: STRING, dropped_non_increasing: BIGINT>>"
)
RULES_SCHEMA = "rules ARRAY<STRUCT<id: STRING, family: STRING, direction: STRING, conditions: ARRAY<STRUCT<feature: STRING, lo: DOUBLE, hi: DOUBLE, lo_closed: BOOLEAN, hi_closed: BOOLEAN>>>>"


class GuardError(RuntimeError):
    """An input isn't what a study may read."""


@dataclass(frozen=True)
class Phase:
    """What a study may read: years, the first date, and the first year of which no file may lie anywhere near (0: none)."""

    name: str
    years: tuple[int, ...]
    start: str = "0001-01-01"
    locked: int = 0


def year_file(folder: str, year: int, symbol: str = "bars") -> str:
    return f"{folder}/{symbol}_m1_{year}.csv.gz"


# ---- reading


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Bars of the files with the file's name and a sequence that keeps the order within a file. A gzipped file is one task's."""
    head = spark.read.option("header", True).csv(list(paths)).columns
    if missing := [n for n in NAMES if n not in head]:
        raise GuardError(f"columns {missing} are missing")
    schema = ", ".join(next((f for f in CSV_SCHEMA.split(", ") if f.split()[0] == h), f"`{h}` STRING") for h in head)
    x = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("timestampNTZFormat", TIME).csv(list(paths))
    return x.select(*NAMES, F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("seq"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file with the instrument's specification; symbol and contract size have defaults."""
    x = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(f"{folder}/manifest.json")
    x = x.select(F.coalesce("symbol", F.lit("UNKNOWN")).alias("symbol"), "digits", "point", F.coalesce("contract_size", F.lit(100.0)).alias("contract_size"), "phase", F.explode("files").alias("f"))
    return x.select("symbol", "digits", "point", "contract_size", "phase", "f.*")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Frozen rules as rows: rule_id, direction (1 or -1), conds; a null bound is open."""
    x = spark.read.schema(RULES_SCHEMA).option("multiLine", True).json(path).select(F.explode("rules").alias("r"))
    return x.select(F.col("r.id").alias("rule_id"), F.when(F.col("r.direction") == "long", 1).otherwise(-1).alias("direction"), F.col("r.conditions").alias("conds"))


def freeze_rules(rules: DataFrame, path: str) -> None:
    """Write rules (rule_id, family, direction, conds) as one JSON object that read_rules reads; rules are few."""
    each = F.struct(F.col("rule_id").alias("id"), "family", F.when(F.col("direction") == 1, "long").otherwise("short").alias("direction"), F.col("conds").alias("conditions"))
    one = rules.agg(F.sort_array(F.collect_list(each)).alias("rules")).select(F.to_json(F.struct("rules"), {"ignoreNullFields": "false"}).alias("value"))
    _one_file(one, path)


# ---- guards


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """file, sha256, crc32, bytes of every file below the folder."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return x.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.lpad(F.lower(F.hex(F.crc32("content"))), 8, "0").alias("crc32"), F.col("length").alias("bytes"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """file, year of every bar file below the folder; contents aren't read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return x.withColumn("year", F.regexp_extract("file", r"(\d{4})\.csv", 1).try_cast("int")).where("year is not null")


def problems(spark: SparkSession, folder: str, years: list[int], allowed: list[int]) -> DataFrame:
    """year, problem for every year that may not be read, has no entry or file, or a digest that isn't its manifest's."""
    wanted = spark.createDataFrame([(y,) for y in years], "year int")
    x = wanted.join(read_manifest(spark, folder).select("year", "file", F.col("sha256").alias("told")), "year", "left").join(digests(spark, folder), "file", "left")
    text = F.when(~F.col("year").isin(allowed), "forbidden year").when(F.col("file").isNull(), "no entry").when(F.col("sha256").isNull(), "no file").when(F.col("sha256") != F.lower("told"), "digest differs")
    extra = listed(spark, folder).where(~F.col("year").isin(allowed))
    return x.select("year", text.alias("problem")).where("problem is not null").unionByName(extra.select("year", F.lit("forbidden file").alias("problem"))).distinct()


def phase_problems(spark: SparkSession, folder: str, phase: Phase, around: str | None = None) -> DataFrame:
    """year, problem of a whole folder: the manifest's phase and set of years, locked files below around, and problems()."""
    found = [problems(spark, folder, list(phase.years), list(phase.years))]
    entries = read_manifest(spark, folder)
    wrong = entries.where(~F.upper(F.coalesce("phase", F.lit(phase.name))).eqNullSafe(F.lit(phase.name.upper()))).select(F.lit(None).cast("int").alias("year"), F.lit("another phase").alias("problem"))
    expected = spark.createDataFrame([(y,) for y in phase.years], "year int")
    more = entries.select("year").exceptAll(expected).select("year", F.lit("a year too many").alias("problem"))
    found += [wrong, more]
    if phase.locked:
        found.append(listed(spark, around or folder).where(F.col("year") >= phase.locked).select("year", F.lit("locked file").alias("problem")))
    return reduce(DataFrame.unionByName, found).distinct()


def row_problems(spark: SparkSession, folder: str, phase: Phase) -> DataFrame:
    """file, problem, rows for every rule that rows of the manifest's files break, all rows looked at.

    Times lie in the file's year, not before the phase's start, and increase; highs and lows hold the other prices; spreads
    aren't negative; no value is missing; the header is the fixed one; number, first and last of the rows are the manifest's.
    """
    entries = read_manifest(spark, folder).where(F.col("year").isin(list(phase.years)))
    paths = [f"{folder}/{r['file']}" for r in entries.select("file").orderBy("file").collect()]  # a file a year
    x = written(read_csv(spark, *paths), "bar_rows").withColumn("file", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(entries.select("file", "year", "rows", "first_bar", "last_bar")), "file")
    before = F.lag("time").over(Window.partitionBy("file").orderBy("seq"))
    checks = {
        "malformed": reduce(lambda a, b: a | b, (F.col(n).isNull() for n in NAMES)), "outside its year": F.year("time") != F.col("year"), "before the start": F.col("time") < F.lit(phase.start).cast("timestamp_ntz"),
        "not increasing": F.col("time") <= before, "inconsistent": (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("spread_pts") < 0),
    }
    for name, broken in checks.items():
        x = x.withColumn(name, F.coalesce(broken, F.lit(False)))
    counted = x.groupBy("file").agg(*(F.count_if(F.col(f"`{n}`")).alias(n) for n in checks))
    rows = counted.select("file", F.inline(F.array(*(F.struct(F.lit(n).alias("problem"), F.col(f"`{n}`").alias("rows")) for n in checks)))).where("rows > 0")
    text = lambda c: F.date_format(c, WRITTEN_TIME)
    ends = x.groupBy("file").agg(F.count(F.lit(1)).alias("n"), text(F.min_by("time", "seq")).alias("first"), text(F.max_by("time", "seq")).alias("last"))
    ends = entries.select("file", "rows", F.translate("first_bar", "T", " ").alias("first_bar"), F.translate("last_bar", "T", " ").alias("last_bar")).join(ends, "file", "left")
    whole = [("another number of rows", ~F.col("n").eqNullSafe(F.col("rows"))), ("another first or last bar", F.coalesce((F.col("first") != F.col("first_bar")) | (F.col("last") != F.col("last_bar")), F.lit(False)))]
    told = [ends.where(broken).select("file", F.lit(name).alias("problem"), F.coalesce("n", F.lit(0)).alias("rows")) for name, broken in whole]
    heads = [(p.rsplit("/", 1)[1], spark.read.option("header", True).csv(p).columns) for p in paths]
    wrong = [(f, "another header", 1) for f, h in heads if h != NAMES]
    return reduce(DataFrame.unionByName, (*told, spark.createDataFrame(wrong, "file string, problem string, rows bigint")), rows)


def load(spark: SparkSession, folder: str, years: list[int], allowed: list[int], start: str = "0001-01-01") -> DataFrame:
    """Bars of the years after all guards; the rows must be as many as the manifest says, and none before start."""
    if found := problems(spark, folder, years, allowed).collect():
        raise GuardError("; ".join(f"{r['year']}: {r['problem']}" for r in found))
    entries = read_manifest(spark, folder).where(F.col("year").isin(years))
    bars = read_csv(spark, *(f"{folder}/{r['file']}" for r in entries.select("file").collect()))
    early = F.count_if(F.col("time") < F.lit(start).cast("timestamp_ntz"))
    ends = bars.agg(F.count(F.lit(1)).alias("n"), F.min(F.year("time")).alias("low"), F.max(F.year("time")).alias("high"), early.alias("early")).first()
    told = entries.agg(F.sum("rows")).first()[0]
    if ends["n"] != told or ends["n"] and (ends["low"] < min(years) or ends["high"] > max(years)) or ends["early"]:
        raise GuardError(f"{ends['n']} rows of {ends['low']} to {ends['high']}, {ends['early']} before {start}; the manifest has {told}")
    return bars


def load_with_history(spark: SparkSession, folder: str, phase: Phase, history: str, year: int, allowed: list[int]) -> DataFrame:
    """A phase's bars and, before them, a year of another folder's as history; source tells which. Both have one specification."""
    if found := phase_problems(spark, folder, phase).collect():
        raise GuardError("; ".join(f"{r['year']}: {r['problem']}" for r in found))
    specs = [read_manifest(spark, f).select("digits", "point").distinct().collect() for f in (folder, history)]
    if specs[0] != specs[1] or len(specs[0]) != 1:
        raise GuardError(f"the specification changed: {specs[1]}, {specs[0]}")
    old = load(spark, history, [year], allowed).withColumn("source", F.lit("history"))
    return old.unionByName(load(spark, folder, list(phase.years), list(phase.years), phase.start).withColumn("source", F.lit(phase.name)))


def check_frozen(spark: SparkSession, folder: str, sha256: dict[str, str]) -> None:
    """Refuse unless the named files below the folder have the digests that were registered."""
    have = {r["file"]: r["sha256"] for r in digests(spark, folder).where(F.col("file").isin(list(sha256))).collect()}
    if wrong := sorted(f for f, d in sha256.items() if have.get(f) != d):
        raise GuardError(f"not as registered: {', '.join(wrong)}")


def check_params(p: Params, fingerprint: str) -> None:
    """Refuse parameters other than the frozen ones."""
    if p.fingerprint() != fingerprint:
        raise GuardError(f"parameters {p.fingerprint()} aren't the frozen {fingerprint}")


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.format("binaryFile").load(path).limit(1).count() > 0
    except AnalysisException:
        return False


@contextmanager
def once(spark: SparkSession, report: str) -> Iterator[None]:
    """A study that is run one time: refuses if its report is there already."""
    if exists(spark, report):
        raise GuardError(f"{report} exists: this study was run")
    yield


def as_ticks(bars: DataFrame, series: Column) -> DataFrame:
    """Bar rows in the shape of bars: series, t, tc, day, o, h, l, c, tv and spread in points."""
    t = F.floor(F.unix_micros(F.col("time").cast("timestamp")) / 60_000_000).cast("long")
    return bars.select(series.alias("series"), t.alias("t"), (t + 1).alias("tc"), F.floor(t / 1440).alias("day"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("tick_volume").alias("tv"), F.col("spread_pts").alias("spread"))


# ---- writing


def _one_file(one: DataFrame, path: str) -> None:
    """Write a table of one partition as the file path: Spark's only part file, moved."""
    spark = one.sparkSession
    folder = f"{path}.parts"
    if one.columns == ["value"]:
        one.coalesce(1).write.mode("overwrite").text(folder)
    else:
        one.write.mode("overwrite").option("header", True).option("timestampNTZFormat", WRITTEN_TIME).option("compression", "gzip").csv(folder)
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{len(parts)} files instead of one for {path}")
    fs.delete(to, False)
    fs.rename(parts[0], to)
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)


def export(bars: DataFrame, folder: str, years: tuple[int, ...], phase: str, symbol: str = "bars", digits: int = 2, point: float = 0.01, contract_size: float = 100.0) -> None:
    """Bars of the years with increasing times as a gzipped CSV a year, and the manifest that tells their rows, ends, digests and
    how many rows were dropped. load reads the folder."""
    spark = bars.sparkSession
    x = bars.select(*NAMES, "seq", F.year("time").alias("year")).where(F.col("year").isin(list(years)))
    before = F.max("time").over(Window.partitionBy("year").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    x = written(x.withColumn("kept", F.coalesce(F.col("time") > before, F.lit(True))), "export")
    text = lambda c: F.date_format(c, WRITTEN_TIME)
    kept = F.when(F.col("kept"), F.col("time"))
    told = {r["year"]: r for r in x.groupBy("year").agg(F.count(kept).alias("rows"), text(F.min(kept)).alias("first"), text(F.max(kept)).alias("last"), F.count_if(~F.col("kept")).alias("dropped")).collect()}
    for year in sorted(told):
        _one_file(x.where((F.col("year") == year) & F.col("kept")).select(*NAMES).repartition(1).sortWithinPartitions("time"), year_file(folder, year, symbol))
    have = {r["file"]: r for r in digests(spark, folder).collect()}
    files = []
    for year, r in sorted(told.items()):
        name = year_file("", year, symbol)[1:]
        d = have[name]
        files.append({"file": name, "year": year, "rows": r["rows"], "first_bar": r["first"], "last_bar": r["last"], "sha256": d["sha256"], "bytes": d["bytes"], "crc32": d["crc32"], "dropped_non_increasing": r["dropped"]})
    manifest = {"schema": "bars.v1", "phase": phase, "symbol": symbol, "digits": digits, "point": point, "contract_size": contract_size, "timeframe": "M1", "columns": NAMES, "files": files}
    _one_file(spark.createDataFrame([(json.dumps(manifest),)], "value string"), f"{folder}/manifest.json")


def append_ledger(spark: SparkSession, path: str, records: list[dict]) -> None:
    """Add trials to the append-only ledger of JSON lines."""
    spark.createDataFrame([(r["trial"], r["verdict"], r["fingerprint"]) for r in records], "trial string, verdict string, fingerprint string").coalesce(1).write.mode("append").json(path)
