"""Files and their guards, live bars, reports, and the registry."""

import gzip
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantloom.config import DEFAULT, MINUTE
from quantloom.functions.rules import Interval, Rule, from_rows, table
from quantloom.plans import catalog, report
from quantloom.sources import files
from quantloom.streaming.bars import live_bars

HEAD = "time,open,high,low,close,tick_volume,spread_pts\n"


@pytest.fixture
def folder(tmp_path):
    entries = []
    for year in (2021, 2022):
        text = HEAD + "".join(f"{year}-03-0{d}T10:00:00,1,2,0.5,1.5,10,20\n" for d in (1, 2, 3))
        data = gzip.compress(text.encode(), mtime=0)
        (tmp_path / f"bars_m1_{year}.csv.gz").write_bytes(data)
        entries.append({"file": f"bars_m1_{year}.csv.gz", "year": year, "rows": 3, "sha256": hashlib.sha256(data).hexdigest()})
    (tmp_path / "manifest.json").write_text(json.dumps({"digits": 2, "point": 0.01, "files": entries}))
    return str(tmp_path)


def test_load(spark, folder):
    assert files.load(spark, folder, [2021, 2022], [2021, 2022]).count() == 6
    spec = files.read_manifest(spark, folder).first()
    assert (spec.symbol, spec.contract_size) == ("UNKNOWN", 100.0)
    x = files.as_ticks(files.load(spark, folder, [2021], [2021, 2022]), F.lit("x")).orderBy("t").first()
    assert (x.c, x.spread, x.t % 1440) == (1.5, 20, 600)


def test_guards(spark, folder):
    problem = lambda years, allowed: {r.problem for r in files.problems(spark, folder, years, allowed).collect()}
    assert problem([2021], [2021]) == {"forbidden file"}
    assert problem([2023], [2021, 2022]) == {"forbidden year"}
    assert problem([2021, 2024], [2021, 2022, 2024]) == {"no entry"}
    data = bytearray(Path(folder, "bars_m1_2021.csv.gz").read_bytes())
    data[20] ^= 1
    Path(folder, "bars_m1_2021.csv.gz").write_bytes(bytes(data))
    assert problem([2021], [2021, 2022]) == {"digest differs"}
    with pytest.raises(files.GuardError):
        files.load(spark, folder, [2021], [2021, 2022])


def test_missing_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,open\n2021-01-01T00:00:00,1\n")
    with pytest.raises(files.GuardError):
        files.read_csv(spark, str(tmp_path / "a.csv"))


def test_times_with_a_blank(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "2021-03-01 10:00:00,1,2,0.5,1.5,10,20\n2021-03-01T10:01:00,1,2,0.5,1.5,10,20\n")
    assert [str(r.time) for r in files.read_csv(spark, str(tmp_path / "a.csv")).orderBy("seq").collect()] == ["2021-03-01 10:00:00", "2021-03-01 10:01:00"]


def test_export_and_load(spark, folder, tmp_path):
    x = files.read_csv(spark, files.year_file(folder, 2021), files.year_file(folder, 2022))
    files.export(x.union(x.withColumn("seq", F.col("seq") + (1 << 40))), out := str(tmp_path / "out"), (2021, 2022), "one")
    entries = {r.year: r for r in files.read_manifest(spark, out).collect()}
    assert [(entries[y].rows, entries[y].dropped_non_increasing, entries[y].first_bar) for y in (2021, 2022)] == [(3, 3, f"{y}-03-01 10:00:00") for y in (2021, 2022)]
    phase = files.Phase("one", (2021, 2022), "2021-01-01")
    assert files.phase_problems(spark, out, phase).count() == 0 and files.row_problems(spark, out, phase).count() == 0
    again = files.load(spark, out, [2021, 2022], [2021, 2022], "2021-01-01")
    assert sorted(map(tuple, again.select(*files.NAMES).collect())) == sorted(map(tuple, x.select(*files.NAMES).collect()))
    with pytest.raises(files.GuardError, match="before"):
        files.load(spark, out, [2021, 2022], [2021, 2022], "2021-03-02")


def test_phases(spark, folder, tmp_path):
    x = files.read_csv(spark, files.year_file(folder, 2021), files.year_file(folder, 2022))
    files.export(x, old := str(tmp_path / "all" / "old"), (2021,), "one")
    files.export(x, new := str(tmp_path / "all" / "new"), (2022,), "two")
    phase = files.Phase("two", (2022,), "2022-01-01", 2023)
    both = files.load_with_history(spark, new, phase, old, 2021, [2021])
    assert sorted(r.source for r in both.collect()) == ["history"] * 3 + ["two"] * 3
    problem = lambda phase: {r.problem for r in files.phase_problems(spark, new, phase, str(tmp_path / "all")).collect()}
    assert problem(files.Phase("other", (2022,))) == {"another phase"} and problem(files.Phase("two", (2022,), locked=2022)) == {"locked file"}
    assert problem(files.Phase("two", (2021,))) >= {"a year too many", "no entry", "forbidden file"}
    files.export(x, other := str(tmp_path / "other"), (2021,), "one", point=0.1)
    with pytest.raises(files.GuardError, match="specification"):
        files.load_with_history(spark, new, phase, other, 2021, [2021])


def test_row_problems(spark, tmp_path):
    bad = "2021-03-02 10:00:00,1,0.5,0.4,0.9,10,20\n2021-03-01 10:00:00,1,2,0.5,1.5,10,-1\n2020-03-01 10:00:00,1,2,0.5,1.5,x,1\n"
    (tmp_path / "bars_m1_2021.csv.gz").write_bytes(gzip.compress((HEAD + bad).encode()))
    (tmp_path / "manifest.json").write_text(json.dumps({"files": [{"file": "bars_m1_2021.csv.gz", "year": 2021, "rows": 4, "first_bar": "a", "last_bar": "b"}]}))
    found = {r.problem: r.rows for r in files.row_problems(spark, str(tmp_path), files.Phase("one", (2021,), "2021-01-01")).collect()}
    assert found == {"malformed": 1, "outside its year": 1, "before the start": 1, "not increasing": 2, "inconsistent": 2, "another number of rows": 3, "another first or last bar": 3}


def test_frozen_guards(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    files.check_frozen(spark, str(tmp_path), {"a.json": hashlib.sha256(b"{}").hexdigest()})
    for wrong in ({"a.json": "0"}, {"b.json": "0"}):
        with pytest.raises(files.GuardError, match="registered"):
            files.check_frozen(spark, str(tmp_path), wrong)
    files.check_params(DEFAULT, DEFAULT.fingerprint())
    with pytest.raises(files.GuardError):
        files.check_params(MINUTE, DEFAULT.fingerprint())


def test_ledger(spark, tmp_path):
    for verdict in ("STOP", "WEAK"):
        files.append_ledger(spark, str(tmp_path / "ledger"), [{"trial": "a", "verdict": verdict, "fingerprint": DEFAULT.fingerprint()}])
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2


def test_rules_file(spark, tmp_path):
    rules = [Rule("a", 1, (Interval("x", None, 2.0), Interval("y", 0.5, None, False, True))), Rule("b", -1)]
    files.freeze_rules(table(spark, rules).withColumn("family", F.lit("M3")), str(tmp_path / "r.json"))
    assert from_rows(files.read_rules(spark, str(tmp_path / "r.json"))) == rules
    told = json.loads((tmp_path / "r.json").read_text())["rules"][0]
    assert told["direction"] == "long" and told["conditions"][0] == {"feature": "x", "lo": None, "hi": 2.0, "lo_closed": True, "hi_closed": False}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 10:{i % 60:02d}:00", "ab"[i % 2], float(i), i) for i in range(120)]
    ticks = spark.createDataFrame(rows + rows[:5], "event_id long, at string, series string, value double, points long").withColumn("ts", F.to_timestamp("at")).drop("at")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    query = live_bars(stream, 15).writeStream.format("memory").queryName("live").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("live").collect()) == sorted(live_bars(ticks, 15).collect())


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0, 1.0, None)], "t long, o double, h double, l double, c double").withColumn("c", F.lit(2.5))
    assert report.markdown(df).splitlines()[2] == "| 1 | 2 | 3 | 1 | 2.5 |" and json.loads(report.to_json(df))[0]["h"] == 3
    chart = report.candles(df, "a<b", [("entry", 1, 2.2)])
    assert chart.count("<rect") == 1 and "a&lt;b" in chart and "entry" in chart and report.candles(df.where("false"), "x").count("<rect") == 0
    odd = df.withColumn("o", F.lit(float("nan")))
    assert json.loads(report.to_json(odd))[0]["o"] is None
    assert report.heat(df.withColumn("l", F.lit(None).cast("double")), "t", ["o", "l"], "x").count("<rect") == 2
    assert [r.t for r in report.around(spark.range(20).selectExpr("'s' AS series", "id AS t"), "s", 10, 2).orderBy("t").collect()] == [8, 9, 10, 11, 12]
    report.write(spark, str(tmp_path / "study"), "first", "STOP", {"bars": odd}, DEFAULT, {"chart": chart})
    told = json.loads((tmp_path / "study" / "report.json").read_text())
    assert told["verdict"] == "STOP" and told["tables"]["bars"][0]["o"] is None and "# first" in (tmp_path / "study" / "report.md").read_text()
    assert spark.read.json(str(tmp_path / "ledger")).first().trial == "first"
    with pytest.raises(files.GuardError, match="was run"):
        report.write(spark, str(tmp_path / "study"), "first", "STOP", {"bars": odd}, DEFAULT)
    with pytest.raises(ValueError, match="more than"):
        report.rows(spark.range(report.MOST + 1))


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    got = entry.entry(spark)
    assert got.columns == ["horizon", "side", "trades", "days", "mean_net", "win_rate"] and got.count() > 0
