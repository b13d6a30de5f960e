"""Small result tables as Markdown, JSON and SVG charts; only tables of a fixed number of rows come here."""

from __future__ import annotations

import json
import math
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.config import Params
from quantloom.sources.files import _one_file, append_ledger, once

MOST = 1000


def rows(df: DataFrame) -> list[dict]:
    """The rows of a report's table, of which there are MOST at most."""
    found = [r.asDict(recursive=True) for r in df.limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError(f"a report's table has more than {MOST} rows")
    return found


def shown(value) -> str:
    return "-" if value is None else f"{value:.4g}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame) -> str:
    found = rows(df)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(shown(r[c]) for c in df.columns) + " |" for r in found)]) + "\n"


def plain(value):
    """What JSON can hold: numbers that aren't finite are null."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def to_json(df: DataFrame) -> str:
    return json.dumps(plain(rows(df)), default=str, sort_keys=True, allow_nan=False)


def write(spark: SparkSession, folder: str, title: str, verdict: str, tables: dict[str, DataFrame], p: Params, charts: dict[str, str] | None = None) -> None:
    """A study's report, which is written one time: report.json, report.md, charts and a line of the ledger beside the folder."""
    with once(spark, f"{folder}/report.json"):
        text = "\n".join([f"# {title}", "", f"Verdict: {verdict}. Parameters: {p.fingerprint()}.", "", *(f"## {name}\n\n{markdown(t)}" for name, t in tables.items())])
        body = {"title": title, "verdict": verdict, "fingerprint": p.fingerprint(), "tables": {name: plain(rows(t)) for name, t in tables.items()}}
        made = {"report.md": text, **{f"{name}.svg": svg for name, svg in (charts or {}).items()}, "report.json": json.dumps(body, default=str, sort_keys=True, allow_nan=False)}
        for name, content in made.items():
            _one_file(spark.createDataFrame([(content,)], "value string"), f"{folder}/{name}")
        append_ledger(spark, f"{folder.rstrip('/').rsplit('/', 1)[0]}/ledger", [{"trial": title, "verdict": verdict, "fingerprint": p.fingerprint()}])


def around(bars: DataFrame, series: str, minute: int, half: int) -> DataFrame:
    """A series' bars that open within half minutes of a minute."""
    return bars.where((F.col("series") == series) & F.col("t").between(minute - half, minute + half))


class Chart:
    """An SVG drawing: places by the share of width and height that they take."""

    def __init__(self, title: str, width: int = 900, height: int = 300):
        self.width, self.height, self.parts = width, height, [f"<title>{escape(title)}</title>"]

    def add(self, tag: str, text: str = "", **attributes) -> None:
        shown_ = " ".join(f'{k.replace("_", "-")}="{v:.1f}"' if isinstance(v, float) else f'{k.replace("_", "-")}="{v}"' for k, v in attributes.items())
        self.parts.append(f"<{tag} {shown_}>{escape(text)}</{tag}>")

    def __str__(self) -> str:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.width}" height="{self.height}">{"".join(self.parts)}</svg>'


def candles(bars: DataFrame, title: str, marks: list[tuple[str, int, float]] | None = None) -> str:
    """An SVG of bars (t, o, h, l, c); marks are a text, a minute and a price, such as an entry's and an exit's."""
    chart, found = Chart(title), sorted(rows(bars.select("t", "o", "h", "l", "c")), key=lambda r: r["t"])
    if not found:
        return str(chart)
    prices = [p for r in found for p in (r["h"], r["l"])] + [p for _, _, p in marks or []]
    low, spread = min(prices), (max(prices) - min(prices)) or 1.0
    up = lambda p: chart.height * (1 - (p - low) / spread)
    slot = chart.width / len(found)
    middle = {r["t"]: slot * (i + 0.5) for i, r in enumerate(found)}
    for r in found:
        at, colour = middle[r["t"]], "seagreen" if r["c"] >= r["o"] else "firebrick"
        top, bottom = sorted((up(r["o"]), up(r["c"])))
        chart.add("path", d=f"M{at:.1f} {up(r['h']):.1f}V{up(r['l']):.1f}", stroke=colour)
        chart.add("rect", x=at - slot / 3, y=top, width=slot * 2 / 3, height=max(bottom - top, 1.0), fill=colour)
    for name, minute, price in marks or []:
        near = min(middle, key=lambda t: abs(t - minute))
        chart.add("circle", cx=middle[near], cy=up(price), r=4, fill="navy")
        chart.add("text", name, x=middle[near] + 6, y=up(price), font_size=11)
    return str(chart)


def heat(df: DataFrame, row: str, columns: list[str], title: str) -> str:
    """An SVG grid of a table's values by row and column: green above 0, red below, the stronger the farther."""
    found = rows(df.select(row, *columns).orderBy(row))
    chart = Chart(title, 140 + 90 * len(columns), 30 + 24 * max(1, len(found)))
    most = max((abs(r[c]) for r in found for c in columns if r[c] is not None), default=0.0) or 1.0
    for j, c in enumerate(columns):
        chart.add("text", c, x=150 + 90 * j, y=18, font_size=12)
    for i, r in enumerate(found):
        chart.add("text", str(r[row]), x=4, y=46 + 24 * i, font_size=12)
        for j, c in enumerate(columns):
            value = r[c]
            colour = "white" if value is None else "seagreen" if value > 0 else "firebrick"
            chart.add("rect", x=140 + 90 * j, y=30 + 24 * i, width=88, height=22, fill=colour, fill_opacity=0.0 if value is None else abs(value) / most)
            chart.add("text", shown(value), x=150 + 90 * j, y=46 + 24 * i, font_size=12)
    return str(chart)
