"""Queries that have SQL on ticks with prices of 0, whose moves are infinite or no numbers: equal to DuckDB, value by value."""

import duckdb
import pytest

from quantloom.plans import catalog

#: A day's first and last bar, one within, two in a row, and most bars of a morning, so that medians meet infinite values too.
ZERO = (1 * 1440, 2 * 1440 + 1425, 8 * 1440 + 600, 8 * 1440 + 615, 9 * 1440 + 705, 10 * 1440 + 765, 11 * 1440 + 720, 15 * 1440 + 780, *range(14 * 1440 + 495, 14 * 1440 + 720, 30))


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("zero"), duckdb.connect()
    con.execute(f"""COPY (SELECT m AS event_id, TIMESTAMP '2024-01-01' + to_minutes(m) AS ts, 1::BIGINT AS user_id, 'a' AS event_type,
      CASE WHEN m IN {ZERO} THEN 0.0 ELSE 50 + hash(m) % 5000 / 100 END::DOUBLE AS value, '{{"k": ' || 10 + m % 7 || '}}' AS props FROM range(0, 19 * 1440, 15) r(m)) TO '{folder}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), con


def same(spark, tables, name):
    folder, con = tables
    got, want = catalog.QUERIES[name](spark, folder), con.execute(catalog.ORACLE_SQL[name])
    names, rows = [d[0] for d in want.description], want.fetchall()
    ours = [tuple(r[n] for n in names) for r in got.collect()]
    assert sorted(map(repr, ours)) == sorted(map(repr, rows))
    return [dict(zip(names, r, strict=True)) for r in rows]


def test_volatility(spark, tables):
    told = {repr(r["rv_rel"]) for r in same(spark, tables, "f_volatility")}
    assert {"inf", "nan", "0.0", "None"} <= told


def test_all_features(spark, tables):
    told = {repr(r["rv_rel"]) for r in same(spark, tables, "features_all")}
    assert {"inf", "nan"} <= told


@pytest.mark.parametrize("name", ["m1_cells", "m2_cells", "activation_m1", "cart_depth3"])
def test_mined(spark, tables, name):
    assert same(spark, tables, name)
